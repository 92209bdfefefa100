"""Continuous ingest: micro-batches of messages through the batch plan, so that overlaps are harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tallyforge.operators.bills import CREATED, DUPLICATE, FAILED
from tallyforge.operators.extract import Extractor
from tallyforge.plans.ingest import ingest
from tallyforge.plans.mailbox import stored
from tallyforge.sources import mail
from tallyforge.sources.shared import released
from tallyforge.sources.tables import BillTable

INTERVAL = "1800 seconds"
#: How long the ids of messages stay in the state, and how far back a batch lists again.
REMEMBERED, OVERLAP = "2 days", 86_400
#: The streaming query's own count of messages, in its progress.
LISTED = "listed"


class Progress(StreamingQueryListener):
    """Logs how many messages a batch got past the state, from the query's progress: no job of its own."""

    def __init__(self, log: Callable[[str], None]) -> None:
        self.log = log

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(LISTED)
        if seen is not None:
            self.log(f"progress {event.progress.batchId}: {seen.messages} messages")

    def onQueryTerminated(self, event) -> None:
        pass


def counted(done: DataFrame, number: int, folder: str | None) -> str:
    """Writes a batch's outcomes (to `folder`, where one is given) and counts them on the way, in one job."""
    seen = Observation(f"outcomes {number}")
    n = lambda o: F.count_if(F.col("outcome") == o)
    observed = done.observe(seen, F.count(F.lit(1)).alias("total"), n(CREATED).alias("created"), n(DUPLICATE).alias("duplicate"), n(FAILED).alias("failed"))
    # a batch that runs again replaces what it wrote
    (observed.write.mode("overwrite").parquet(f"{folder}/batch={number}") if folder else observed.write.format("noop").mode("overwrite").save())
    got = seen.get
    return f"batch {number}: {got['total']} total, {got['created']} created, {got['duplicate']} duplicate, {got['failed']} failed"


def started(stream: DataFrame, take: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool, log: Callable[[str], None], outcomes: str | None) -> StreamingQuery:
    """The first batch starts at once, and later ones never overlap. What a batch wrote for itself goes when its outcomes are counted."""

    def batch(messages: DataFrame, number: int) -> None:
        with released(messages.sparkSession):
            log(counted(take(messages), number, outcomes))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def poll(stream: DataFrame, table: BillTable, checkpoint: str, extractor: Extractor | None = None, once: bool = False, log: Callable[[str], None] = print, outcomes: str | None = None) -> StreamingQuery:
    """Messages (path, content) of any stream. The table's hashes are the state: a batch that runs again after a failure, or messages seen before, are duplicates.
    outcomes: a folder for id, outcome, error of each message, by batch."""
    return started(stream, lambda messages: ingest(messages, table, extractor), checkpoint, once, log, outcomes)


def poll_mailbox(spark: SparkSession, table: BillTable, checkpoint: str, extractor: Extractor | None = None, once: bool = False, log: Callable[[str], None] = print, outcomes: str | None = None, **options: str) -> StreamingQuery:
    """The mailbox as a stream. Batches list the last day again, for messages that appeared late; the ids of two days stay in the state store, so that what was taken is
    neither fetched again nor looked for in the table. A restart goes on where the checkpoint says. options: of the mailbox source."""
    mail.register(spark)
    listed = spark.readStream.format("mailbox").options(**{"overlap": str(OVERLAP)} | options, contents="false").load()
    new = listed.withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", REMEMBERED).dropDuplicatesWithinWatermark(["message_id"]).drop("at")
    new = new.observe(LISTED, F.count(F.lit(1)).alias("messages"))
    return started(new, lambda messages: stored(mail.with_contents(messages, **options), table, extractor), checkpoint, once, log, outcomes)
