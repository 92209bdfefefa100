"""From a mailbox to the bill table: one fetch over a window of days, and the tick of a poll."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import poll_start
from tallyforge.operators import bills
from tallyforge.operators.extract import Extractor
from tallyforge.plans.ingest import ingest
from tallyforge.sources import mail
from tallyforge.sources.shared import saved
from tallyforge.sources.tables import BillTable


def fetch(spark: SparkSession, table: BillTable, after: str | None = None, before: str | None = None, extractor: Extractor | None = None, **options: str) -> DataFrame:
    """Stores what is new among the messages of the window and returns message_id (null where only the bytes failed), id, outcome, error.

    A message that can't be fetched is a failed row, and the others are stored. options: of the mailbox source."""
    mail.register(spark)
    days = {k: v for k, v in (("after", after), ("before", before)) if v}
    return stored(spark.read.format("mailbox").options(**days, **options).load(), table, extractor)


def stored(messages: DataFrame, table: BillTable, extractor: Extractor | None = None) -> DataFrame:
    """Stores what is new among a mailbox's messages (message_id, content, error). They are written to the shared folder first, so that each is fetched once."""
    fetched = saved(messages.select("message_id", "content", "error"))
    done = ingest(fetched.where("error IS NULL").select("message_id", "content"), table, extractor, order="message_id")
    lost = fetched.where("error IS NOT NULL").select("message_id", F.lit(None).cast("string").alias("id"), F.lit(bills.FAILED).alias("outcome"), "error")
    return done.select(F.lit(None).cast("string").alias("message_id"), "id", "outcome", "error").unionByName(lost)


def tick(spark: SparkSession, table: BillTable, now: datetime.datetime, extractor: Extractor | None = None, **options: str) -> DataFrame:
    """One poll: yesterday and today in UTC. What an earlier tick stored is a duplicate."""
    today = now.astimezone(datetime.UTC).date()
    return fetch(spark, table, str(poll_start(now)), str(today + datetime.timedelta(days=1)), extractor, **options)
