"""From raw messages to rows of the bill table.

What several steps read (which messages are new, their extractions) is written to the shared folder once: it is
decoded once, a lost executor costs no second pass, and a later run doesn't meet what this one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import bills
from tallyforge.operators.attachments import pdf_extractor
from tallyforge.operators.extract import Extractor, bill_rows, chain, escalate, identified, text_extractor
from tallyforge.operators.invoice import xml_extractor
from tallyforge.schemas import EXTRACTION
from tallyforge.sources import mime
from tallyforge.sources.files import within_limit
from tallyforge.sources.shared import saved
from tallyforge.sources.tables import BillTable, among

TOO_LARGE = "message too large"


def default_extractor(second: Extractor | None = None) -> Extractor:
    """Invoices, text, PDF; then the second pass, if there is one, for what is incomplete."""
    first = chain([xml_extractor, text_extractor, pdf_extractor()])
    return escalate(first, second) if second else first


def extracted(messages: DataFrame, extractor: Extractor) -> DataFrame:
    """Messages (id, hash, content) with their extraction, or an error."""
    envelopes = saved(mime.decode(messages))
    sound = extractor(envelopes.where("error IS NULL"), "extraction").select("id", "hash", "extraction", "error")
    failed = envelopes.where("error IS NOT NULL").select("id", "hash", F.lit(None).cast(EXTRACTION).alias("extraction"), "error")
    return sound.unionByName(failed)


def ingest(messages: DataFrame, table: BillTable, extractor: Extractor | None = None, order: str = "path") -> DataFrame:
    """Stores what is new and returns id, outcome, error of each message. messages: `order`, content.

    Messages that are stored, and later ones of the same bytes, are set aside before anything is decoded. An error
    stores nothing."""
    messages, beyond = within_limit(messages.withColumn("length", F.octet_length("content")))
    given = identified(messages)
    keys = saved(given.select(order, "id", "hash"))
    marked = saved(bills.outcomes(keys, among(table.read(), "hash", keys), F.col(order)))
    created = marked.where(F.col("outcome") == bills.CREATED)
    contents = given.select(order, "hash", "content").join(created.select("id", "hash", order), ["hash", order]).select("id", "hash", "content")
    fresh = saved(extracted(contents, extractor or default_extractor()))
    rows = saved(bill_rows(fresh.where("error IS NULL")).join(created.select("hash", order), "hash"))
    # another writer may have stored some of them meanwhile
    stored = table.append(lambda stored, last: bills.insert(stored, rows, [order], last))
    lost = rows.join(stored.select("hash"), "hash", "left_anti").select("hash", F.lit(True).alias("_lost"), F.lit(None).cast("string").alias("error"))
    errors = fresh.where("error IS NOT NULL").select("hash", F.lit(False).alias("_lost"), "error")
    done = marked.join(lost.unionByName(errors).withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash"), "left")
    # a failed message stores nothing, so a later copy of it fails as well
    refused = identified(beyond).select("id", F.lit(bills.FAILED).alias("outcome"), F.lit(TOO_LARGE).alias("error"))
    outcome = F.when(F.col("error").isNotNull(), bills.FAILED).when(F.col("_lost"), bills.DUPLICATE).otherwise(F.col("outcome"))
    return done.select("id", outcome.alias("outcome"), "error").unionByName(refused)


def reextract(messages: DataFrame, table: BillTable, extractor: Extractor | None = None, order: str = "path") -> DataFrame:
    """Extracts again, stored or not, and replaces what differs exactly. Returns id, outcome, error."""
    messages, beyond = within_limit(messages.withColumn("length", F.octet_length("content")))
    given = identified(messages)
    first = saved(bills.first_of_each_hash(given.select(order, "id", "hash"), F.col(order)).where("first").drop("first"))
    contents = given.select(order, "hash", "content").join(first, ["hash", order]).select("id", "hash", "content")
    fresh = saved(extracted(contents, extractor or default_extractor()))
    rows = saved(bill_rows(fresh.where("error IS NULL")))
    judged = saved(bills.compared(rows, among(table.read(), "hash", rows)))
    table.replace(judged.where(F.col("outcome") == bills.UPDATED))
    created = judged.where(F.col("outcome") == bills.CREATED).drop("outcome").join(first.select("hash", order), "hash")
    table.append(lambda stored, last: bills.insert(stored, created, [order], last))
    failed = fresh.where("error IS NOT NULL").select("id", F.lit(bills.FAILED).alias("outcome"), "error")
    refused = identified(beyond).select("id", F.lit(bills.FAILED).alias("outcome"), F.lit(TOO_LARGE).alias("error"))
    return judged.select("id", "outcome", F.lit(None).cast("string").alias("error")).unionByName(failed).unionByName(refused)
