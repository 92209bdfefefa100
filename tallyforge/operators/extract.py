"""Extractors: functions that add an `extraction` column to envelopes, and how they are combined.

An extractor takes a DataFrame of envelopes and the name of the column to add; it may also set `error`, a
string, for rows it can't process.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import validate
from tallyforge.functions.scan import scan
from tallyforge.functions.text import hex_id, raw_hash, strip_html
from tallyforge.operators.merge import extraction, is_complete, merge_columns
from tallyforge.schemas import EXTRACTED, HTML, NEEDS_REVIEW, TEXT
from tallyforge.sources.shared import saved

Extractor = Callable[[DataFrame, str], DataFrame]
VENDOR_CONFIDENCE = 20


def vendor_of(sender: Column, sender_name: Column) -> Column:
    """The display name, else the lower-cased domain: what follows the first @."""
    domain = F.lower(F.regexp_extract(sender, r"(?s)^[^@]*@(.*)$", 1))
    name = F.coalesce(validate.vendor(sender_name), validate.vendor(domain))
    nowhere = F.struct(F.struct(F.lit(TEXT).alias("kind"), F.lit(None).cast("int").alias("doc")).alias("source"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.when(name.isNotNull(), F.struct(name.alias("value"), F.lit(VENDOR_CONFIDENCE).alias("confidence"), nowhere.alias("span")))


def text_extractor(envelopes: DataFrame, out: str) -> DataFrame:
    """Amount and dates of the text and of the HTML without its tags; the vendor from the sender."""
    both = scan(envelopes, "text", f"{out}_t", TEXT).withColumn(f"{out}_stripped", strip_html(F.col("html")))
    both = scan(both, f"{out}_stripped", f"{out}_h", HTML)
    parts = [extraction(amount=F.col(f"{out}_{p}.amount"), due=F.col(f"{out}_{p}.due"), issued=F.col(f"{out}_{p}.issued")) for p in ("t", "h")]
    merged = both.withColumn(out, merge_columns(parts))
    return merged.withColumn(out, F.col(out).withField("vendor", vendor_of(F.col("sender"), F.col("sender_name")))).drop(f"{out}_t", f"{out}_h", f"{out}_stripped")


def chain(extractors: Sequence[Extractor]) -> Extractor:
    """All extractors one after another; the first error in their order stays, and the results are merged."""

    def run(envelopes: DataFrame, out: str) -> DataFrame:
        if not extractors:
            return envelopes.withColumn(out, extraction())
        df = envelopes if "error" in envelopes.columns else envelopes.withColumn("error", F.lit(None).cast("string"))
        names = []
        for i, one in enumerate(extractors):
            names.append(f"{out}_{i}")
            df = one(df.withColumn("_earlier", F.col("error")), names[-1]).withColumn("error", F.coalesce("_earlier", "error")).drop("_earlier")
        return df.withColumn(out, merge_columns([F.col(n) for n in names])).drop(*names)

    return run


def escalate(first: Extractor, second: Extractor, least: int = 50) -> Extractor:
    """The second extractor only for rows that the first leaves incomplete; a split and a union, as a conditional would not keep it from the others.

    The first pass is written to the shared folder, so that it runs once."""

    def run(envelopes: DataFrame, out: str) -> DataFrame:
        passed = first(envelopes, out)
        if "error" not in passed.columns:
            passed = passed.withColumn("error", F.lit(None).cast("string"))
        passed = saved(passed)
        settled = F.col("error").isNotNull() | (is_complete(F.col(out), least) if least <= 100 else F.lit(False))
        again = second(passed.where(~settled), f"{out}_second")
        again = again.withColumn(out, merge_columns([F.col(out), F.col(f"{out}_second")])).drop(f"{out}_second")
        return passed.where(settled).unionByName(again.select(*passed.columns))

    return run


def identified(messages: DataFrame) -> DataFrame:
    """Raw messages (content) with hash and id."""
    return messages.withColumns({"hash": raw_hash(F.col("content")), "id": hex_id(F.col("content"))})


def bill_rows(extracted: DataFrame, column: str = "extraction", least: int = 50) -> DataFrame:
    """id, hash and the flat columns of a bill. All present fields stay, whatever the status."""
    x = F.col(column)
    return extracted.select(
        "id", "hash", x["vendor"]["value"].alias("vendor"), x["amount"]["value"]["minor_units"].alias("amount_minor"), x["amount"]["value"]["currency"].alias("currency"),
        x["period"]["value"]["start"].alias("period_start"), x["period"]["value"]["end"].alias("period_end"), x["issued"]["value"].alias("issued"), x["due"]["value"].alias("due"),
        F.when(is_complete(x, least), EXTRACTED).otherwise(NEEDS_REVIEW).alias("status"),
    )
