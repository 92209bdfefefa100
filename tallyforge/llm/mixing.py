"""Operator 5: mixing sources to target weights by capped water-filling.

Targets share a multiple of the corpus by weight; a source whose share exceeds its cap of epochs is clamped
and the excess goes to the others in proportion, until none is above. A source that takes r epochs repeats
each document floor(r) times; of the rest, a fraction f, each stratum takes the documents that come first in a
seeded order until a fraction f of its words is reached. The document at that point is repeated in part.

Strata are seeded parts of a source of about STRATUM documents, so that no task orders a whole source. Sources
weigh 5, 2, 1, repeating, in code point order, null last. Null and empty texts have size 0 and take nothing.
Repeated rows count each time; a source without words has target 0. Columns other than doc_id, text and source are ignored.
The table of sources (one row each) is ordered by one task: it is as small as a mixing configuration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD

STRATUM = 4096
SEED = "mix-1"


def order_key() -> Column:
    """The place of a row in the seeded order: by doc_id and text, so that rows without an id are dealt out as well."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), order_key().alias("order_key"))


def targets(sized: DataFrame) -> DataFrame:
    """sized: source, size. Returns source, source_size, documents, target for 150 % of all sizes and at most 2 epochs, in whole numbers up to the last division."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.when(number % 3 == 0, 5).when(number % 3 == 1, 2).otherwise(1).cast("bigint")
    weighed = sources.withColumn("number", number).withColumn("weight", weight)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "number")
    everything = Window.partitionBy()
    level = weighed.withColumns({
        "all_size": F.sum("source_size").over(everything),
        "filled": F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    clamped = F.col("weight") * (3 * F.col("all_size") - 4 * F.col("filled")) >= 4 * F.col("source_size") * F.col("weight_left")
    settled = level.withColumn("clamped", clamped).withColumns({
        "clamped_size": F.sum(F.when(F.col("clamped"), F.col("source_size")).otherwise(0)).over(everything),
        "open_weight": F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything),
    })
    share = (F.col("weight") * (3 * F.col("all_size") - 4 * F.col("clamped_size"))).cast("double") / F.nullif(2 * F.col("open_weight"), F.lit(0)).cast("double")
    return settled.select("source", "source_size", "documents", F.when(F.col("clamped"), (2 * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, whole, part, taken: one row for each row of docs; taken = whole * size + part words."""
    return placed(docs).select("doc_id", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, order_key, size, source_size, target, whole, part of each row."""
    sized = sizes(docs)
    plan = targets(sized)
    joined = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.doc_id", "d.source", "d.size", "d.order_key", "p.source_size", "p.documents", "p.target")
    strata = F.ceil(F.col("documents") / STRATUM).cast("bigint")
    epochs = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)).cast("double"), F.lit(0.0))
    salted = joined.withColumns({"stratum": F.conv(F.substring("order_key", 1, 7), 16, 10).cast("bigint") % strata, "epochs": epochs}).withColumn("whole", F.floor("epochs").cast("bigint"))
    own = Window.partitionBy("source", "stratum")
    before = own.orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = salted.withColumns({"stratum_size": F.sum("size").over(own), "before": F.coalesce(F.sum("size").over(before), F.lit(0))})
    bound = F.floor((F.col("epochs") - F.col("whole")) * F.col("stratum_size")).cast("bigint")
    part = F.least(F.greatest(bound - F.col("before"), F.lit(0)), F.col("size"))
    return summed.select("doc_id", "source", "order_key", "size", "source_size", "target", "whole", part.alias("part"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns as they were. A part of at least half a text is one more whole copy, as no text is cut;
    rows of one doc_id, source and text share their copies evenly."""
    copies = placed(docs).where("size > 0").withColumn("copies", (F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)).cast("int"))
    copies = copies.groupBy(F.col("source").alias("_of"), F.col("order_key").alias("_key")).agg(F.round(F.sum("copies") / F.count("*")).cast("int").alias("_copies")).where("_copies > 0")
    keyed = docs.withColumn("_order_key", order_key())
    return keyed.join(copies, (F.col("_order_key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_of"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


#: The same rows in DuckDB's SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, md5('mix-1:' || coalesce(CAST(CAST(doc_id AS BIGINT) AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS order_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS number FROM sources),
weights AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM weighed),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size,
         CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled,
         CAST(sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left
  FROM weights),
clamps AS (SELECT *, weight * (3 * all_size - 4 * filled) >= 4 * source_size * weight_left AS clamped FROM filled),
settled AS (
  SELECT *, CAST(sum(CASE WHEN clamped THEN source_size ELSE 0 END) OVER () AS BIGINT) AS clamped_size,
         CAST(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS BIGINT) AS open_weight FROM clamps),
plan AS (
  SELECT source, source_size, documents,
         CASE WHEN clamped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * (3 * all_size - 4 * clamped_size) AS DOUBLE) / CAST(nullif(2 * open_weight, 0) AS DOUBLE) END AS target
  FROM settled),
seeded AS (
  SELECT d.doc_id, d.source, d.size, d.order_key, p.source_size, p.target,
         coalesce(p.target / CAST(nullif(p.source_size, 0) AS DOUBLE), 0.0) AS epochs,
         CAST(ceil(p.documents / 4096) AS BIGINT) AS strata
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
salted AS (SELECT *, CAST('0x' || substr(order_key, 1, 7) AS BIGINT) % strata AS stratum, CAST(floor(epochs) AS BIGINT) AS whole FROM seeded),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, stratum) AS BIGINT) AS stratum_size,
         CAST(coalesce(sum(size) OVER (PARTITION BY source, stratum ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM salted),
parts AS (
  SELECT *, least(greatest(CAST(floor((epochs - whole) * stratum_size) AS BIGINT) - before, 0), size) AS part FROM placed)
SELECT doc_id, size, source_size, target, whole, part, whole * size + part AS taken FROM parts
"""
