"""Merging extractions: for each field the highest confidence, then the least value, then the least span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.schemas import EXTRACTION, FIELDS, NOTES, field


def rank(found: Column) -> Column:
    """Orders a field's candidates; the least is the best. Null where there is none."""
    return F.when(found.isNotNull(), F.struct((-found["confidence"]).alias("low"), found["value"].alias("value"), found["span"].alias("span")))


def unranked(best: Column, kind: str) -> Column:
    return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), (-best["low"]).cast("int").alias("confidence"), best["span"].alias("span"))).cast(field(kind))


def merge_columns(candidates: list[Column]) -> Column:
    """One extraction out of several in a row; null ones count for nothing."""
    fields = [unranked(F.array_min(F.array(*[rank(c[name]) for c in candidates])), kind).alias(name) for name, kind in FIELDS.items()]
    notes = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(c["notes"], F.array().cast(NOTES)) for c in candidates]))))
    return F.struct(*fields, notes.cast(NOTES).alias("notes"))


def merge_array(candidates: Column) -> Column:
    """One extraction out of an array of them; none of an empty or null array."""
    ranked = {name: F.transform(candidates, (lambda name: lambda c: rank(c[name]))(name)) for name in FIELDS}
    fields = [unranked(F.array_min(ranked[name]), kind).alias(name) for name, kind in FIELDS.items()]
    notes = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(candidates, lambda c: c["notes"])))), F.array().cast(NOTES))
    return F.struct(*fields, notes.cast(NOTES).alias("notes")).cast(EXTRACTION)


def merge_rows(candidates: DataFrame, by: list[str], column: str = "extraction") -> DataFrame:
    """One extraction for each key out of any number of rows. Partial minima are taken before the shuffle."""
    x = F.col(column)
    best = candidates.groupBy(*by).agg(*[F.min(rank(x[name])).alias(name) for name in FIELDS], F.collect_set(F.when(F.size(x["notes"]) > 0, x["notes"])).alias("notes"))
    fields = [unranked(F.col(name), kind).alias(name) for name, kind in FIELDS.items()]
    return best.select(*by, F.struct(*fields, F.array_sort(F.array_distinct(F.flatten("notes"))).cast(NOTES).alias("notes")).alias(column))


def extraction(notes: Column | None = None, **fields: Column) -> Column:
    """An extraction with the fields given and none of the others."""
    parts = [(fields[name] if name in fields else F.lit(None)).cast(field(kind)).alias(name) for name, kind in FIELDS.items()]
    return F.struct(*parts, (notes if notes is not None else F.array()).cast(NOTES).alias("notes")).cast(EXTRACTION)


def is_complete(found: Column, least: int = 50) -> Column:
    """The amount's confidence is at least `least`, and there are a vendor and a period or issue date."""
    return F.coalesce((found["amount"]["confidence"] >= least) & found["vendor"].isNotNull() & (found["period"].isNotNull() | found["issued"].isNotNull()), F.lit(False))
