"""The table of bills: idempotent inserts, look-ups, pages, exact replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.validate import broken_invariant, is_bill_id, page_size
from tallyforge.schemas import BILL_COLUMNS, NEEDS_REVIEW
from tallyforge.sources.shared import saved
from tallyforge.sources.tables import among, updated

CREATED, DUPLICATE, UPDATED, UNCHANGED, FAILED = "created", "duplicate", "updated", "unchanged", "failed"


def first_of_each_hash(rows: DataFrame, order: Column) -> DataFrame:
    """rows with `first`: whether a row is the first of its hash. Joined by hash and order, so that a message that came often is dealt out."""
    return _marked(rows, order, rows.groupBy("hash").agg(F.min(order).alias("_order")), "first")


def _marked(rows: DataFrame, order: Column, some: DataFrame, name: str) -> DataFrame:
    """rows with whether their hash and order are among `some` (hash, _order)."""
    keyed = rows.withColumn("_place", order)
    found = some.select(F.col("hash").alias("_hash"), "_order", F.lit(True).alias(name))
    joined = keyed.join(found, F.col("hash").eqNullSafe(F.col("_hash")) & (F.col("_place") == F.col("_order")), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).drop("_place", "_hash", "_order")


def new_messages(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """What isn't stored yet, one of each hash: the anti join comes before any decoding."""
    return messages.join(stored.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def outcomes(messages: DataFrame, stored: DataFrame, order: Column) -> DataFrame:
    """messages with outcome: created for the first of a hash that isn't stored, else duplicate."""
    new = messages.groupBy("hash").agg(F.min(order).alias("_order")).join(stored.select("hash"), "hash", "left_anti")
    return _marked(messages, order, new, "_new").withColumn("outcome", F.when(F.col("_new"), CREATED).otherwise(DUPLICATE)).drop("_new")


def numbered(new: DataFrame, last: int, order: list[str]) -> DataFrame:
    """new with seq after the last one. The numbers within the batch come from per-partition counts, not from one task;
    the rows are written first, as ranges dealt out twice could differ."""
    placed = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = saved(placed)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("seq", F.lit(last) + F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def insert(stored: DataFrame, new: DataFrame, order: list[str], last: int | None = None) -> DataFrame:
    """The rows to append. new: id, hash and a bill's columns; last: the last seq, which is looked for if it isn't given. An id that another hash holds is an error."""
    if last is None:
        last = stored.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first().n
    fresh = new_messages(new, among(stored, "hash", new))
    clash = among(stored, "id", fresh).select("id").limit(1).collect()
    if clash:
        raise ValueError(f"id exists with another hash: {clash[0].id}")
    return numbered(fresh, last, order).withColumn("inserted_at", F.current_timestamp())


def corrupt_reason(bills: DataFrame) -> Column:
    """Why a stored row can't be a bill, null if it can."""
    c = F.col
    return F.when(~is_bill_id(c("id")), "bad id").otherwise(broken_invariant(c("status"), c("vendor"), c("amount_minor"), c("currency"), c("period_start"), c("period_end"), c("issued")))


def checked(bills: DataFrame) -> DataFrame:
    """bills, half amounts and half periods as none; a corrupt row fails the read."""
    reason = corrupt_reason(bills)
    whole_amount, whole_period = F.col("amount_minor").isNotNull() & F.col("currency").isNotNull(), F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    kept = {n: F.when(whole_amount, F.col(n)) for n in ("amount_minor", "currency")} | {n: F.when(whole_period, F.col(n)) for n in ("period_start", "period_end")}
    return bills.withColumn("status", F.when(reason.isNull(), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("corrupt bill "), F.coalesce("id", F.lit("?")), F.lit(": "), reason)).cast("string"))).withColumns(kept)


def split_corrupt(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with _corrupt_reason, for readers that would rather set them aside."""
    marked = bills.withColumn("_corrupt_reason", corrupt_reason(bills))
    return marked.where("_corrupt_reason IS NULL").drop("_corrupt_reason"), marked.where("_corrupt_reason IS NOT NULL")


def get(bills: DataFrame, id: str) -> DataFrame:
    return checked(bills.where(F.col("id") == id))


def find_by_hash(bills: DataFrame, hex_hash: str) -> DataFrame:
    return checked(bills.where(F.col("hash") == F.unhex(F.lit(hex_hash))))


def listed(bills: DataFrame) -> DataFrame:
    """All bills in order of insertion."""
    return checked(bills).orderBy("seq")


def newest_first(bills: DataFrame, needs_review_only: bool = False) -> DataFrame:
    return checked(bills.where(F.col("status") == NEEDS_REVIEW) if needs_review_only else bills).orderBy(F.desc("seq"))


def page(bills: DataFrame, size: int = 50, status: str | None = None, before: str | None = None) -> DataFrame:
    """Up to size + 1 bills from newest to oldest, only those older than the bill `before`. The last one beyond the size shows that there are more."""
    page_size(size)
    if before is not None:
        cursor = bills.where(F.col("id") == before).select("seq").head()
        if cursor is None:
            raise LookupError(f"no bill {before}")
        bills = bills.where(F.col("seq") < cursor.seq)
    if status is not None:
        bills = bills.where(F.col("status") == status)
    return checked(bills.orderBy(F.desc("seq")).limit(size + 1))


def kept_and_next(overfetched: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The page's bills, and the id to go on from (one row, null at the end). At most 201 rows come in."""
    ranked = overfetched.withColumn("_nth", F.row_number().over(Window.orderBy(F.desc("seq"))))
    kept = ranked.where(F.col("_nth") <= size).drop("_nth")
    following = ranked.agg(F.when(F.count("*") > size, F.max(F.when(F.col("_nth") == size, F.col("id")))).alias("next"))
    return kept, following


def compared(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new bills with outcome against the stored ones of their hash: created, unchanged or updated."""
    old = stored.select(F.col("hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in BILL_COLUMNS])
    same = F.lit(True)
    for c in BILL_COLUMNS:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col("_hash").isNull(), CREATED).when(same, UNCHANGED).otherwise(UPDATED)
    return new.join(old, F.col("hash") == F.col("_hash"), "left").withColumn("outcome", outcome).select(*new.columns, "outcome")


def replaced(bills: DataFrame, updates: DataFrame) -> DataFrame:
    """bills with the columns of updates' bills, nulls too; id, hash, seq and inserted_at stay. An unknown id is an error."""
    if updates.join(bills.select("id"), "id", "left_anti").limit(1).count():
        raise LookupError("no such bill")
    return updated(bills, updates)


def report(outcomes: DataFrame) -> DataFrame:
    """total, created, duplicate, failed of an ingest."""
    n = lambda o: F.count_if(F.col("outcome") == o).cast("bigint")
    return outcomes.agg(F.count("*").cast("bigint").alias("total"), n(CREATED).alias("created"), n(DUPLICATE).alias("duplicate"), n(FAILED).alias("failed"))


def lines(outcomes: DataFrame) -> DataFrame:
    """A line for each message: outcome, id, and the error if it failed."""
    return outcomes.select(F.concat(F.initcap("outcome"), F.lit(" "), F.coalesce("id", F.lit("-")), F.coalesce(F.concat(F.lit(": "), "error"), F.lit(""))).alias("line"))
