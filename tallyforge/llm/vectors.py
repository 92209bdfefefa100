"""What the two vector searches share: which rows take part, and the grid of candidate and query blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding array<double>, of the rows that have an id and only finite components."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """One row for each vec_id divisible by `every`; of rows that share an id, the least vector asks."""
    return vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def part(parts: Column | int, seed: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def stacked(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix."""
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query's candidates, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
