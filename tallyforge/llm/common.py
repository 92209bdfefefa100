"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 1_000_000

#: Keys that are joined by broadcast for having many rows, at most.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named:
            named = tempfile.mkdtemp(prefix="spark-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written to the shared folder for a job that knows when it has read them for the last time."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self) -> str:
        return f"{self.root}/{uuid.uuid4().hex}"

    def saved(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def release(self, df: DataFrame) -> None:
        """Deletes what `saved` wrote for df; another table is left alone."""
        _, path = self.paths.pop(id(df), (None, None))
        if path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id, modulo 4, is 2. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def least_hashed(df: DataFrame, n: int, most: int, seed: int, *by: str) -> DataFrame:
    """At most `most` of df's rows, those of the least hash of the columns `by`. n: df's rows, or those of a larger table that df is a random part of. Where `most`
    would be exceeded, rows go by their hash alone before they are ordered, so that of all tasks little more than `most` rows are brought together."""
    hashed = F.xxhash64(*by, F.lit(seed))
    # six standard deviations above what is expected, and at least so many rows
    share = (most + 6 * most**0.5 + 64) / max(1, n)
    some = df.where(hashed < int(share * 2**64) - 2**63) if share < 1 else df
    return some.orderBy(hashed, *by).limit(most)


def join_by_key(left: DataFrame, right: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """left with the columns of right, a row for each key whose `n` counts left's rows of that key. Keys with over 1/`hot` of left's rows, fewer than
    `hot`, are broadcast, so that no task gets all rows of one; the others are joined by a shuffle. Both sides are read twice."""
    most = (right.agg(F.sum("n").alias("rows")).first().rows or 0) / hot
    many = F.broadcast(right.where(F.col("n") > most).drop("n"))
    few = right.where(F.col("n") <= most).drop("n")
    return left.join(many, key).unionByName(left.join(many.select(key), key, "left_anti").join(few, key))


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch, so that what a task holds as Python objects stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
