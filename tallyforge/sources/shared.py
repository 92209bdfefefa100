"""The folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


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


_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What `saved` writes inside goes at the end. Results that still read it must have been written or counted by then."""
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage and survives lost executors."""
    path = f"{_folder.get() or shared_dir(df.sparkSession) + '/tables'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
