"""Raw messages from files, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Bytes of a message, at most.
MAX_MESSAGE = 25 << 20


def messages(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """path, length, content of the messages in a folder; one file may be named too."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def message_stream(spark: SparkSession, path: str, pattern: str = "*.eml", files: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(path).select("path", "length", "content")


def within_limit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of a size that is taken, and the others."""
    small = F.col("length") <= MAX_MESSAGE
    return df.where(F.coalesce(small, F.lit(True))), df.where(~small)
