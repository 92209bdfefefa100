"""Operator 7: token-id files of shuffled planes.

Ids of documents stand in ascending doc_id order, an end id after each. They are cut into blocks of BLOCK ids;
a block's little-endian unsigned 32-bit ids are transposed into byte planes (or bit planes), and each plane is
compressed with zstandard. Blocks of consecutive whole documents form a segment: one record of the file with
its documents' ids and lengths and the chunk index (ids, and the offset and length of every plane). Segments are
written through Spark's Parquet writer (uncompressed, as planes are), whose commits survive lost executors on any
store; `index` beside them holds the first id's number of each segment.

Null and empty texts have the end id only. Rows of one doc_id stand in the order of their texts' hashes, which also
deals them out to the writers, and null doc_ids first. Columns other than doc_id and text are ignored. An empty table makes empty files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import shared_dir, slices, small, texts
from tallyforge.llm.pretokens import encoder

BLOCK = 1 << 16
#: Ids from which a segment ends with the document at hand.
SEGMENT = 1 << 20
END = 0
SEGMENT_SCHEMA = "part int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, block_ids array<int>, plane_offsets array<bigint>, plane_lengths array<bigint>, payload binary"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """ids (<u4) as 4 byte planes, or 32 bit planes."""
    by = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(by.T)]
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(np.unpackbits(by, axis=1, bitorder="little").T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The inverse of to_planes for n ids."""
    if len(planes) == 4:
        by = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        by = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(by).view("<u4").reshape(-1)


def pack(ids: np.ndarray, bits: bool = False, level: int = 1, size: int = BLOCK) -> tuple[list[int], list[int], list[int], bytes]:
    """Blocks' ids, offsets and lengths of their planes, and the payload."""
    blocks, offsets, lengths, out, at = [], [], [], [], 0
    press = zstandard.ZstdCompressor(level=level)
    for start in range(0, len(ids), size):
        block = ids[start : start + size]
        blocks.append(len(block))
        for plane in to_planes(block, bits):
            data = press.compress(plane)
            offsets.append(at)
            lengths.append(len(data))
            out.append(data)
            at += len(data)
    return blocks, offsets, lengths, b"".join(out)


def unpack(blocks: list[int], offsets: list[int], lengths: list[int], payload: bytes) -> np.ndarray:
    if not blocks:
        return np.zeros(0, dtype="<u4")
    per, view, press = len(offsets) // len(blocks), memoryview(payload), zstandard.ZstdDecompressor()
    spans = list(zip(offsets, lengths, strict=True))
    return np.concatenate([from_planes([press.decompress(view[o : o + n]) for o, n in spans[i * per : (i + 1) * per]], size) for i, size in enumerate(blocks)])


def write(docs: DataFrame, tokenizer: str, path: str, bits: bool = False, block: int = BLOCK, most: int = SEGMENT) -> None:
    """Encodes docs (doc_id, text) and writes `path`/segments and `path`/index. block: ids of a block; most: ids from which a segment ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ids, docs_, lengths, number = encoder(tokenizer, "ids").values, [], [], [], 0

        def segment() -> pa.RecordBatch:
            blocks, offsets, sizes, payload = pack(np.frombuffer(b"".join(ids), dtype="<u4"), bits, size=block)
            row = [part, number, docs_, lengths, sum(lengths), blocks, offsets, sizes, payload]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

        end, pending, part = np.array([END], dtype="<u4").tobytes(), 0, 0
        for whole in batches:
            part = whole.column("part")[0].as_py() if whole.num_rows else part
            for batch in slices(whole):
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                    data = b"".join(values(text)) + end
                    ids.append(data)
                    docs_.append(doc)
                    lengths.append(len(data) // 4)
                    pending += lengths[-1]
                    if pending >= most:
                        yield segment()
                        ids, docs_, lengths, pending, number = [], [], [], 0, number + 1
        if docs_:
            yield segment()

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("block_ids", pa.list_(pa.int32())), ("plane_offsets", pa.list_(pa.int64())), ("plane_lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(f"{path}/segments")
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    # one row for each part: as few as the writing tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = segments.select("part", "segment", "n_ids", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside")).join(base, "part")
    index.select("part", "segment", "n_ids", (F.col("base") + F.col("inside")).alias("start")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    index = spark.read.schema("part int, segment int, n_ids bigint, start bigint").parquet(f"{path}/index").select("part", "segment", "start")
    # a row for each segment
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments").join(small(index), ["part", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1).to_pylist()[0]
                data = memoryview(unpack(row["block_ids"], row["plane_offsets"], row["plane_lengths"], row["payload"]).tobytes())
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                starts = ends - row["lengths"]
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/token_files/{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
