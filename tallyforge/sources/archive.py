"""Zip archives: entries of an archive as rows."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Bytes of an entry, at most.
MAX_ENTRY = 64 << 20
#: Bytes of entries in a batch, about.
CHUNK = 16 << 20
ENCRYPTED, DESCRIPTOR = 0x0001, 0x0008


class Unsupported(Exception):
    """A feature this reader leaves alone."""


class Malformed(Exception):
    """Not an archive, or a broken one."""


def _has_zip64(extra: bytes) -> bool:
    at = 0
    while at + 4 <= len(extra):
        if int.from_bytes(extra[at : at + 2], "little") == 1:
            return True
        at += 4 + int.from_bytes(extra[at + 2 : at + 4], "little")
    return False


def _plain(archive: bytes, info: zipfile.ZipInfo) -> bytes | None:
    """The bytes of an entry whose own header agrees with the directory; None for whatever the standard reader has to judge. It takes several times as long."""
    at, end = info.header_offset, getattr(info, "_end_offset", None)
    head = archive[at : at + 30] if at >= 0 else b""
    if end is None or len(head) < 30 or head[:4] != b"PK\3\4" or info.flag_bits & ~0x800:
        return None
    flags, name, extra = struct.unpack("<6xH18x2H", head)
    start = at + 30 + name + extra
    if flags != info.flag_bits or archive[at + 30 : at + 30 + name].decode("utf-8" if flags else "cp437", "replace") != info.orig_filename or start + info.compress_size > min(end, len(archive)):
        return None
    packed = archive[start : start + info.compress_size]
    try:
        data = packed if info.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(packed, info.file_size + 1)
    except zlib.error:
        return None
    return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None


def entries(archive: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) in the order of the directory, without folders. What the standard reader would accept beyond plain stored and deflated entries is refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            out = []
            for info in z.infolist():
                if info.flag_bits & ENCRYPTED:
                    raise Unsupported("encryption")
                if info.flag_bits & DESCRIPTOR:
                    raise Unsupported("data descriptor")
                if _has_zip64(info.extra) or max(info.file_size, info.compress_size, info.header_offset) >= 0xFFFFFFFF:
                    raise Unsupported("zip64")
                if info.orig_filename.endswith("/"):
                    continue
                if info.file_size > MAX_ENTRY:
                    raise Unsupported("large entry")
                if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise Unsupported(f"compression method {info.compress_type}")
                data = _plain(archive, info)
                if data is None:
                    with z.open(info) as entry:
                        data = entry.read(info.file_size + 1)
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise Malformed("size or checksum differs")
                name = info.orig_filename if info.flag_bits & 0x800 else info.orig_filename.encode("cp437", "replace").decode("utf-8", "replace")
                out.append((name, data))
            return out
    except Unsupported:
        raise
    except Exception as e:
        raise Malformed(str(e)) from e


def rows_of(archive: bytes | None) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """name, bytes, error of each entry; one row with an error if it can't be read."""
    try:
        for name, data in entries(archive or b""):
            yield name, data, None
    except (Unsupported, Malformed) as e:
        yield None, None, f"{type(e).__name__.lower()}: {e}"


@udtf(returnType="name string, bytes binary, error string")
class Unzip:
    """unzip(archive): a row for each entry; one row with an error if it can't be read."""

    def eval(self, archive: bytes):
        yield from rows_of(archive)


def unzipped(rows: DataFrame, column: str) -> DataFrame:
    """rows joined laterally with unzip(column), in place of that column, in Arrow batches of about CHUNK bytes of entries."""
    others = [c for c in rows.columns if c != column]
    schema = T.StructType([*rows.select(*others).schema, T.StructField("name", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.select(others)

            def made(at: list[int], found: list[tuple], given: pa.RecordBatch = given) -> pa.RecordBatch:
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))]
                return pa.RecordBatch.from_arrays([*given.take(pa.array(at, pa.int32())).columns, *columns], names=[*others, "name", "bytes", "error"])

            at, found, size = [], [], 0
            for i, archive in enumerate(batch.column(column)):
                for row in rows_of(archive.as_py()):
                    at.append(i)
                    found.append(row)
                    size += len(row[1] or b"")
                    if size >= CHUNK:
                        yield made(at, found)
                        at, found, size = [], [], 0
            if found:
                yield made(at, found)

    return rows.mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    spark.udtf.register("unzip", Unzip)
