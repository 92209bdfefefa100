"""The table of bills: Parquet files, and for each version of the table a list of its files.

A version is one small file, `versions/<n>.json`, with the name, the number of rows and the range of seq of each data file. A change writes its data files into a
folder of their own, which nobody reads yet, and then makes the next version's file. Only one writer can make it; another one begins anew from what it holds,
so concurrent inserts all stay, each hash once. Readers see whole versions.

Data files are sorted by hash and have Bloom filters on hash and id, so that a look-up of some bills skips nearly all row groups (`among`). Replacing bills
rewrites the files that hold one of them and no other. Small files are merged once there are FEW. Files that no kept version lists go by `vacuum`.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.schemas import BILL_COLUMNS, BILLS

#: Keys of a look-up that are pushed down to the files, at most; more are joined.
PROBED = 2000
#: Small files that are merged, and the rows from which a file isn't small.
FEW, LARGE = 8, 1_000_000
#: Rows of a row group, at most; bounds the size of its Bloom filters.
GROUP = 100_000
#: Versions that vacuum keeps, and a writer's attempts.
KEPT, TRIES = 20, 100
WRITER = {"parquet.block.row.count.limit": str(GROUP), "parquet.bloom.filter.adaptive.enabled": "true"} | {
    f"parquet.bloom.filter.{option}#{column}": value for column in ("hash", "id") for option, value in (("enabled", "true"), ("fpp", "0.00001"), ("expected.ndv", str(GROUP)))
}


class Conflict(Exception):
    """Other writers were faster each time."""


@dataclass(frozen=True)
class File:
    name: str
    rows: int
    first: int
    last: int


def among(bills: DataFrame, column: str, keys: DataFrame, most: int = PROBED) -> DataFrame:
    """bills whose `column` is one of keys' (a table with that column). Up to `most` keys become a filter that reaches the files' statistics and Bloom filters."""
    few = [r[0] for r in keys.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(few) > most:
        return bills.join(keys.select(column).distinct(), column, "left_semi")
    # lists of up to ten are pushed down value by value
    parts = [F.col(column).isin(few[at : at + 10]) for at in range(0, len(few), 10)]
    while len(parts) > 1:
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return bills.where(parts[0] if parts else F.lit(False))


class BillTable:
    """Any number of readers and writers. `read_only` tables are never created or written. Paths may be on any store that Spark reads and that renames files whole."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        if read_only and self.version() is None:
            raise FileNotFoundError(path)

    def _at(self, *parts: str):
        """The file system and the path of a part of the table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, at = self._at("versions")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def files(self, version: int | None = None) -> list[File]:
        """The data files of a version, by default the newest one."""
        version = self.version() if version is None else version
        if version is None:
            return []
        fs, at = self._at("versions", f"{version}.json")
        stream = fs.open(at)
        try:
            return [File(**f) for f in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """Columns that an older file lacks are null."""
        return self._rows(self.files(version))

    def _rows(self, files: list[File]) -> DataFrame:
        return self.spark.read.schema(BILLS).parquet(*(f"{self.path}/{f.name}" for f in files)) if files else self.spark.createDataFrame([], BILLS)

    def _written(self, rows: DataFrame) -> list[File]:
        """Writes rows to new files, of ranges of seq as large as the session's partitions, and returns these."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], BILLS).columns
        rows.select(*columns).repartitionByRange("seq").sortWithinPartitions("hash").write.options(**WRITER).parquet(f"{self.path}/{folder}")
        found = self.spark.read.schema(BILLS).parquet(f"{self.path}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))
        return sorted((File(f"{folder}/{r.name}", r.rows, r.first, r.last) for r in found.collect()), key=lambda f: f.first)

    def _publish(self, version: int, files: list[File]) -> bool:
        """Makes the version's file, whole, unless there is one."""
        fs, draft = self._at("versions", f".{uuid.uuid4().hex}")
        _, target = self._at("versions", f"{version}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps([asdict(f) for f in files]).encode()))
        out.close()
        try:
            return _moved(self.spark, fs, draft, target)
        finally:
            fs.delete(draft, False)

    def _change(self, make: Callable[[list[File]], tuple[list[File], list[File]]], once: bool = False) -> list[File]:
        """Commits what make(files) says: the files to take out and those to add. Only additions to what make saw are no conflict with a change that takes files out
        and adds the same rows; whoever adds rows begins anew. Returns the added files."""
        if self.read_only:
            raise PermissionError("the table is read-only")
        for attempt in range(1 if once else TRIES):
            at = self.version()
            seen = self.files(at)
            gone, new = make(seen)
            if at is not None and not gone and not new:
                return []
            while True:
                names = {f.name for f in gone}
                if self._publish(0 if at is None else at + 1, [f for f in seen if f.name not in names] + new):
                    return new
                at = self.version()
                seen = self.files(at)
                if not gone or not names <= {f.name for f in seen}:
                    break
            self._drop(new)
            time.sleep(random.random() * min(2.0, 0.05 * 2**attempt))
        raise Conflict(f"{TRIES} attempts")

    def _drop(self, files: list[File]) -> None:
        for folder in {f.name.rpartition("/")[0] for f in files}:
            fs, at = self._at(folder)
            fs.delete(at, True)

    def append(self, rows: DataFrame | Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """Adds rows, or those of rows(stored, last seq), which is asked again when another writer was faster, and returns them as stored. Nothing that was written before is touched."""
        make = rows if callable(rows) else lambda *_: rows
        new = self._change(lambda seen: ([], self._written(make(self._rows(seen), max((f.last for f in seen), default=0)))))
        self.compact()
        return self._rows(new)

    def write(self, rows: DataFrame) -> None:
        """The whole table anew. The versions before stay, for readers that have begun."""
        self._change(lambda seen: (seen, self._written(rows)))

    def replace(self, updates: DataFrame) -> None:
        """Sets the columns of updates' bills (id and all BILL_COLUMNS), nulls too; id, hash, seq and inserted_at stay. Rewrites the files that hold one of them. An unknown id is an error, and nothing is changed."""

        def make(seen: list[File]) -> tuple[list[File], list[File]]:
            stored = self._rows(seen)
            # a join has no _metadata, so the place comes before it
            held = among(stored.select("id", F.col("_metadata.file_path").alias("at") if seen else F.lit("").alias("at")), "id", updates)
            if updates.join(held, "id", "left_anti").limit(1).count():
                raise LookupError("no such bill")
            names = {r.at.rpartition("/data/")[2] for r in held.select("at").distinct().collect()}
            touched = [f for f in seen if f.name.removeprefix("data/") in names]
            return touched, self._written(updated(self._rows(touched), updates)) if touched else []

        self._change(make)

    def compact(self) -> None:
        """Merges the small files if there are many; leaves them to another writer that is at it."""
        small = [f for f in self.files() if f.rows < LARGE]
        if len(small) >= FEW:
            try:
                self._change(lambda seen: (small, self._written(self._rows(small))) if {f.name for f in small} <= {f.name for f in seen} else ([], []), once=True)
            except Conflict:
                pass

    def vacuum(self, age: float = 7 * 86400, keep: int = KEPT) -> int:
        """Deletes the lists of all but the newest `keep` versions, and data files that none of these lists and that are older than `age` seconds (younger ones may belong to a writer that hasn't committed). Returns the number of folders that went."""
        if self.read_only:
            raise PermissionError("the table is read-only")
        versions = self._versions()
        held = {f.name.rpartition("/")[0] for v in versions[-keep:] for f in self.files(v)}
        for v in versions[:-keep]:
            fs, at = self._at("versions", f"{v}.json")
            fs.delete(at, False)
        fs, at = self._at("data")
        old = [s.getPath() for s in fs.listStatus(at) if f"data/{s.getPath().getName()}" not in held and s.getModificationTime() / 1000 < time.time() - age] if fs.exists(at) else []
        for path in old:
            fs.delete(path, True)
        return len(old)


def updated(bills: DataFrame, updates: DataFrame) -> DataFrame:
    """bills with the columns of updates' bills."""
    new = updates.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in BILL_COLUMNS])
    hit = F.col("_id").isNotNull()
    joined = bills.join(new, F.col("id") == F.col("_id"), "left")
    return joined.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in BILL_COLUMNS else F.col(c) for c in bills.columns])


def _moved(spark: SparkSession, fs, draft, target) -> bool:
    """Whether draft became target; False if there was a target. Of several that try at once, one succeeds."""
    if fs.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        return True
    jvm = spark._jvm
    try:
        # unlike a file system's own rename, this never replaces a file
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
