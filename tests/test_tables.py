import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import bills
from tallyforge.schemas import BILLS
from tallyforge.sources import tables
from tallyforge.sources.tables import BillTable, among


def rows_of(spark, numbers, vendor="v"):
    out = []
    for n in numbers:
        h = hashlib.sha256(str(n).encode()).digest()
        out.append((n, h.hex(), bytearray(h), vendor, 1, "EUR", None, None, None, None, "needs_review", None))
    return spark.createDataFrame(out, BILLS)


def on_disk(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def read_rows(df):
    """The rows that the scan of df gave, after row groups and pages were skipped."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """100 files of 300 bills."""
    table = BillTable(spark, str(tmp_path_factory.mktemp("wide") / "t"))
    n = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        text = F.col("id").cast("string")
        empty = spark.createDataFrame([], BILLS)
        made = spark.range(1, 30_001).select(F.col("id").alias("seq"), F.sha2(text, 256).alias("id"), F.unhex(F.sha2(text, 256)).alias("hash"), *[F.lit("needs_review" if f.name == "status" else None).cast(f.dataType).alias(f.name) for f in empty.schema[3:]])
        table.write(made)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", n)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(table.files()) == 100 and sum(f.rows for f in table.files()) == 30_000
    return table


def test_a_probe_skips_row_groups(spark, wide):
    hashes = lambda numbers: spark.createDataFrame([(bytearray(hashlib.sha256(str(n).encode()).digest()),) for n in numbers], "hash binary")
    new = among(wide.read(), "hash", hashes(range(50_000, 51_000)))
    assert read_rows(new) < 0.1 * 30_000 and new.count() == 0
    # what a later tick sees again is what was stored last
    seen = among(wide.read(), "hash", hashes([*range(29_500, 30_000), *range(50_000, 50_500)]))
    assert read_rows(seen) < 0.1 * 30_000 and seen.count() == 500
    one = wide.read().where(F.col("id") == hashlib.sha256(b"77").hexdigest())
    assert read_rows(one) <= 300 and one.count() == 1


def test_a_probe_of_many_keys_is_a_join(spark, wide):
    keys = wide.read().where("seq % 10 = 0").select("hash").unionByName(spark.createDataFrame([(None,)], "hash binary"))
    for most in (10, 100_000):
        assert among(wide.read(), "hash", keys, most).count() == 3000
    assert among(wide.read(), "hash", keys.where("false")).count() == 0


def test_replacing_leaves_other_files(spark, wide, tmp_path):
    import pathlib

    before = {f.name for f in wide.files()}
    old = on_disk(pathlib.Path(wide.path))
    wide.replace(wide.read().where("seq IN (5, 7)").withColumns({"vendor": F.lit("w"), "due": F.lit(None).cast("date")}))
    after = {f.name for f in wide.files()}
    assert len(before - after) == 1 and len(after) == 100
    assert old.items() <= on_disk(pathlib.Path(wide.path)).items()
    got = wide.read()
    assert sorted(r.seq for r in got.where("vendor = 'w'").collect()) == [5, 7] and got.count() == 30_000 == got.select("seq").distinct().count()
    version = wide.version()
    with pytest.raises(LookupError):
        wide.replace(got.where("seq = 5").withColumn("id", F.lit("0" * 64)))
    wide.replace(got.where("false"))
    assert wide.version() == version


def test_replacing_more_bills_than_a_filter_takes(spark, tmp_path):
    table = BillTable(spark, str(tmp_path / "t"))
    table.write(rows_of(spark, range(1, 2 * tables.PROBED + 3)))
    table.replace(table.read().where("seq % 2 = 0").withColumn("vendor", F.lit("w")))
    got = table.read()
    assert got.where("vendor = 'w'").count() == tables.PROBED + 1 == got.where("seq % 2 = 0 AND vendor = 'w'").count()
    assert got.count() == 2 * tables.PROBED + 2 == got.select("id").distinct().count()
    version = table.version()
    with pytest.raises(LookupError):
        table.replace(got.withColumn("id", F.when(F.col("seq") == 1, "0" * 64).otherwise(F.col("id"))))
    assert table.version() == version and sorted(r.vendor for r in table.read().where("seq < 5").collect()) == ["v", "v", "w", "w"]


def test_appends_and_whole_writes(spark, tmp_path):
    table = BillTable(spark, str(tmp_path / "t"))
    assert table.append(rows_of(spark, [1])).count() == 1
    before = on_disk(tmp_path)
    for n in (2, 3):
        table.append(lambda stored, last, n=n: rows_of(spark, [last + 1]).where(F.lit(stored.count() == last == n - 1)))
    assert before.items() <= on_disk(tmp_path).items() and {r.seq for r in table.read().collect()} == {1, 2, 3}
    first = table.version() - 2
    table.write(rows_of(spark, [9]))
    assert [r.seq for r in table.read().collect()] == [9] and table.read(first).count() == 1
    table.append(rows_of(spark, []))
    assert table.read().count() == 1
    with pytest.raises(PermissionError):
        BillTable(spark, table.path, read_only=True).vacuum()


def test_what_did_not_commit_is_not_read(spark, tmp_path):
    table = BillTable(spark, str(tmp_path / "t"))
    table.append(rows_of(spark, [1]))
    table._written(rows_of(spark, [2]))
    assert table.read().count() == 1 and table.vacuum() == 0
    assert table.vacuum(age=0, keep=1) == 1 and table.read().count() == 1


def test_many_small_appends_are_few_files(spark, tmp_path):
    table = BillTable(spark, str(tmp_path / "t"))
    for n in range(1, 31):
        table.append(rows_of(spark, [n]))
    assert len(table.files()) < 10 and sorted(r.seq for r in table.read().collect()) == list(range(1, 31))
    table.vacuum(age=0, keep=1)
    assert table.read().count() == 30 and len(on_disk(tmp_path)) == len(table.files())


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_concurrent_inserts_all_stay(spark, tmp_path, scheme, monkeypatch):
    if scheme == "other":
        # as on stores that aren't mounted: a rename that replaces nothing
        whole = tables._moved

        class Named:
            def getScheme(self):
                return "other"

        monkeypatch.setattr(tables, "_moved", lambda spark, fs, draft, target: whole(spark, Named(), draft, target))
    table, errors = BillTable(spark, str(tmp_path / "t")), []
    order = ["nth"]

    def insert(i):
        try:
            own = rows_of(spark, [i, 100]).withColumn("nth", F.col("seq")).drop("seq")
            table.append(lambda stored, last: bills.insert(stored, own, order, last))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=insert, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = table.read().collect()
    # one of them stored the bill that all had
    assert not errors and sorted(r.seq for r in got) == list(range(1, 8)) and len({r.id for r in got}) == 7


def test_a_merge_and_an_append_at_once(spark, tmp_path):
    table = BillTable(spark, str(tmp_path / "t"))
    for n in range(1, 4):
        table.append(rows_of(spark, [n]))
    publish, late = table._publish, []

    def slow(version, files):
        if not late:
            late.append(version)
            BillTable(spark, table.path).append(rows_of(spark, [4]))
        return publish(version, files)

    table._publish = slow
    table.replace(rows_of(spark, [2], vendor="w").drop("seq"))
    got = {r.seq: r.vendor for r in table.read().collect()}
    assert got == {1: "v", 2: "w", 3: "v", 4: "v"} and len(late) == 1
