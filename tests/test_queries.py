import importlib
import sys

import duckdb
import pytest

from tallyforge.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = queries.queries()[name](spark, SF)
    relation = con.sql(queries.oracle_sql()[name])
    columns = sorted(relation.columns)
    assert sorted(got.columns) == columns
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in relation.fetchall())
    assert mine == theirs


def test_entry_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("tallyforge.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "bill_status" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1500
