import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ann, topk
from tallyforge.llm.common import least_hashed

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, score string, list string, a string, query string"


def brute(rows, k, every, score):
    out = []
    for query in {i for i, _ in rows if i % every == 0}:
        own = min(v for i, v in rows if i == query)
        found = sorted(((-score(own, v), i) for i, v in rows if i != query and len(v) == len(own)))[:k]
        out += [(query, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, rows[1][1]) for i in range(100)] + [(50, rows[3][1]), (100, [0.0] * 8), (600, [1.0, 2.0]), (650, [3.0, -1.0])]
    bad = [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x", "x") for i, v in rows + bad], SCHEMA), rows


def whole(a, b):
    f = lambda v: [int(np.floor(256 * float(x))) for x in v]
    return sum(x * y for x, y in zip(f(a), f(b), strict=True))


@pytest.mark.parametrize("blocks", [(2048, 1024), (37, 3)])
def test_threshold_search_equals_brute_force(vectors, blocks):
    df, rows = vectors
    got = sorted(map(tuple, topk.search(df, candidates=blocks[0], queries=blocks[1]).collect()))
    assert got == brute(rows, 5, 50, whole)


def test_threshold_search_stops_early():
    x = np.zeros((4096, 4))
    x[:, 0] = np.arange(4096)
    order = np.argsort(x, axis=0, kind="stable")
    reads = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            reads.append(np.size(at[0]) if isinstance(at, tuple) else np.size(at))
            return np.asarray(super().__getitem__(at))

    top = topk.threshold_search(x.view(Counting), np.arange(4096), order, np.array([1.0, 0, 0, 0]), -1, 5)
    assert top.tolist() == [4095, 4094, 4093, 4092, 4091] and sum(reads) < 200


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**40)
    df = spark.createDataFrame([(0, [big, 1.0]), (1, [big, 3.0]), (2, [big, 2.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.search(df).collect()]
    assert [g[2] for g in sorted(got)] == [1, 2]


def test_components_that_overflow_when_scaled_are_exact(spark):
    rows = [(0, [1.5e308, 1.0]), (1, [-1.5e308, 2.0]), (2, [1e307, -3.0]), (3, [0.5, 0.5]), (50, [-1e306, 0.25])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    floor = lambda v: [int(x) * 256 if abs(x) > 2**53 else int(np.floor(256 * x)) for x in v]
    cut = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    assert got == brute(rows, 5, 50, lambda a, b: cut(sum(x * y for x, y in zip(floor(a), floor(b), strict=True))))


def test_threshold_search_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, topk.search(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()))
    assert got == sorted(con.sql(topk.TOPK_SQL).fetchall())


def test_empty_tables(vectors):
    df, _ = vectors
    assert topk.search(df.where("false")).count() == 0
    assert ann.search(df.where("false")).count() == 0


def test_neighbours_of_edge_rows(vectors):
    df, rows = vectors
    got = sorted(map(tuple, ann.search(df, k=5, every=50, recall=1.0).collect()))
    usable = [(i, v) for i, v in rows if any(v)]
    expected = brute(usable, 5, 50, lambda a, b: float(np.dot(a, b)))
    assert {g[0] for g in got} == {e[0] for e in expected}
    found = {(g[0], g[2]) for g in got}
    assert np.mean([(e[0], e[2]) in found for e in expected]) >= 0.9
    exact = {(q, i): float(np.dot(np.array(dict(usable)[q], dtype=float), np.array(v, dtype=float))) for q in {g[0] for g in got} for i, v in usable if q != 50 and len(v) == len(dict(usable)[q])}
    assert all(abs(exact[g[0], g[2]] - g[3]) < 1e-9 for g in got if g[0] != 50 and g[2] != 50)


def test_rows_of_one_id_are_neighbours_each(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(29, [50.0, 1.0]), (20, [40.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=40, recall=1.0).collect())
    assert got == brute(rows, 40, 20, lambda a, b: float(np.dot(a, b)))


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    got = ann.search(spark.read.parquet(path)).toPandas()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}'").df()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    recall = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)] if (np.diff(ids) > 0).all() else mine.score)
        recall.append(np.isin(ids[np.lexsort((ids, -s))[:20]], mine.vec_id).mean())
    assert np.mean(recall) >= 0.9


def found_share(df, x, got, every):
    got = got.toPandas()
    hit = []
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -np.inf
        mine = got[got.query_id == q]
        assert sorted(mine["rank"]) == list(range(1, 21))
        hit.append(np.isin(np.lexsort((np.arange(len(x)), -s))[:20], mine.vec_id).mean())
    return np.mean(hit)


def table_of(spark, n, width=16):
    x = np.random.default_rng(6).standard_normal((n, width))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>"), x


@pytest.mark.parametrize(("size", "sample", "width"), [(1000, 4096, 16), (400, 2048, 16), (1000, 4096, 64)])
def test_recall_of_the_probed_lists_beyond_the_sample(spark, monkeypatch, size, sample, width):
    monkeypatch.setattr(ann, "LIST", size)
    monkeypatch.setattr(ann, "SAMPLE", sample)
    df, x = table_of(spark, 50_000, width)
    share = found_share(df, x, ann.search(df, every=1000), 1000)
    print("recall", size, sample, width, share)
    assert share >= 0.9


def test_recall_is_that_of_the_lists_even_if_the_sample_is_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 100)
    monkeypatch.setattr(ann, "probes_for", lambda *a: 2)
    df, x = table_of(spark, 3000)
    assert found_share(df, x, ann.search(df, every=100), 100) < 0.99


@pytest.mark.parametrize("share", [20, 400])
def test_an_abandoned_candidate_is_beyond_the_radius(share):
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 65)), rng.standard_normal((7, 65))
    d = ((x[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    radius = np.sort(d, axis=0)[share]
    columns = np.ascontiguousarray(x.T)
    i, j = ann.adaptive_scan([columns[n : n + 16] for n in range(0, 65, 16)], q, radius)
    assert (d[i, j] <= radius[j] * (1 + 1e-6)).all() and len(i) >= 0.9 * 7 * share and len(set(zip(i, j))) == len(i)


def test_the_rows_of_the_least_hash_are_the_same_without_ordering_all(spark):
    df = spark.range(20_000).selectExpr("id AS vec_id", "array(cast(id AS double)) AS embedding")
    hashed = F.xxhash64("vec_id", "embedding", F.lit(3))
    expected = {r.vec_id for r in df.orderBy(hashed).limit(500).collect()}
    got = least_hashed(df, 20_000, 500, 3, "vec_id", "embedding")
    assert {r.vec_id for r in got.collect()} == expected
    assert least_hashed(df, 20_000, 30_000, 3, "vec_id").count() == 20_000 and least_hashed(df.where("false"), 0, 5, 3, "vec_id").count() == 0
