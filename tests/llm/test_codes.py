import hashlib

import duckdb
import numpy as np
import pytest

from tallyforge.llm import codes
from tallyforge.llm.queries import op12_codes

SCHEMA = "vec_id bigint, embedding array<double>, label string, code string, error string, upper string, key string"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: vec_id, whole numbers, label; Lloyd's rounds in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    cut = [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]
    books = [[r[1][s:e] for r in rows[:entries]] for s, e in cut]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def near(v, book):
        return min((square(v, c), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p, (s, e) in enumerate(cut):
            got = [near(r[1][s:e], books[p])[1] for r in rows]
            for j in set(got):
                mine = [r[1][s:e] for r, g in zip(rows, got, strict=True) if g == j]
                books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for r in rows:
        found = [near(r[1][s:e], books[p]) for p, (s, e) in enumerate(cut)]
        out.append((r[0], "".join(f"{j:02x}" for _, j in found), min(2**63 - 1, sum(d for d, _ in found)), r[2], digest))
    return out


def with_labels(found):
    total = {}
    for f in found:
        total[f[3]] = total.get(f[3], 0) + f[2]
    return [(f[0], f[1], f[2], min(2**63 - 1, total[f[3]]), f[4]) for f in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def whole(v):
    return [min(max(int(np.floor(np.float64(x) * 4096)), -(2**62)), 2**62) for x in v]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    made = [(i, (rng.integers(-3, 4, 16) / 64).tolist(), "ab"[i % 2]) for i in range(300)]  # few values, so many ties
    made += [(5, made[5][1], None), (5, made[6][1], None), (None, made[7][1], "a"), (3, made[3][1], "b"), (400, made[1][1], "null")]
    return made


def test_codes_equal_plain_rounds(spark, rows):
    bad = [(1, None, "a"), (2, [None] * 16, "a"), (3, [float("nan")] * 16, "b"), (4, [float("inf")] + [0.0] * 15, "b")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows + bad], SCHEMA).repartition(5)
    assert ordered(codes.encode(df).collect()) == ordered(with_labels(brute([(i, whole(v), x) for i, v, x in rows])))


def test_lengths_and_sizes_of_vectors(spark, rows):
    some = [(i, v, None) for i, v, _ in rows[:40]]
    short = [(1000 + i, [float(i), 2.0, 0.5], None) for i in range(6)]  # fewer parts than PARTS and rows than ENTRIES
    large = [(2000 + i, [1e300 * (-1) ** i, float(2**40 * i), -0.3 * i, *[0.1] * 6], None) for i in range(20)]
    empty = [(3000, [], None)]
    df = spark.createDataFrame(some + short + large + empty, "vec_id bigint, embedding array<double>, label int")
    expected = []
    for group in (some, short, large, empty):
        expected += brute([(i, whole(v), x) for i, v, x in group])
    assert ordered(codes.encode(df).collect()) == ordered(with_labels(expected))


def test_no_rows(spark, rows):
    df = spark.createDataFrame([], SCHEMA)
    assert codes.encode(df).collect() == [] and codes.encode(df.drop("label")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_skip_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    v = (rng.integers(0, 6, (4000, 1)) * 5000 + rng.integers(-400, 400, (4000, 4))).astype(np.int64)
    book = v[:8].copy()
    code, upper, lower = np.zeros(len(v), dtype=np.uint8), np.full(len(v), np.inf), np.full(len(v), -np.inf)
    scanned = []
    for _ in range(6):
        scanned.append(codes.assign(v, book, code, upper, lower))
        assert (code == codes.scan(v, book)[0]).all()
        after = book.copy()
        for j in np.unique(code):
            after[j] = v[code == j].sum(axis=0) // (code == j).sum()
        moves = codes.root(codes.squared(after, book)) * codes.OUT
        book = after
        upper, lower = codes.moved(code, upper, lower, moves)
    assert scanned[0] > 0.9 * len(v) and scanned[-1] < len(v) / 2


def test_a_tie_takes_the_lower_index():
    book = np.array([[0, 0], [10, 0], [0, 0]])
    code, upper, lower = np.full(2, 2, dtype=np.uint8), np.zeros(2), np.zeros(2)
    codes.assign(np.array([[5, 0], [0, 0]]), book, code, upper, lower)
    assert code.tolist() == [0, 0]


def test_codes_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert ordered(op12_codes(spark, sf).collect()) == ordered(con.sql(codes.CODES_SQL).fetchall())
