"""Operator 12: compressed vector codes; codebooks of every part by Lloyd's rounds with Hamerly's bounds.

A vector's components become whole numbers, floor(SCALE * x), and it is cut into PARTS consecutive parts. A part's codebook starts as that part of the ENTRIES
rows of the least vec_id. A round assigns every part to the nearest entry (ties: the lower index) and moves every entry to the floor of its parts' mean.

Each part of each row keeps two bounds from round to round: an upper one of its distance to its own entry and a lower one of that to any other. When entries
have moved, the bounds move with them. A part whose upper bound is strictly below its lower one, or below half of its entry's distance to the nearest other
entry, keeps its entry unseen; where that fails, the upper bound is made tight, and where it fails again, all entries are scanned in whole numbers. Bounds are
rounded outwards, so a part that is skipped has one nearest entry and no tie, and what is scanned takes the lower index.

Rows, codes and bounds are a table in the shared folder for each round, which the next one replaces; of a round's rows, counts and sums of each entry alone are
brought together (PARTS * ENTRIES rows at most), so that neither size nor a common code or label makes a task larger.

Rows whose vector is null or holds null or non-finite components are dropped. Rows without a vec_id are kept and come last in the order; rows that share one
follow the order of their vectors. Vectors of different lengths have codebooks of their own, each from its length's rows (a pass for each length); lengths that
PARTS doesn't divide are cut as evenly as can be. With fewer rows than ENTRIES there are as many entries as rows. Whole numbers beyond 2^62 count as 2^62, and an
error beyond a long is the largest long. Without a label column all labels are null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_by_key, saved, slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FAR = 2**62
LONG = 2**63 - 1
#: Components below this have squared distances that fit into 64 bits, for parts of up to 512 components.
PLAIN = 2**26
#: Bounds are widened by this share, far more than what their arithmetic loses.
OUT, IN = 1 + 2.0**-40, 1 - 2.0**-40
STATE = "vec binary, code binary, upper binary, lower binary"


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of v to c (a row, or a row for each), as whole numbers: 64 bits where they fit, else of any size."""
    if v.shape[1] > 512 or max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) >= PLAIN:
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(axis=1)


def scan(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row of v (ties: the lower index), its squared distance and the second least one (infinite if there is no other)."""
    best, at, second = squared(v, book[0]), np.zeros(len(v), dtype=np.uint8), np.full(len(v), np.inf)
    for j in range(1, len(book)):
        d = squared(v, book[j])
        nearer = d < best
        second = np.minimum(second, np.where(nearer, best, d).astype(float))
        at[nearer], best = j, np.where(nearer, d, best)
    return at, best, second


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(d, dtype=float))


def halves(book: np.ndarray) -> np.ndarray:
    """Half of each entry's distance to the nearest other one."""
    return np.array([IN / 2 * root(squared(np.delete(book, j, 0), c)).min(initial=np.inf) for j, c in enumerate(book)])


def moved(code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after each entry has moved by moves: by its own entry's, and by the largest of the others'."""
    order = np.argsort(-moves, kind="stable")
    most = np.where(code == order[0], moves[order[1]] if len(moves) > 1 else 0.0, moves[order[0]])
    return (upper + moves[code]) * OUT, lower - most * OUT - np.abs(lower) * (1 - IN)


def assign(v: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Assigns rows of v to entries, in place; returns how many were scanned."""
    safe = np.maximum(lower, halves(book)[code])
    open_ = np.flatnonzero(~(upper < safe))
    if len(open_):
        upper[open_] = root(squared(v[open_], book[code[open_]])) * OUT
        open_ = open_[~(upper[open_] < safe[open_])]
    if len(open_):
        code[open_], best, second = scan(v[open_], book)
        upper[open_], lower[open_] = root(best) * OUT, root(second) * IN
    return len(open_)


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, all of one length, as whole numbers."""
    x = np.array(batch.column("embedding").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -FAR, FAR).astype(np.int64)


def _matrix(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(batch.num_rows, -1).copy()


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _rest(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("vec", "code", "upper", "lower", "embedding")]


def started(rows: DataFrame, parts: int) -> DataFrame:
    """rows with their whole numbers, and bounds that say nothing yet."""
    names = _rest(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4096):
                n = batch.num_rows
                made = [_binary(_whole(batch)), _binary(np.zeros((n, parts), dtype=np.uint8)), _binary(np.full((n, parts), np.inf)), _binary(np.full((n, parts), -np.inf))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "vec", "code", "upper", "lower"])

    schema = rows.select(names).schema
    for field in STATE.split(", "):
        schema = schema.add(field.split()[0], "binary")
    return rows.mapInArrow(run, schema)


def assigned(state: DataFrame, books: list[np.ndarray], moves: list[np.ndarray] | None, error: bool = False) -> DataFrame:
    """state with codes for these codebooks; moves: how far each entry went since the state's were made. error: gives code and error instead of the state."""
    names = _rest(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4096):
                vec, code = _matrix(batch, "vec", "<i8"), _matrix(batch, "code", "u1")
                upper, lower = _matrix(batch, "upper", "<f8"), _matrix(batch, "lower", "<f8")
                total = np.zeros(batch.num_rows, dtype=object)
                for p, (s, e) in enumerate(cuts(vec.shape[1], len(books))):
                    v, c, u, low = vec[:, s:e], code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    if moves is not None:
                        u, low = moved(c, u, low, moves[p])
                    assign(v, books[p], c, u, low)
                    code[:, p], upper[:, p], lower[:, p] = c, u, low
                    if error:
                        total += squared(v, books[p][c]).astype(object)
                kept = [*(batch.column(c) for c in names)]
                if error:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([min(LONG, int(t)) for t in total], pa.int64())], names=[*names, "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, batch.column("vec"), _binary(code), _binary(upper), _binary(lower)], names=[*names, "vec", "code", "upper", "lower"])

    schema = state.select(names).schema.add("code", "string").add("error", "long") if error else state.schema
    return state.mapInArrow(run, schema)


def sums(state: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry: the number of its parts, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        totals = [np.zeros(b.shape, dtype=object) for b in books]
        for whole in batches:
            for batch in slices(whole, 4096):
                vec, code = _matrix(batch, "vec", "<i8"), _matrix(batch, "code", "u1")
                if np.abs(vec).max(initial=0) >= 2**50:
                    vec = vec.astype(object)
                for p, (s, e) in enumerate(cuts(vec.shape[1], len(books))):
                    counts[p] += np.bincount(code[:, p], minlength=len(books[p]))
                    for j in np.unique(code[:, p]).tolist():
                        totals[p][j] = totals[p][j] + vec[code[:, p] == j, s:e].sum(axis=0).astype(object)
        rows = [(p, j, i, int(counts[p][j]), Decimal(int(x))) for p in range(len(books)) for j in np.flatnonzero(counts[p]).tolist() for i, x in enumerate(totals[p][j])]
        part, entry, at, n, total = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["part", "entry", "at", "n", "total"])

    found = state.select("vec", "code").mapInArrow(run, "part int, entry int, at int, n bigint, total decimal(38,0)")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("part", "entry", "at").collect():
        out.setdefault((r.part, r.entry), (r.n, []))[1].append(int(r.total))
    return out


def learned(state: DataFrame, first: np.ndarray, parts: int, rounds: int) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray] | None]:
    """The last round's table, the codebooks after it, and how far its entries went. first: the rows that the codebooks start as."""
    books, moves = [first[:, s:e] for s, e in cuts(first.shape[1], parts)], None
    scratch = Scratch(state.sparkSession)
    for _ in range(rounds):
        before, state = state, scratch.saved(assigned(state, books, moves))
        scratch.release(before)
        after = [b.copy() for b in books]
        for (p, j), (n, total) in sums(state, books).items():
            after[p][j] = [t // n for t in total]
        moves = [root([squared(a[j : j + 1], b[j])[0] for j in range(len(a))]) * OUT for a, b in zip(after, books, strict=True)]
        books = after
    return state, books, moves


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of vectors (vec_id, embedding, label)."""
    e = F.col("embedding").cast("array<double>")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), e.alias("embedding")).where(F.coalesce(F.col("embedding").isNotNull() & finite, F.lit(False)))
    coded = None
    for width in sorted(r.width for r in rows.select(F.size("embedding").alias("width")).distinct().collect()):
        some = rows.where(F.size("embedding") == width)
        first = some.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow().to_batches()
        first = np.concatenate([_whole(b) for b in first])
        state, books, moves = learned(started(some, parts), first, parts, rounds)
        digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
        out = assigned(state, books, moves, error=True).withColumn("codebooks_sha256", F.lit(digest))
        coded = out if coded is None else coded.unionByName(out)
    if coded is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    # labels as text, null apart from any text
    coded = saved(coded.withColumn("key", F.struct(F.col("label").cast("string").alias("label"))))
    total = saved(coded.groupBy("key").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LONG))).cast("bigint").alias("label_error")))
    return join_by_key(coded, total, "key").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same rows for tables whose vectors have one length, a multiple of PARTS."""
    steps = [f"""kept AS MATERIALIZED (
    SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v, row_number() OVER (ORDER BY vec_id, embedding) AS rn
    FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
cut AS MATERIALIZED (
    SELECT rn, p, v[CAST(p * len(v) // {PARTS} + 1 AS BIGINT):CAST((p + 1) * len(v) // {PARTS} AS BIGINT)] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS MATERIALIZED (SELECT p, rn - 1 AS e, v FROM cut WHERE rn <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT rn, p, min({{'d': d, 'e': e}}) AS m
    FROM (SELECT rn, p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(c.v, b.v)]) AS d FROM cut c JOIN book{r} b USING (p)) GROUP BY rn, p)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM book{r} b LEFT JOIN (
        SELECT p, e, list(q ORDER BY i) AS v
        FROM (SELECT p, e, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q
            FROM (SELECT c.p, m.e AS e, unnest(c.v) AS x, unnest(range(len(c.v))) AS i FROM cut c JOIN near{r} USING (rn, p)) GROUP BY p, e, i)
        GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""")
    return "WITH " + ",\n".join(steps) + f""",
coded AS (SELECT rn, string_agg(lower(lpad(hex(m.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY rn)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM book{ROUNDS})) AS codebooks_sha256
FROM kept JOIN coded USING (rn)"""


CODES_SQL = _sql()
