"""Operator 1: exact top-k inner products by Fagin's threshold algorithm.

Candidates and queries are dealt into a grid of blocks, and every cell runs the threshold algorithm: each
dimension has a list of the block's vectors in descending contribution, lists are read in growing depths,
vectors met for the first time are scored in full, and reading stops when the sum of the contributions at the
depth reached, which bounds every unseen vector, is below the kth score, or no vector is unseen. A window merges the cells' results.

Components are floor(256 * x). Rows without an id, null vectors and vectors with null or non-finite components
take no part. Vectors meet only those of their own length. Rows that share a vec_id are candidates each, but ask
once (the least vector) and aren't candidates of their own id. Scores beyond a long are cut to it. An empty
table has no results. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.vectors import best, part, queries_of, ranked, stacked, usable

K, EVERY, SCALE = 5, 50, 256
CANDIDATES, QUERIES = 4096, 1024
FIRST_DEPTH = 16


def threshold_search(x: np.ndarray, ids: np.ndarray, order: np.ndarray, q: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best rows of x for q, without those whose id is `own`. order: x's rows ascending in each column."""
    up, down = np.flatnonzero(q < 0), np.flatnonzero(q > 0)
    n = len(x)
    seen = ids == own
    top = np.zeros(0, dtype=np.int64)
    scores = np.zeros(n, dtype=x.dtype)
    depth, step = 0, FIRST_DEPTH
    while depth < n and len(up) + len(down):
        upto = min(n, depth + step)
        fresh = np.zeros(n, dtype=bool)
        # the best contributions stand first in columns that q turns round, last in the others
        fresh[order[depth:upto, up]] = True
        fresh[order[n - upto : n - depth, down]] = True
        fresh &= ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        scores[new] = x.take(new, axis=0) @ q
        pool = np.concatenate([top, new])
        top = pool[best(scores[pool], ids[pool], k)]
        if seen.all():
            break
        if upto < n and len(top) == k:
            bound = (x[order[upto, up], up] * q[up]).sum() + (x[order[n - 1 - upto, down], down] * q[down]).sum()
            if bound < scores[top[-1]]:
                break
        depth, step = upto, step * 2
    if not len(up) + len(down):
        rest = np.flatnonzero(~seen)
        top = rest[best(scores[rest], ids[rest], k)]
    return top


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); as whole numbers of any size where a double could overflow."""
    if not (np.abs(x) > 2.0**900).any():
        return np.floor(SCALE * x)
    return np.frompyfunc(lambda v: int(v) * SCALE if abs(v) >= 2**53 else math.floor(SCALE * v), 1, 1)(x)


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in the smallest kind in which no inner product is rounded: single or double precision, or whole numbers of any size."""
    if x.dtype == object or q.dtype == object:
        return np.frompyfunc(int, 1, 1)(x), np.frompyfunc(int, 1, 1)(q)
    most = x.shape[1] * max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(q).max(initial=0))
    if most < 2**24:
        return x.astype(np.float32), q.astype(np.float32)
    return (x, q) if most < 2**53 else (np.frompyfunc(int, 1, 1)(x), np.frompyfunc(int, 1, 1)(q))


def _cell(k: int):
    def run(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        queries, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(candidates) and len(asked):
            x, q = scaled(stacked(candidates["embedding"])), scaled(stacked(asked["embedding"]))
            ids = candidates["vec_id"].to_numpy()
            order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
            x, q = exact(x, q)
            for own, row in zip(asked["vec_id"].to_numpy(), q, strict=True):
                at = threshold_search(x, ids, order, row, own, k)
                score = x[at] @ row
                if score.dtype == object:
                    score = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in score], dtype=np.int64)
                queries.append(np.full(len(at), own))
                found.append(ids[at])
                scores.append(score.astype(np.int64))
        return pd.DataFrame({"query_id": np.concatenate(queries), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by `every`."""
    own = usable(vectors).withColumn("width", F.size("embedding"))
    counted = own.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    across, down = max(1, -(-counted.n // candidates)), max(1, -(-counted.q // queries))
    left = own.withColumn("a", part(across, 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = queries_of(own, every).withColumn("width", F.size("embedding")).withColumn("b", part(down, 2)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    cells = left.groupBy("a", "b", "width").cogroup(right.groupBy("a", "b", "width"))
    return ranked(cells.applyInPandas(_cell(k), "query_id bigint, vec_id bigint, score bigint"), k)


#: The same rows in DuckDB's SQL.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ordered WHERE rank <= 5
"""
