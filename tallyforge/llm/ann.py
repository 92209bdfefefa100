"""Operator 8: approximate nearest neighbours by inverted lists and adaptive dimension scans.

Largest inner product becomes least Euclidean distance by one more component, sqrt(M^2 - |x|^2) for candidates
(M the largest norm) and 0 for queries. k-means on a bounded, seeded sample gives the lists; every row is put
into its nearest list, and a query probes its nearest lists. In a list, rotated vectors are scanned in blocks of columns, and a candidate
is abandoned once a hypothesis test on its partial distance says that it is beyond the kth. Survivors get their
exact inner product in double precision. A query's 4kth best score in the sample bounds what a list has to return; a query that gets
fewer than k probes every list, without that bound and the test. Lists of more than CELL rows are split, queries of a list likewise, so
that a list with a third of all rows spreads over many tasks.

Rows without an id, null or zero vectors and vectors with null or non-finite components take no part. Vectors
meet only those of their own length. Rows that share a vec_id are candidates each, but ask once (the least
vector), and aren't candidates of their own id. An empty table has no results. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import least_hashed, saved
from tallyforge.llm.vectors import best, part, queries_of, ranked, stacked, usable

K, EVERY = 20, 20
#: Rows that k-means sees, and the most lists; the centroids that go to every executor are bounded by these.
SAMPLE, MOST_LISTS = 16_384, 1024
CELL = 4096
COLUMNS = 16
#: Rows of a list on average, until there are MOST_LISTS; queries scanned at once; candidates scored in full first.
LIST, CHUNK, FIRST = 1024, 256, 400
#: How sure the test is before it abandons: standard deviations of a partial distance.
SURE = 2.1
#: Recall of the lists' probes that is aimed at, and the sampled queries that it is measured with.
RECALL, TRIALS = 0.97, 256


def rotation(width: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, largest**2 - (x**2).sum(axis=1)))])


def centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's k-means on the sample; a list that empties keeps its place."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    d = (c**2).sum(axis=1) - 2 * x @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(axis=1)[:, None]


def probes_for(x: np.ndarray, largest: float, c: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> int:
    """The fewest lists in which sampled queries find that share of their k best in the sample x; where the k best are
    nearer, as in more rows than the sample, they are in fewer lists."""
    q = x[np.random.default_rng(5).permutation(len(x))[:trials]]
    own = nearest(lifted(x, largest), c, 1)[:, 0]
    order = nearest(np.column_stack([q, np.zeros(len(q))]), c, len(c)) if len(c) > 1 else np.zeros((len(q), 1), dtype=np.int64)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    scores = q @ x.T
    scores[scores >= (q * q).sum(axis=1)[:, None] * (1 - 1e-9)] = -np.inf  # the query and its copies
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return int(np.quantile(np.take_along_axis(place, own[top], axis=1), recall, method="higher")) + 1


def sample_bounds(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The 4kth best score of each query among the sample's rows, so that probes that miss some still find k above it; minus infinity in a smaller sample."""
    k *= 4
    out = np.full(len(q), -np.inf)
    for at in range(0, len(q), CHUNK if len(x) >= k else max(1, len(q))):
        if len(x) >= k:
            scores = q[at : at + CHUNK] @ x.T
            scores[own[at : at + CHUNK, None] == ids[None, :]] = -np.inf
            # a little less, as products of matrices round in their own order
            kth = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
            out[at : at + CHUNK] = kth - 1e-9 * (1 + np.abs(kth))
    return out


def adaptive_scan(blocks: list[np.ndarray], q: np.ndarray, radius: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (candidate, query) whose distance may be within the query's radius (squared), by a test after each block of columns; exact: only what is beyond it for sure is abandoned.

    blocks: columns x candidates; q: queries x width. While many pairs are left, a block is one product of matrices over the
    candidates that any query still wants; once few are, it goes on with those pairs alone."""
    width, done = q.shape[1], 0
    rows = np.arange(blocks[0].shape[1])
    partial = np.zeros((len(rows), len(q)))
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for block in blocks:
        own = np.ascontiguousarray(q[:, done : done + len(block)])
        done += len(block)
        slack = 1.0 if exact or done == width else (1 + SURE / np.sqrt(done)) ** 2 * done / width
        limit = radius * slack * (1 + 1e-9) + 1e-9
        if pairs is None:
            x = block[:, rows]
            partial += (x * x).sum(axis=0)[:, None] + (own * own).sum(axis=1)[None, :] - 2 * (x.T @ own.T)
            alive = partial <= limit[None, :]
            partial[~alive] = np.inf
            wanted = alive.any(axis=1)
            rows, partial, alive = rows[wanted], partial[wanted], alive[wanted]
            if done < width and alive.mean() < 0.05 if alive.size else True:
                i, j = np.nonzero(alive)
                pairs, partial = (rows[i], j), partial[i, j]
        else:
            i, j = pairs
            partial += ((block[:, i] - own[j].T) ** 2).sum(axis=0)
            stay = partial <= limit[j]
            pairs, partial = (i[stay], j[stay]), partial[stay]
    if pairs is None:
        i, j = np.nonzero(np.isfinite(partial))
        return rows[i], j
    return pairs


def _cell(k: int, largest: float, exact: bool):
    def run(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        queries, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(candidates) and len(asked):
            x, every = stacked(candidates["embedding"]), stacked(asked["query"])
            ids, own, bound = candidates["vec_id"].to_numpy(), asked["query_id"].to_numpy(), asked["bound"].to_numpy()
            r = rotation(x.shape[1] + 1)
            columns = np.ascontiguousarray((lifted(x, largest) @ r).T)
            blocks = [columns[i : i + COLUMNS] for i in range(0, len(columns), COLUMNS)]
            for at in range(0, len(every), CHUNK):
                q, name, least = every[at : at + CHUNK], own[at : at + CHUNK], bound[at : at + CHUNK]
                # the kth of a first few, scored in full, or of the sample gives the radius of each query
                first = x[:FIRST] @ q.T
                first[ids[:FIRST, None] == name[None, :]] = -np.inf
                kth = np.partition(first, len(first) - k, axis=0)[len(first) - k] if len(first) >= k else np.full(len(q), -np.inf)
                radius = (q * q).sum(axis=1) + largest**2 - 2 * np.maximum(kth, least)
                i, j = adaptive_scan(blocks, np.column_stack([q, np.zeros(len(q))]) @ r, radius, exact)
                other = ids[i] != name[j]
                i, j = i[other], j[other]
                score = np.einsum("ij,ij->i", x[i], q[j])
                order = np.argsort(j, kind="stable")
                i, score = i[order], score[order]
                ends = np.searchsorted(j[order], np.arange(len(q) + 1))
                for n in range(len(q)):
                    mine, s = i[ends[n] : ends[n + 1]], score[ends[n] : ends[n + 1]]
                    top = best(s, ids[mine], k)
                    queries.append(np.full(len(top), name[n]))
                    found.append(ids[mine[top]])
                    scores.append(s[top])
        return pd.DataFrame({"query_id": np.concatenate(queries), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: about the k best candidates of every row whose vec_id is divisible by `every`.

    recall: the share of true neighbours in the sample whose lists are to be probed; the number of probes follows."""
    own = usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    widths = [r.width for r in own.select(F.size("embedding").alias("width")).distinct().collect()]
    found = [_search(own.where(F.size("embedding") == w), k, every, recall) for w in widths]
    if not found:
        return own.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return functools.reduce(DataFrame.unionByName, found)


def _search(own: DataFrame, k: int, every: int, recall: float) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    counted = own.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    sample = least_hashed(own, counted.n, SAMPLE, 3, "vec_id", "embedding").toPandas()
    largest = float(counted.largest)
    lists = min(MOST_LISTS, max(1, counted.n // LIST))
    fit = stacked(sample["embedding"])
    c = centroids(lifted(fit, largest), lists)
    probes = probes_for(fit, largest, c, k, recall)
    shared = own.sparkSession.sparkContext.broadcast((fit, sample["vec_id"].to_numpy()))

    @F.pandas_udf("double")
    def bound_of(id: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(sample_bounds(stacked(e), id.to_numpy(), *shared.value, k)) if len(e) else pd.Series(dtype=float)

    @F.pandas_udf("int")
    def list_of(e: pd.Series) -> pd.Series:
        return pd.Series(nearest(lifted(stacked(e), largest), c, 1)[:, 0].astype("int32")) if len(e) else pd.Series(dtype="int32")

    @F.pandas_udf("array<int>")
    def lists_of(e: pd.Series) -> pd.Series:
        x = stacked(e)
        return pd.Series(list(nearest(np.column_stack([x, np.zeros(len(x))]), c, probes).astype("int32"))) if len(e) else pd.Series(dtype=object)

    # every use of the lists, and a second pass, read what was put once
    put = saved(own.withColumn("list", list_of("embedding")))
    queries = queries_of(own, every)
    asked = queries.withColumn("bound", bound_of("vec_id", "embedding")).withColumn("list", F.explode(lists_of("embedding")))
    found = saved(_probed(put, asked, k, largest))
    # each row is in one list, so it comes once
    of_own_id = own.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("own"))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).join(of_own_id, "query_id").where(F.col("n") >= F.least(F.lit(k), counted.n - F.col("own"))).select(F.col("query_id").alias("vec_id"))
    short = saved(queries.join(full, "vec_id", "left_anti"))
    if not short.limit(1).count():
        return ranked(found, k)
    again = short.withColumn("bound", F.lit(float("-inf"))).withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(c) - 1))))
    rest = _probed(put, again, k, largest, exact=True)
    return ranked(found.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi").unionByName(rest), k)


def _probed(put: DataFrame, asked: DataFrame, k: int, largest: float, exact: bool = False) -> DataFrame:
    """query_id, vec_id, score: what the lists return. put: rows and their list; asked: vec_id, embedding, bound and a list that is probed."""
    # as many rows as there are lists
    sizes = put.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("across"))
    askers = asked.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("down"))
    grid = F.broadcast(sizes.join(askers, "list"))
    left = put.join(grid, "list").withColumn("a", part(F.col("across"), 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    right = asked.join(grid, "list").withColumn("b", part(F.col("down"), 2)).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    right = right.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "bound", F.col("list").alias("at"), F.col("a").alias("qa"), F.col("b").alias("qb"))
    left = left.select("vec_id", "embedding", "list", "a", "b")
    cells = left.groupBy("list", "a", "b").cogroup(right.groupBy("at", "qa", "qb"))
    return cells.applyInPandas(_cell(k, largest, exact), "query_id bigint, vec_id bigint, score double")
