"""Operator 11: near-duplicate groups by SetSketch registers, banded, estimated jointly and verified on whole sets.

A document's set is that of its shingles of words (hashes of 64 bits). A sketch has registers of one byte: the least of the set's values of an exponential
distribution, as the number of the step between powers of BASE that it falls into, cut off at both ends. Sketches of parts of a set merge by the larger
register, and registers of two sets are equal the oftener the more similar they are, nearly with the probability of their Jaccard similarity.

* Registers stand in bands, and sets with an equal band share a bucket. A band has as many registers as keep sets of similarity UNLIKE from
  meeting by chance, whatever their number, and there are as many bands as make two sets at the limit miss each other with a probability of
  LOST at most.
* Of a pair, the likelihood of how many registers are larger in either and how many are equal, given both sizes, has one maximum in the similarity. Pairs whose
  estimate is more than DEVIATIONS standard deviations below the limit are left.
* The others are verified on whole sets; `neighbours` says how pairs are found in buckets of any size.

Null texts and texts without a word have an empty set, and are linked with nothing; fewer words than a shingle are one shingle. Rows with a null doc_id get
their group's component_id, or null, and aren't kept. Rows that share a doc_id have each their text's group. Columns other than doc_id and text are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import join_by_key, saved
from tallyforge.llm.neighbours import SEED, between, linked, nodes_of, sketched

BASE, RATE, TOP = 1.1, 20.0, 255
UNLIKE, LOST, DEVIATIONS = 0.1, 1e-6, 5.0


@dataclass(frozen=True)
class SetSketch:
    """Words of a shingle, the least similarity of a link in hundredths, registers of a band, and bands."""

    shingle: int
    similar: int
    width: int
    bands: int

    @property
    def size(self) -> int:
        return self.width * self.bands

    @property
    def bound(self) -> float:
        """The least estimate that is verified."""
        s = self.similar / 100
        return s - DEVIATIONS * math.sqrt(s * (1 - s) / self.size)

    def sketch(self, hashes: np.ndarray) -> bytes:
        return registers(hashes, self.size).tobytes()

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """A key of 64 bits for each band."""
        rng = np.random.default_rng(SEED + 1)
        weight = rng.integers(0, 2**63, (self.bands, self.width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        key = (sketches.reshape(len(sketches), self.bands, self.width).astype(np.uint64) * weight).sum(axis=2, dtype=np.uint64) + rng.integers(0, 2**63, self.bands, dtype=np.uint64)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (key ^ (key >> np.uint64(29))).view(np.int64)

    def likely(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        more, less = np.count_nonzero(a > b, axis=1), np.count_nonzero(a < b, axis=1)
        # the likelihood has one maximum, so its slope at the bound tells on which side the estimate is
        return slope(np.full(len(more), self.bound), more, less, self.size - more - less, n_a / (n_a + n_b), n_b / (n_a + n_b)) >= 0

    def pairs(self, sketches: np.ndarray, sizes: np.ndarray, component: np.ndarray, ask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for i, j in between(sizes, component, ask, ends, self.similar):
            close = self.likely(sketches[i], sketches[j], sizes[i], sizes[j])
            out.append((i[close], j[close]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def kind_for(n: int, shingle: int = 5, similar: int = 80) -> SetSketch:
    """Bands for n sets."""
    width = max(4, math.ceil(math.log(max(2, n)) / math.log(1 / UNLIKE)))
    bands = math.ceil(math.log(LOST) / math.log(1 - (similar / 100) ** width)) if similar < 100 else 1
    return SetSketch(shingle, similar, width, bands)


@functools.cache
def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def registers(h: np.ndarray, n: int, step: int = 1024) -> np.ndarray:
    """n registers of a set of hashes: the steps of the least values."""
    times, plus = _constants(n)
    least, low = np.full(n, 2**32 - 1, dtype=np.uint32), (h ^ (h >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), step):
        np.minimum(least, (np.multiply.outer(times, low[at : at + step]) + plus[:, None]).min(axis=1), out=least)
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype(np.uint8)


def slope(j: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The derivative of the log-likelihood at similarity j: falling, and zero at the estimate. more, less, equal: numbers of registers of the first set compared with
    the second's; u, v: the sets' shares of the sum of their sizes."""
    c, log = (BASE - 1) / BASE, math.log(BASE)

    def larger(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability that a register is larger, for a share x of values in one set only, and its derivative."""
        x = np.maximum(x, 1e-9)
        return -np.log1p(-x * c) / log, c / (log * (1 - x * c))

    p, dp = larger(u - v * j)
    q, dq = larger(v - u * j)
    return -more * v * dp / p - less * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-12)


def estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by bisection."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        mid = (low + high) / 2
        up = slope(mid, more, less, equal, u, v) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def near_duplicates(docs: DataFrame, shingle: int = 5, similar: int = 80, kind: SetSketch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs. Documents are linked whose sets of `shingle` words have a similarity of `similar` hundredths or more."""
    kind = kind or kind_for(docs.count(), shingle, similar)
    marked = saved(sketched(docs, kind))
    nodes = nodes_of(marked.where("n_shingles > 0"), F.min("doc_id").alias("least"))
    labelled = saved(nodes.join(linked(docs, nodes, kind), "node", "left").select("digest", "n", "least", F.coalesce("component", "node").alias("component")))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = saved(join_by_key(labelled.withColumnRenamed("n", "copies"), saved(least), "component").select("digest", "component_id", F.col("copies").alias("n")))
    found = join_by_key(marked.where("n_shingles > 0").select("doc_id", "n_shingles", "digest"), classes, "digest").select("doc_id", "n_shingles", "component_id")
    alone = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
