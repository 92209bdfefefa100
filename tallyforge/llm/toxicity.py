"""Operator 4: toxicity by nearest labelled examples, exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded, seeded sample of the labelled rows that aren't held out, as many of either class as there
are, up to PER_CLASS. Terms are all words of the examples, and their vectors are plain TF-IDF: (1 + log tf) * (log((n + 1) / (df + 1)) + 1), of length one. The index
is sparse: the postings of blocks of BLOCK examples. A
text's blocks are visited in descending bound, which is made of terms' largest weights in a block, and the rest is skipped once the bound is below the kth cosine, so
the neighbours are exact; texts are searched in groups (`Search`). Neighbours vote with weights that fall with distance.

Calibration joins the vote with a second feature, the text's mark: by how much the log odds of any of its words for the toxic class, among the examples, are at most
above SURE standard errors. Logistic regression weighs the vote's log odds and the mark, and isotonic regression turns their sum into a rate; both are fitted on
leave-one-out votes and marks, weighted to the classes' true rates. The vote alone is a column of its own.

Null and empty texts, and texts without a word of any example, get the calibrated rate of such examples. Equal cosines go
to the example earlier in the index. Without examples of both classes every score is the rate of toxic labels,
0 without labels. Repeated rows get a row each; of repeated labels the largest counts, of texts of one labelled doc_id the least. Only text is used for a
score; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import is_held_out, least_hashed, slices, texts

PER_CLASS = 2048
BLOCK = 64
#: Blocks that a text looks at first, and how many times as many each next time: few steps, as each orders the cosines so far.
FIRST, GROWTH = 8, 16
K = 15
THRESHOLD = 0.3
EVIDENCE = 5
#: Standard errors that a word's log odds must exceed to be a mark.
SURE = 2.0
#: Terms of at least one of so many examples are frequent, the most frequent ones if there are more than MATRIX.
FREQUENT, MATRIX = 16, 2048
#: Cosines, and postings of terms that aren't frequent, that are held at a time (one text's at least).
SCORES, POSTINGS = 1 << 20, 1 << 17
_word = re.compile(r"[^\W\d_]+")
#: Each byte of Latin-1, or a blank if it is no part of a word.
_latin = bytes(i if _word.fullmatch(chr(i)) else 0x20 for i in range(256))


def words(text: str) -> list[str]:
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_latin).decode("latin-1").split()
    except UnicodeEncodeError:
        return _word.findall(text)


class Starts:
    """[block, term]: where the postings of a term in a block start; they end where the next term's start."""

    def __init__(self, cells: np.ndarray, offsets: np.ndarray, blocks: int, terms: int) -> None:
        self.cells, self.offsets, self.blocks, self.terms = cells, offsets, blocks, terms

    def __len__(self) -> int:
        return self.blocks

    def __getitem__(self, at: tuple[int, int]) -> int:
        return self.offsets[np.searchsorted(self.cells, at[0] * self.terms + at[1])]


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one range after another, and the number of each one's range."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)


@dataclass
class Index:
    """vocabulary: term -> number; weights: of each term; positions (of the examples) and values: the postings, block by block and term by term in these."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    starts: Starts
    positions: np.ndarray
    values: np.ndarray
    marks: np.ndarray
    #: What the vote's log odds and the mark weigh, and what is added.
    mix: np.ndarray | None = None
    votes: np.ndarray | None = None
    rates: np.ndarray | None = None
    rate: float = 0.0
    none: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "search"}

    @functools.cached_property
    def search(self) -> Search:
        """Made once wherever it is needed, as it isn't sent with the index."""
        return Search(self)

    @property
    def rows(self) -> np.ndarray:
        """The postings' rows in their blocks."""
        return self.positions % BLOCK

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The terms and their weights, of length one."""
        tf = Counter(words(text))
        terms, counts = np.fromiter(map(self.vocabulary.get, tf, repeat(-1)), np.int64, len(tf)), np.fromiter(tf.values(), float, len(tf))
        order = np.argsort(terms)[np.count_nonzero(terms < 0) :]
        terms = terms[order]
        w = (1 + np.log(counts[order])) * self.weights[terms]
        return terms, w / np.sqrt(w @ w) if len(w) else w

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples whose cosine is above zero."""
        return next(self.search.nearest([(terms, weights)], k, [without]))

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """The toxic share of the neighbours, weighted by nearness."""
        w = 1 / (1.05 - np.minimum(cosine, 1.0))
        return float((w @ self.toxic[at] + 0.5) / (w.sum() + 1.0))

    def score(self, terms: np.ndarray, vote: float | None) -> float:
        """The calibrated rate of a text of these terms and this vote, None without neighbours."""
        if self.votes is None:
            return self.rate
        return self.none if vote is None else float(np.interp(features(vote, self.marks[terms].max(initial=0.0)) @ self.mix, self.votes, self.rates))


class Search:
    """The postings in the layouts of the search.

    Postings of frequent terms are a matrix [term, row] for each block, with each term's largest weight in it, as most examples that a text looks at share them;
    those of the others are lists by term. For groups of texts, first the lists are added up. A block's bound is the most that this gave one of its rows and each frequent term's
    largest weight in it. Blocks are visited in descending bound by a product of the texts that need them and the block's matrix, in single precision, and skipped once the bound is
    below the kth cosine. Whatever may be among the k nearest by the rounding's limit gets its cosine in double precision, term by term, so that neither
    rounding nor the group a text is in shows in the result."""

    def __init__(self, index: Index) -> None:
        n, terms, blocks = len(index.ids), len(index.vocabulary), len(index.starts)
        term, row = np.repeat(index.starts.cells % max(1, terms), np.diff(index.starts.offsets)), index.positions.astype(np.int64)
        often, frequent = np.bincount(term, minlength=terms), np.zeros(terms, dtype=bool)
        most = np.argsort(-often, kind="stable")[:MATRIX]
        frequent[most[often[most] * FREQUENT >= n]] = True
        self.terms, self.blocks, self.column = terms, blocks, np.where(frequent, np.cumsum(frequent) - 1, -1)
        at = frequent[term]
        self.dense = np.zeros((blocks, np.count_nonzero(frequent), BLOCK), dtype=np.float32)
        self.dense[row[at] // BLOCK, self.column[term[at]], row[at] % BLOCK] = index.values[at]
        self.largest = np.ascontiguousarray(self.dense.max(axis=2).T)
        # a cosine's terms aren't negative, so each sum is right to this share of itself; skipping compares two sums
        self.slack = 4 * (self.dense.shape[1] + 8) * 2.0**-23
        rare = np.flatnonzero(~at)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.rare_row, self.rare_value, self.rare_start = row[rare], index.values[rare], np.searchsorted(term[rare], np.arange(terms + 1))
        by_row = np.argsort(row, kind="stable")
        self.own_term, self.own_value, self.own_start = term[by_row], index.values[by_row], np.searchsorted(row[by_row], np.arange(n + 1))
        # the first example of the same vector
        first: dict[bytes, int] = {}
        self.same = np.array([first.setdefault(hashlib.sha256(self.own_term[i:j].tobytes() + self.own_value[i:j].tobytes()).digest(), e) for e, (i, j) in enumerate(pairwise(self.own_start))], dtype=np.int64)

    def nearest(self, given: list[tuple[np.ndarray, np.ndarray]], k: int, without: Sequence[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the k nearest examples of each vector, without one of them (or -1)."""
        rows = max(1, SCORES // (self.blocks * BLOCK))
        for at in range(0, len(given), rows):
            yield from self.group(given[at : at + rows], k, None if without is None else np.array(without[at : at + rows]))

    def listed(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """[text, block, row]: what the terms that aren't frequent add to the cosines, some texts at a time, by the postings they have."""
        width, out = self.blocks * BLOCK, np.empty((n, self.blocks, BLOCK), dtype=np.float32)
        used = np.flatnonzero(self.column[terms] < 0)
        of, weights, start, end = of[used], weights[used], self.rare_start[terms[used]], self.rare_start[terms[used] + 1]
        total, begin, low = np.cumsum(np.bincount(of, weights=end - start, minlength=n)), np.searchsorted(of, np.arange(n + 1)), 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + POSTINGS, side="right")))
            own = slice(begin[low], begin[high])
            m = end[own] - start[own]
            place = np.repeat(start[own] - np.cumsum(m) + m, m) + np.arange(m.sum())
            cell = self.rare_row[place] + np.repeat((of[own] - low) * width, m)
            out[low:high] = np.bincount(cell, weights=self.rare_value[place] * np.repeat(weights[own], m), minlength=(high - low) * width).reshape(-1, self.blocks, BLOCK)
            low = high
        return out

    def group(self, given: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(given)
        of, terms, weights = np.repeat(np.arange(n), [len(t) for t, _ in given]), np.concatenate([t for t, _ in given]), np.concatenate([w for _, w in given])
        score = self.listed(of, terms, weights, n)
        flat = score.reshape(n, -1)
        if without is not None:
            left_out = np.flatnonzero(without >= 0)
            flat[left_out, without[left_out]] = -np.inf
        used = self.column[terms] >= 0
        weight = np.zeros((n, self.dense.shape[1]), dtype=np.float32)
        weight[of[used], self.column[terms[used]]] = weights[used]
        bound = score.max(axis=2) + weight @ self.largest
        turn, done, step, least = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1), 0, FIRST, np.zeros((n, 1), dtype=np.float32)
        while done < self.blocks:
            now = (turn >= done) & (turn < done + step) & (bound > 0) & (bound >= least)
            if not now.any():
                break
            for b in np.flatnonzero(now.any(axis=0)):
                needed = np.flatnonzero(now[:, b])
                score[needed, b] += weight[needed] @ self.dense[b]
            done, step = done + step, GROWTH * step
            # a block that wasn't visited has too small sums, which are below its bound
            least = np.maximum(0, np.partition(flat, -k, axis=1)[:, -k, None] * (1 - self.slack)) if k <= flat.shape[1] else least
        text, at = np.nonzero((flat > 0) & (flat >= least))
        cosine = self.cosines(given, text, at)
        best = np.lexsort((at, -cosine, text))
        at, cosine, begin = at[best], cosine[best], np.searchsorted(text, np.arange(n + 1))
        for i, j in pairwise(begin):
            yield at[i : min(j, i + k)], cosine[i : min(j, i + k)]

    def cosines(self, given: list[tuple[np.ndarray, np.ndarray]], text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The cosines of texts (ascending) and examples, one for examples of the same vector."""
        pair, which = np.unique(text * len(self.same) + self.same[at], return_inverse=True)
        example, begin = pair % max(1, len(self.same)), np.searchsorted(pair, np.arange(len(given) + 1) * len(self.same))
        out, weight = np.zeros(len(pair)), np.zeros(self.terms)
        for (terms, weights), (i, j) in zip(given, pairwise(begin), strict=True):
            weight[terms] = weights
            # some at a time, as a text may be as near to many
            for low in range(i, j, BLOCK):
                own = example[low : min(j, low + BLOCK)]
                place, of = ranges(self.own_start[own], self.own_start[own + 1])
                out[low : low + len(own)] = np.bincount(of, weights=self.own_value[place] * weight[self.own_term[place]], minlength=len(own))
            weight[terms] = 0.0
        return out[which]


def features(vote: float, mark: float) -> np.ndarray:
    return np.array([np.log(vote / (1 - vote)), mark, 1.0])


def marked(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By how much the log odds of words in a of n1 toxic and b of n0 other examples exceed SURE standard errors; zero if they don't."""
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    return np.maximum(0.0, odds - SURE * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of x by Newton's method; those of all but the last one aren't negative."""
    w, beta = w / w.sum(), np.zeros(x.shape[1])
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        beta[:] = 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x[:, used].T @ (w * (y - p)) - ridge * beta[used]
            step = np.linalg.solve((x[:, used].T * (w * p * (1 - p))) @ x[:, used] + ridge * np.eye(used.sum()), grad)
            beta[used] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        below = used & (beta < 0) & (np.arange(len(beta)) < len(beta) - 1)
        if not below.any():
            return beta
        used &= ~below


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: block means of x and the non-decreasing fit there."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i] * y[i], w[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    # a little of both outcomes in each pool keeps rates off 0 and 1
    weight = w.mean()
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5 * weight) / (p[1] + weight) for p in pools])


def build(examples: list[tuple[int, int, dict[str, int]]], rate: float) -> Index:
    """examples: (doc_id, toxic, counts of its words); rate: of toxic labels."""
    df, toxic_df = Counter(t for e in examples for t in e[2]), Counter(t for e in examples if e[1] for t in e[2])
    vocabulary = {t: i for i, t in enumerate(sorted(df))}
    n1 = sum(e[1] for e in examples)
    n0 = len(examples) - n1
    both, a = np.array([df[t] for t in vocabulary], dtype=float), np.array([toxic_df[t] for t in vocabulary], dtype=float)
    b = both - a
    weights = np.log((len(examples) + 1) / (both + 1)) + 1
    # like examples stand together, so that a block's bounds are tight
    examples = sorted(examples, key=lambda e: (min(((-(1 + np.log(c)) * weights[vocabulary[t]], t) for t, c in e[2].items()), default=(0.0, "")), e[0]))
    blocks, own = max(1, -(-len(examples) // BLOCK)), []
    for _, _, counts in examples:
        terms = np.array(sorted(vocabulary[t] for t in counts), dtype=np.int64)
        w = (1 + np.log(np.array([c for _, c in sorted((vocabulary[t], c) for t, c in counts.items())], dtype=float))) * weights[terms]
        own.append((terms, w / np.sqrt(w @ w) if len(w) else w))
    examples = [(doc, y) for doc, y, _ in examples]
    term = np.concatenate([np.zeros(0, dtype=np.int64), *(o[0] for o in own)])
    value = np.concatenate([np.zeros(0), *(o[1] for o in own)])
    row = np.repeat(np.arange(len(own)), [len(o[0]) for o in own])
    key = row // BLOCK * len(vocabulary) + term
    order = np.argsort(key, kind="stable")
    cells, first = np.unique(key[order], return_index=True)
    positions, values, offsets = row[order].astype(np.int32), value[order], np.append(first, len(order))
    index = Index(
        vocabulary, weights, np.array([e[0] for e in examples], dtype=np.int64), np.array([e[1] for e in examples], dtype=float), Starts(cells, offsets, blocks, len(vocabulary)), positions, values,
        marked(a, b, n1, n0), rate=rate,
    )
    del df, toxic_df, term, value, row, key, order, first
    if not n1 or not n0 or not vocabulary:
        return index
    share = np.where(index.toxic == 1, rate / n1, (1 - rate) / n0)
    x, without = np.zeros((len(examples), 3)), np.zeros(len(examples), dtype=bool)
    for i, ((_, y), found) in enumerate(zip(examples, index.search.nearest(own, K, range(len(own))), strict=True)):
        without[i] = not len(found[0])
        if not without[i]:
            # the words' counts without this example
            t = own[i][0]
            x[i] = features(index.vote(*found), marked(a[t] - y, b[t] - (1 - y), n1 - y, n0 - (1 - y)).max(initial=0.0))
    if without.any():
        index.none = float((share[without] @ index.toxic[without] + 0.5 * share.mean()) / (share[without].sum() + share.mean()))
    else:
        index.none = rate
    if (~without).any():
        index.mix = logistic(x[~without], index.toxic[~without], share[~without])
        index.votes, index.rates = isotonic(x[~without] @ index.mix, index.toxic[~without], share[~without])
    # the driver searches no more
    del index.search
    return index


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index:
    """The index of a sample of at most per_class rows of either class; only the words and counts of these texts reach the driver."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    counted = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    rate = float(counted.toxic / counted.n) if counted.n else 0.0
    of_class = {1: counted.toxic or 0, 0: counted.n - (counted.toxic or 0)}
    picked = functools.reduce(DataFrame.unionByName, (least_hashed(known.where(F.col("toxic") == y), n, per_class, 11, "doc_id") for y, n in of_class.items()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = [(d, y, t, n) for d, y, text in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), texts(batch), strict=True) for t, n in (Counter(words(text)) or {None: 0}).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "toxic", "term", "n"])

    texts_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    counts: dict[int, dict[str, int]] = {}
    toxic: dict[int, int] = {}
    for r in texts_of.mapInArrow(count, "doc_id bigint, toxic int, term string, n bigint").toArrow().to_batches():
        for doc, y, t, n in zip(*(r.column(i).to_pylist() for i in range(4)), strict=True):
            toxic[doc] = y
            if t is not None:
                counts.setdefault(doc, {})[t] = n
    # build drops the counts before it searches
    return build([(doc, y, counts.pop(doc, {})) for doc, y in sorted(toxic.items())], rate)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, vote (of the neighbours alone, null without any), evidence (ids of the nearest examples) of each row of docs. No shuffle of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in slices(whole):
                given = [index.vector(t) for t in texts(batch)]
                found = [*index.search.nearest(given, K)]
                votes = [index.vote(*f) if len(f[0]) else None for f in found]
                scores = np.array([index.score(v[0], vote) for v, vote in zip(given, votes, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(votes, pa.float64()), pa.array([index.ids[f[0][:EVIDENCE]].tolist() for f in found], pa.list_(pa.int64()))],
                    names=["doc_id", "held_out", "score", "predicted", "vote", "evidence"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", is_held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, vote double, evidence array<bigint>")
