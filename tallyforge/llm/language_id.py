"""Operator 10: language identification by multilingual mixture inference.

Each language is a smoothed distribution over hashed letter trigrams. A document is taken as a mixture of
languages: expectation-maximisation estimates the proportions from the likelihoods of its trigrams, and the
set of languages is the one with the best penalised likelihood.

Null and empty texts, and texts without any letter, are `und` with score 0. Repeated rows get the same answer
each. Without any row to learn from every document is `und`. Ties go to the language that sorts first. Columns
other than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import is_held_out, slices, texts

UNDETERMINED = "und"
#: A language has as many buckets whatever their number: 128 KB each of the model that is sent to every executor.
BUCKET_BITS = 15
#: More values than this in `lang` aren't a set of languages, and are an error; the model has at most 128 MB.
MOST_LANGUAGES = 1024
#: Trigrams x languages that are worked on at once.
CELLS = 1 << 22
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"


@functools.cache
def _fold() -> np.ndarray:
    """Code point -> lower-cased code point of a letter; a blank for all else."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32)


def trigrams(text: str, bits: int) -> np.ndarray:
    """Hashed trigrams whose middle is a letter; words have a blank on both sides."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    s = np.full(len(points) + 2, 32, dtype=np.uint32)
    s[1:-1] = _fold()[points]
    mid = s[1:-1]
    h = s[:-2] * np.uint32(0x9E3779B1) ^ mid * np.uint32(0x85EBCA77) ^ s[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits))[mid != 32]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    bits: int
    probabilities: np.ndarray  # buckets x languages


def train(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """labelled: text, lang. Counts cover every row with a language; tasks pre-aggregate, so the shuffle has at most languages x buckets rows a task."""
    labelled = labelled.where(F.col("lang").isNotNull()).select("text", "lang")
    languages, bits = sorted(r.lang for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()), BUCKET_BITS
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return LanguageModel([], bits, np.zeros((1 << bits, 0), dtype=np.float32))
    at = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole):
                for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                    own = total.setdefault(at[lang], np.zeros(1 << bits, dtype=np.int64))
                    own += np.bincount(trigrams(text, bits), minlength=1 << bits)
        for i, own in total.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(there * len(at) + i), pa.array(own[there])], names=["cell", "n"])

    cells = labelled.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << bits) * len(at))
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(1 << bits, len(at)) + smoothing
    return LanguageModel(languages, bits, (counts / counts.sum(axis=0)).astype(np.float32))


def infer(bags: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, penalty: float = 4.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """bags: (buckets, counts) of documents, none empty. Returns proportions, and single-language log likelihoods.

    The first EM runs over all languages; then sets of its 1, 2, ... leading languages are compared by
    log likelihood - penalty * size * log(trigrams), and a larger set is taken only while that rises."""
    sizes = np.array([len(u) for u, _ in bags])
    starts, doc = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(bags)), sizes)
    n = np.concatenate([c for _, c in bags]).astype(float)
    like = p[np.concatenate([u for u, _ in bags])].astype(float)
    total = np.add.reduceat(n, starts)

    def em(theta: np.ndarray, like: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = like * theta[doc]
            mass = r.sum(axis=1)
            r *= (n / mass)[:, None]
            theta = np.add.reduceat(r, starts) / total[:, None]
        return theta, np.add.reduceat(n * np.log((like * theta[doc]).sum(axis=1)), starts)

    alone = np.add.reduceat(n[:, None] * np.log(like), starts)
    best = np.zeros_like(alone)
    best[np.arange(len(bags)), alone.argmax(axis=1)] = 1.0
    if p.shape[1] == 1:
        return best, alone
    full, _ = em(np.full(alone.shape, 1 / p.shape[1]), like, n, starts, doc, total)
    # the single best language always leads, so that adding a second one is a nested comparison
    rank = np.argsort(-(full + 2 * best), axis=1, kind="stable")
    reached = alone.max(axis=1) - penalty * np.log(total + 1)
    open_ = np.arange(len(bags))
    for k in range(2, p.shape[1] + 1):
        rows = np.isin(doc, open_)
        sub = np.searchsorted(open_, doc[rows])
        lens = sizes[open_]
        theta = np.full((len(open_), p.shape[1]), 0.0)
        np.put_along_axis(theta, rank[open_, :k], 1 / k, axis=1)
        theta, ll = em(theta, like[rows], n[rows], np.concatenate([[0], np.cumsum(lens)[:-1]]), sub, total[open_])
        now = ll - penalty * k * np.log(total[open_] + 1)
        better = now > reached[open_]
        best[open_[better]] = theta[better]
        reached[open_[better]] = now[better]
        open_ = open_[better]
        if not len(open_):
            break
    return best, alone


def portions(bags: list[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The bags in lists of about `most` distinct trigrams."""
    some, load = [], 0
    for bag in bags:
        some.append(bag)
        load += len(bag[0])
        if load >= most:
            yield some
            some, load = [], 0
    if some:
        yield some


def predictor(model: LanguageModel):
    """texts -> (language, score, languages, proportions) of each."""

    def predict(given: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        out: list = [(UNDETERMINED, 0.0, [], [])] * len(given)
        if not model.languages:
            return out
        bags, where = [], []
        for i, text in enumerate(given):
            t = trigrams(text, model.bits)
            if len(t):
                bags.append(np.unique(t, return_counts=True))
                where.append(i)
        if not bags:
            return out
        theta = np.concatenate([infer(some, model.probabilities)[0] for some in portions(bags, max(1, CELLS // len(model.languages)))])
        for i, share in zip(where, theta, strict=True):
            order = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
            out[i] = (model.languages[order[0]], float(min(1.0, share[order[0]])), [model.languages[j] for j in order], [float(share[j]) for j in order])
        return out

    return predict


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, the language set and its proportions. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value)
        for whole in batches:
            for batch in slices(whole):
                got = predict(texts(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.float64()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", is_held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, RESULT)


def learned(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~is_held_out(F.col("doc_id"))))


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they were, that have a language holding at least `least` of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keeps(column):
        import pandas as pd

        predict = predictor(shared.value)
        got: list[bool] = []
        for at in range(0, len(column), 256):
            got += [g[0] != UNDETERMINED and g[1] >= least for g in predict([x or "" for x in column.iloc[at : at + 256]])]
        return pd.Series(got, dtype=bool)

    return docs.where(keeps(F.col("text")))
