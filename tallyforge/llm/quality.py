"""Operator 2: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is one of n-grams of ORDER characters (whole code points, white space as a blank) for each language, so its
alphabet is open and its tables grow with the text. Counts of all texts and of the trusted ones are summed by a shuffle
on the n-gram. The lower orders follow by grouping, and joins by context and by suffix give the probability of every
n-gram that any text has, seen in trusted text or not. The most frequent of these, HEAD at most, are sent to the workers,
which add them up map-side; what else a text has is joined with its shard of the table. As the frequent n-grams are
never shuffled, no shard is hot, at any size.

One of CALIBRATION trusted documents isn't counted but sets the limits: its surplus over its language's median, in
units of sqrt(1/symbols + 1/FLOOR) as short texts scatter more, is cut at the language's quantile times FACTOR.

Null and empty texts have no perplexity and aren't kept. Documents of a language without counted trusted text are scored by
the model of all trusted text, with the largest limit. A language with under FEW calibrating documents has at
least twice the limit of all languages together; without any, and without trusted text at all, every non-empty document is
kept. Rows equal in doc_id, lang and text give one row. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import saved, slices, small, texts

ORDER = 5
#: Rows of the table of frequent n-grams that is sent to every worker, at most: 12 bytes each.
HEAD = 1 << 19
#: N-grams that a worker takes at once, and distinct ones that it gathers before it hands them on.
CHUNK, GATHERED = 1 << 19, 1 << 19
CALIBRATION, FEW, FLOOR = 8, 20, 300
QUANTILE, FACTOR = 0.99, 1.25
MICRO = 1_000_000
_MULTIPLIERS = np.random.default_rng(2).integers(1 << 60, 1 << 63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), "lang", "text")


def mixed(h: np.ndarray, model: np.ndarray | int) -> np.ndarray:
    h = h + np.asarray(model).astype(np.uint64) * _MULTIPLIERS[ORDER]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def summed(points: np.ndarray) -> np.ndarray:
    """For each place of a text's code points, the n-gram that begins there in 64 bits; before mixed() with its model."""
    wide, n = points.astype(np.uint64), max(0, len(points) - ORDER + 1)
    h = wide[:n] * _MULTIPLIERS[0]
    for i in range(1, ORDER):
        h += wide[i : n + i] * _MULTIPLIERS[i]
    return h


def points_of(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams_of(points: np.ndarray) -> list[str]:
    """points: n-grams x ORDER."""
    joined = np.ascontiguousarray(points).tobytes().decode("utf-32-le", "surrogatepass")
    return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values stand together, and where their runs start and the last one ends."""
    order = np.argsort(h)
    ordered = h[order]
    return order, np.append(np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), dtype=bool), ordered[1:] != ordered[:-1]])), len(h))


@dataclass
class Chunk:
    """n-grams: the number of the text of each, where it begins in `points`, and its 64 bits; and the texts that begin here."""

    owner: np.ndarray
    at: np.ndarray
    h: np.ndarray
    points: np.ndarray
    begun: list[int]

    def grams(self, some: np.ndarray) -> np.ndarray:
        return self.points[self.at[some][:, None] + np.arange(ORDER)]


def chunks(given: list[str], model: np.ndarray, size: int = CHUNK) -> Iterator[Chunk]:
    """The n-grams of the texts, about `size` at a time. A text has blanks before it and one after it, so it has one n-gram more than characters; an empty one has none."""

    def made(rows: list[int], pieces: list[str], begun: list[int]) -> Chunk:
        points = points_of(pieces)
        points = np.where((points >= 9) & (points <= 13), np.uint32(32), points)
        lengths = np.array([len(p) for p in pieces])
        grams = lengths - (ORDER - 1)
        at = np.arange(grams.sum()) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(grams) + grams, grams)
        owner = np.repeat(np.array(rows), grams)
        return Chunk(owner, at, mixed(summed(points)[at], model[owner]), points, begun)

    rows, pieces, begun, load = [], [], [], 0
    for row, text in enumerate(given):
        if not text:
            continue
        padded = " " * (ORDER - 1) + text + " "
        begun.append(row)
        for at in range(0, len(text) + 1, size):
            piece = padded[at : at + size + ORDER - 1]
            rows.append(row)
            pieces.append(piece)
            load += len(piece) - ORDER + 1
            if load >= size:
                yield made(rows, pieces, begun)
                rows, pieces, begun, load = [], [], [], 0
    if pieces:
        yield made(rows, pieces, begun)


def counted(docs: DataFrame, models: dict[str, int]) -> DataFrame:
    """model, gram, n, c of every n-gram: how often texts of the model have it, and counted (a boolean column) ones of these. Tasks pre-aggregate."""

    def merged(parts: list[tuple]) -> tuple:
        h, model, points, n, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, ends = runs(h)
        first = order[ends[:-1]]
        return h[first], model[first], points[first], np.add.reduceat(n[order], ends[:-1]), np.add.reduceat(c[order], ends[:-1])

    def out(parts: list[tuple]) -> pa.RecordBatch:
        _, model, points, n, c = merged(parts)
        # in order, which shuffles smaller
        order = np.lexsort((*points.T[::-1], model))
        return pa.RecordBatch.from_arrays([pa.array(model[order], pa.int32()), pa.array(grams_of(points[order]), pa.string()), pa.array(n[order]), pa.array(c[order])], names=["model", "gram", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for whole in batches:
            for batch in slices(whole):
                model = np.array([models.get(x or "", 0) for x in batch.column("lang").to_pylist()], dtype=np.int32)
                counts = batch.column("counted").to_numpy(zero_copy_only=False).astype(np.int64)
                for chunk in chunks(texts(batch), model):
                    order, ends = runs(chunk.h)
                    first = order[ends[:-1]]
                    parts.append((chunk.h[first], model[chunk.owner[first]], chunk.grams(first), np.diff(ends), np.add.reduceat(counts[chunk.owner[order]], ends[:-1])))
                    if sum(len(p[0]) for p in parts) > 2 * GATHERED:
                        parts = [merged(parts)]
                        if len(parts[0][0]) > GATHERED:
                            yield out(parts)
                            parts = []
        if parts:
            yield out(parts)

    tasks = docs.select("text", "lang", "counted").mapInArrow(run, "model int, gram string, n bigint, c bigint")
    return tasks.groupBy("model", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def discounts(level: DataFrame) -> DataFrame:
    """model, d1, d2, d3, seen: the modified Kneser-Ney discounts from the counts of counts (0.75 where these don't exist), and distinct n-grams. A row for each language."""
    rows = []
    for r in level.groupBy("model").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count_if(F.col("c") > 0).alias("seen")).collect():
        n = (0, r.n1, r.n2, r.n3, r.n4)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        rows.append((r.model, *[max(0.01, min(float(i), i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] and n[1] else 0.75 for i in (1, 2, 3)], r.seen))
    return F.broadcast(level.sparkSession.createDataFrame(rows, "model int, d1 double, d2 double, d3 double, seen bigint"))


def probabilities(counts: DataFrame) -> DataFrame:
    """counts: model, gram (of ORDER characters), n, c. Returns model, gram, n, nats: -log p of the last character after the others, in micro-nats.

    Of the lower orders, c is the number of distinct n-grams before it, as Kneser-Ney has it. An n-gram that wasn't seen has c = 0,
    and a context that wasn't seen leaves all to the order below."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = saved(levels[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c")))
    lower = None
    for k, level in sorted(levels.items()):
        d = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = level.join(discounts(level), "model").withColumns({"d": d, "context": F.substring("gram", 1, k - 1)})
        contexts = own.where("c > 0").groupBy("model", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("left"))
        joined = own.join(contexts, ["model", "context"], "left")
        if lower is None:
            joined = joined.withColumn("below", 1 / (F.col("seen") + 1.0))
        else:
            below = lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, ["model", "suffix"])
        p = F.coalesce((F.col("c") - F.col("d")) / F.col("total"), F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("below")
        if k < ORDER:
            lower = saved(joined.select("model", "gram", p.alias("p")))
    return joined.select("model", "gram", "n", F.round(-F.log(p) * MICRO).cast("bigint").alias("nats"))


def head_of(table: DataFrame, most: int) -> Column:
    """Whether an n-gram is among the most frequent; of equal frequency classes all or none, so that there are at most `most`."""
    frequency = F.floor(F.log2("n") * 16)
    sizes = sorted(((r.f, r.rows) for r in table.where("n > 0").groupBy(frequency.alias("f")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, taken = math.inf, 0
    for f, rows in sizes:
        taken += rows
        if taken > most:
            break
        least = f
    return (F.col("n") > 0) & (frequency >= F.lit(float(least)))


def with_models(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """docs (doc_id, text, lang, row_key) with `counted`, whether a text is counted for the model; the languages' models from 1 on. 0 is that of all."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", row_key(docs).alias("row_key"))
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("counted", ~calibrates(F.col("doc_id")))
    marked = keyed.join(small(ids), "doc_id", "left").withColumn("counted", F.coalesce("counted", F.lit(False)) & (F.length("text") > 0))
    languages = sorted(r.lang for r in marked.where("counted").select(F.coalesce("lang", F.lit("")).alias("lang")).distinct().collect())
    return marked, {x: i + 1 for i, x in enumerate(languages)}


def calibrates(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(CALIBRATION)) == 0


def perplexities(docs: DataFrame, trusted: DataFrame, most: int = HEAD) -> tuple[DataFrame, dict[str, int]]:
    """doc_id, row_key, model, symbols, nats (micro-nats a symbol): one row for each distinct non-empty row of docs; and the models."""
    marked, models = with_models(docs, trusted)
    counts = saved(counted(marked, models))
    if counts.where("model = 0").limit(1).count():
        every = counts.groupBy("gram").agg(F.sum(F.when(F.col("model") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum("c").alias("c"))
        counts = saved(counts.where("model > 0").unionByName(every.select(F.lit(0).alias("model"), "gram", "n", "c")))
    table = saved(probabilities(counts))
    is_head = head_of(table, most)
    head = table.where(is_head).select("model", "gram", "nats").toArrow()
    h = mixed(summed(points_of(head.column("gram").to_pylist()))[::ORDER], head.column("model").to_numpy())
    order = np.argsort(h)
    shared = docs.sparkSession.sparkContext.broadcast((h[order], head.column("nats").to_numpy()[order].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cost = shared.value
        for whole in batches:
            for batch in slices(whole):
                model = np.array([models.get(x or "", 0) for x in batch.column("lang").to_pylist()], dtype=np.int32)
                for chunk in chunks(texts(batch), model):
                    order, ends = runs(chunk.h)
                    distinct = chunk.h[order[ends[:-1]]]
                    at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                    found = known[at] == distinct if len(known) else np.zeros(len(distinct), dtype=bool)
                    times, owner = np.diff(ends), chunk.owner[order]
                    nats = np.bincount(owner, np.repeat(np.where(found, cost[at], 0) if len(known) else found, times))
                    symbols = np.bincount(owner)
                    rows = np.flatnonzero(symbols)
                    # n-grams that aren't known here, once for each text
                    missed = np.flatnonzero(np.repeat(~found, times))
                    pair = np.repeat(np.arange(len(distinct)), times)[missed] * len(symbols) + owner[missed]
                    by, starts = runs(pair)
                    rare = order[missed[by[starts[:-1]]]]
                    row, none = np.concatenate([rows, chunk.owner[rare]]), np.zeros(len(rare), dtype=np.int64)
                    columns = {
                        "doc_id": batch.column("doc_id").take(pa.array(row)), "row_key": batch.column("row_key").take(pa.array(row)), "model": pa.array(model[row]), "copies": pa.array(np.concatenate([np.isin(rows, chunk.begun).astype(np.int64), none])),
                        "symbols": pa.array(np.concatenate([symbols[rows], none])), "nats": pa.array(np.concatenate([nats[rows].astype(np.int64), none])), "gram": pa.array([None] * len(rows) + grams_of(chunk.grams(rare)), pa.string()), "n": pa.array(np.concatenate([rows * 0, np.diff(starts)])),
                    }
                    yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    parts = saved(marked.select("doc_id", "text", "lang", "row_key").mapInArrow(run, "doc_id bigint, row_key bigint, model int, copies bigint, symbols bigint, nats bigint, gram string, n bigint"))
    rest = table.where("n > 0").where(~is_head).select("model", "gram", F.col("nats").alias("cost"))
    rare = parts.where("gram IS NOT NULL").join(rest, ["model", "gram"]).withColumn("nats", F.col("n") * F.col("cost"))
    names = ["doc_id", "row_key", "model", "copies", "symbols", "nats"]
    sums = parts.where("gram IS NULL").select(*names).unionByName(rare.select(*names)).groupBy("doc_id", "row_key", "model").agg(*[F.sum(c).alias(c) for c in names[3:]])
    # repeated rows were added up
    return sums.select("doc_id", "row_key", "model", F.expr("symbols div copies").alias("symbols"), F.expr("nats div symbols").alias("nats")), models


def quantiles(bins: DataFrame, share: float) -> dict[int, tuple[float, int]]:
    """bins: model, bin, of each calibrating document. (the bin that holds the quantile, documents) of each model; -1 is all of them. As many rows as bins reach the driver."""
    found: dict[int, list[tuple[int, int]]] = {}
    for r in bins.groupBy("model", "bin").agg(F.count("*").alias("n")).collect():
        for model in (r.model, -1):
            found.setdefault(model, []).append((r.bin, r.n))
    out = {}
    for model, pairs in found.items():
        total, upto = sum(n for _, n in pairs), 0
        for b, n in sorted(pairs):
            upto += n
            if upto >= share * total:
                out[model] = (float(b), total)
                break
    return out


def surplus(median: Column) -> Column:
    """How far a text's nats a symbol are above the median, in units of its scatter."""
    return (F.col("nats") / MICRO - median) / F.sqrt(1 / F.col("symbols") + 1 / F.lit(float(FLOOR)))


def thresholds(scores: DataFrame, trusted: DataFrame, models: dict[str, int], quantile: float = QUANTILE, factor: float = FACTOR) -> DataFrame:
    """model, median (nats a symbol), most (the largest surplus that is kept): a row for each model that has limits."""
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    given = saved(scores.join(small(ids.where(calibrates(F.col("doc_id")))), "doc_id", "left_semi").where("model > 0"))
    medians = {m: b / 1000 for m, (b, _) in quantiles(given.select("model", F.expr("nats div 1000").alias("bin")), 0.5).items() if m > 0}
    if not medians:
        return scores.sparkSession.createDataFrame([], "model int, median double, most double")
    rows = scores.sparkSession.createDataFrame(list(medians.items()), "model int, median double")
    ends = quantiles(given.join(F.broadcast(rows), "model").select("model", F.floor(F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), surplus(F.col("median")))) * 100).alias("bin")), quantile)
    every = ends[-1][0]
    limits = []
    for m, median in medians.items():
        b, n = ends[m]
        limits.append((m, median, factor * (b + 1) / 100 if n >= FEW else max(factor * (b + 1) / 100, 2 * factor * (every + 1) / 100, 1.0)))
    limits.append((0, max(x[1] for x in limits), max(x[2] for x in limits)))
    return scores.sparkSession.createDataFrame(limits, "model int, median double, most double")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, factor: float = FACTOR, most: int = HEAD) -> DataFrame:
    """doc_id, row_key, symbols, perplexity, threshold (of the perplexity), keep: one row for each distinct row of docs.

    trusted: doc_id of the trusted documents. quantile: of the trusted surplus in a language, which is multiplied by factor; most: rows of
    the table that is sent to the workers."""
    scores, models = perplexities(docs, trusted, most)
    scores = saved(scores)
    # as many rows as there are languages
    limits = F.broadcast(thresholds(scores, trusted, models, quantile, factor))
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(docs).alias("row_key")).distinct()
    joined = every.alias("e").join(scores.alias("s"), F.expr("e.doc_id <=> s.doc_id AND e.row_key = s.row_key"), "left").join(limits, "model", "left")
    threshold = F.col("median") + F.col("most") * F.sqrt(1 / F.col("symbols") + 1 / F.lit(float(FLOOR)))
    kept = F.when(F.col("nats").isNull(), False).otherwise(F.coalesce(surplus(F.col("median")) <= F.col("most"), F.lit(True)))
    return joined.select(F.col("e.doc_id").alias("doc_id"), F.col("e.row_key").alias("row_key"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.exp(F.col("nats") / MICRO).alias("perplexity"), F.exp(threshold).alias("threshold"), kept.alias("keep"))


def accepted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they were, that classify() keeps."""
    kept = classify(docs, trusted).where("keep").select(F.col("doc_id").alias("_kept_id"), F.col("row_key").alias("_kept_key"))
    keyed = docs.withColumn("_row_key", row_key(docs))
    return keyed.join(kept, F.expr("_row_key = _kept_key AND doc_id <=> _kept_id"), "left_semi").drop("_row_key")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")
