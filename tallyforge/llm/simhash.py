"""Operator 6: near-duplicate groups by SimHash fingerprints compared bit-sliced.

A fingerprint has 64 bits, or more for texts that differ more. Fingerprints are collapsed to distinct ones first, so copies
cost nothing after the shuffle that counts them. Candidates share a bucket of one of several tables:

* within a radius of 2 of 64 bits (`Exact`), two fingerprints agree in 2 of 4 bands of 16 bits at least, so that the 6 pairs of bands lose no link;
* for a similarity of shingle sets (`Similar`), the radius is the number of bits in which sets of that similarity differ on average and three standard
  deviations more, and a table is a seeded choice of bits: as many bits as keep a bucket small whatever the number of fingerprints, as many tables as make two
  sets of that similarity meet with the given probability. What lies within the radius is a candidate only: `neighbours` verifies the similarity on whole sets.

For `Exact`, buckets of more than CELL fingerprints are split into parts and every pair of parts is one cell, so a task's cell is bounded whatever the
bucket. In a cell the candidates stand vertically, 64 to a word in bit planes; carry-save counters add the differing bits of 64 candidates at a
time, and words whose candidates all exceed the radius are abandoned. What is linked to a cell's first fingerprint isn't compared among itself,
as it is connected already. A cell returns a spanning forest of its links, and components are found over all.

Null and empty texts have fingerprint zero and are linked as any other. Rows with a null doc_id get the
component of their fingerprint's other rows, or null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tallyforge.llm.common import WORD, join_by_key, saved, slices, small, texts
from tallyforge.llm.components import components, forest
from tallyforge.llm.neighbours import bucketed, linked, nodes_of, sketched, with_hubs

SEED = 42
#: Fingerprints of a part of a bucket; a cell has two parts at most.
CELL = 1024
_word = re.compile(WORD)
_lower = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Exact:
    """Shingles with their repeats; all links within 2 of 64 bits."""

    shingle: int = 3
    radius: int = 2
    bands: int = 4

    def keys(self, fp: np.ndarray) -> np.ndarray:
        width = 64 // self.bands
        masks = [sum(((1 << width) - 1) << band * width for band in pair) for pair in itertools.combinations(range(self.bands), self.bands - self.radius)]
        return (fp[:, :1] & np.array(masks, dtype=np.uint64)[None, :]).view(np.int64)


@dataclass(frozen=True)
class Similar:
    """Sets of shingles; links of sets whose similarity (Jaccard), as 64 * words bits tell it, is at least `similarity`."""

    shingle: int = 5
    words: int = 4
    similar: int = 80
    #: The probability that two sets of just that similarity share a bucket, and the number of fingerprints.
    found: float = 0.99
    n: int = 1

    @property
    def size(self) -> int:
        return 8 * self.words

    @property
    def share(self) -> float:
        """Of the bits, how many differ on average: the angle between two sets over a half turn."""
        return math.acos(2 * self.similar / (100 + self.similar)) / math.pi

    @property
    def radius(self) -> int:
        bits = 64 * self.words
        return math.ceil(bits * self.share + 3 * math.sqrt(bits * self.share * (1 - self.share)))

    @property
    def tables(self) -> tuple[int, int]:
        """Bits of a table's key, and the number of tables."""
        bits = min(48, max(16, math.ceil(math.log2(max(2, self.n))) - 2))
        return bits, math.ceil(math.log(1 - self.found) / math.log(1 - (1 - self.share) ** bits))

    def sketch(self, hashes: np.ndarray) -> bytes:
        return bits_of(hashes, self.words).tobytes()

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        bits, tables = self.tables
        set_ = np.unpackbits(sketches, axis=1, bitorder="little").astype(np.int64)
        rng, out = np.random.default_rng(SEED), np.zeros((len(sketches), tables), dtype=np.int64)
        for t in range(tables):
            for i in rng.permutation(64 * self.words)[:bits].tolist():
                out[:, t] = out[:, t] << 1 | set_[:, i]
        # tables of one number of bits share their keys' values, so the table goes into the key
        return out * np.int64(-7046029254386353131) + np.arange(tables) * np.int64(0x2545F4914F6CDD1D)

    def likely(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= self.radius

    def pairs(self, sketches: np.ndarray, sizes: np.ndarray, component: np.ndarray, ask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the bit-sliced comparison of those that ask with all of their cell."""
        words = sketches.view("<u8").astype(np.uint64)
        i, j = close_pairs(np.split(words, ends[:-1]), self.radius, ask)
        fits = ~ask[j] & (component[i] != component[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= self.similar * np.maximum(sizes[i], sizes[j]))
        return i[fits], j[fits]


def more_words(h: np.ndarray, words: int) -> np.ndarray:
    """The hashes (n x 1), and others made from each."""
    out = [h]
    for i in range(1, words):
        x = h + np.uint64(0x9E3779B97F4A7C15 * i % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.column_stack(out)


def fingerprint(text: str, kind: Exact = Exact()) -> np.ndarray:
    """64 bits; each is 1 if set in more than half of the shingles' hashes."""
    words = [w.encode("utf-8", "surrogatepass") for w in _word.findall(text.translate(_lower) if not text.isascii() else text.lower())]
    if not words:
        return np.zeros(1, dtype=np.uint64)
    joined, size = b" ".join(words), min(kind.shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return bits_of(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype="<u8"))


def bits_of(hashes: np.ndarray, words: int = 1, step: int = 1 << 15) -> np.ndarray:
    """`words` x 64 bits; each is 1 if set in more than half of the hashes, or others made from them."""
    total = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), step):
        some = more_words(hashes[at : at + step].astype("<u8"), words)
        total += np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, kind: Exact = Exact()) -> DataFrame:
    """doc_id, fp (its bytes, largest first) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fp = [fingerprint(t, kind).astype(">u8").tobytes() for t in texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp binary")


def words_of(fp: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(fp.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words)


def added(counters: list[np.ndarray], over: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """Adds bit planes of equal weight to vertical counters by carry-save adders; returns `over` with what the counters can't hold."""
    for level in range(len(counters)):
        sum_, carries = counters[level], []
        while len(planes) > 1:
            a, b = planes.pop(), planes.pop()
            both = a ^ b
            carries.append((a & b) | (both & sum_))
            sum_ = both ^ sum_
        if planes:
            a = planes.pop()
            carries.append(a & sum_)
            sum_ = a ^ sum_
        counters[level], planes = sum_, carries
        if not planes:
            return over
    for p in planes:
        over = over | p
    return over


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters are above the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal = equal & counters[level]
        else:
            above = above | (equal & counters[level])
            equal = equal & ~counters[level]
    return above


def close_pairs(groups: list[np.ndarray], radius: int, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (over the groups one after another) of fingerprints (n x words) of one group that differ in at most `radius` bits. asks: which fingerprints are
    compared with all of their group; without it, each pair comes once."""
    sizes = np.array([len(g) for g in groups])
    words_in = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words_in)[:-1]])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n, n_words, width = int(sizes.sum()), int(words_in.sum()), groups[0].shape[1]
    fp = np.concatenate(groups).astype(np.uint64)
    group = np.repeat(np.arange(len(groups)), sizes)
    lane = np.arange(n) - first[group] + 64 * first_word[group]
    lanes = np.zeros((64 * n_words, width), dtype=np.uint64)
    lanes[lane] = fp
    empty = np.ones(64 * n_words, dtype=bool)
    empty[lane] = False
    owner = np.zeros(64 * n_words, dtype=np.int64)
    owner[lane] = np.arange(n)
    void = np.packbits(empty, bitorder="little").view(np.uint64)
    own_word, bit_of = lane // 64, (lane % 64).astype(np.uint64)
    start = own_word if asks is None else first_word[group]
    who = np.arange(n) if asks is None else np.flatnonzero(asks)
    meets = (words_in[group] - (start - first_word[group]))[who]
    query = np.repeat(who, meets)
    word = np.arange(len(query)) - np.repeat(np.cumsum(meets) - meets, meets) + start[query]
    one = np.uint64(1)
    # not the query itself, nor in its own word those before it
    skipped = (one << bit_of[query]) if asks is not None else (np.uint64(2) << bit_of[query]) - one
    over = void[word] | np.where(word == own_word[query], skipped, np.uint64(0))
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(radius.bit_length())]
    full = ~np.uint64(0)
    for at in range(0, 64 * width, 8):
        planes = []
        for b in range(at, at + 8):
            plane = np.packbits((lanes[:, b // 64] >> np.uint64(b % 64)).astype(np.uint8) & 1, bitorder="little").view(np.uint64)
            planes.append(plane[word] ^ (np.uint64(0) - ((fp[query, b // 64] >> np.uint64(b % 64)) & one)))
        over = added(counters, over, planes)
        over |= beyond(counters, radius)
        open_ = over != full
        if not open_.all():
            query, word, over, counters = query[open_], word[open_], over[open_], [c[open_] for c in counters]
            if not len(query):
                return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    row, bit = np.nonzero(near)
    return query[row], owner[word[row] * 64 + bit]


def connecting(groups: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect what all such pairs connect: those of each group's first, and all of what isn't linked to it."""
    sizes = np.array([len(g) for g in groups])
    firsts = np.zeros(sizes.sum(), dtype=bool)
    firsts[np.cumsum(sizes) - sizes] = True
    i, j = close_pairs(groups, radius, firsts)
    rest = ~firsts
    rest[j] = False
    if not rest.any():
        return i, j
    more_i, more_j = close_pairs(groups, radius, rest)
    return np.concatenate([i, more_i]), np.concatenate([j, more_j])


def links(reps: DataFrame, kind: Exact = Exact(), cell: int = CELL) -> DataFrame:
    """reps: fp, rep (distinct fp, an id of each). Returns a, b: links of ids that connect whatever lies within the radius."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4096):
                keys = kind.keys(words_of(batch.column("fp"), 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("rep"), lists], names=["fp", "rep", "buckets"])

    tabled = saved(reps.select("fp", F.col("rep").cast("bigint").alias("rep")).mapInArrow(keyed, "fp binary, rep bigint, buckets array<bigint>"))
    bucketed = tabled.select("fp", "rep", F.posexplode("buckets").alias("table", "bucket"))
    # a row for `cell` candidates and more; the others aren't split
    large = tabled.select(F.posexplode("buckets").alias("table", "bucket")).groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = small(saved(large.select(F.col("table").alias("t"), F.col("bucket").alias("k"), F.ceil(F.col("n") / cell).cast("int").alias("of"))))
    met = bucketed.join(large, (F.col("table") == F.col("t")) & (F.col("bucket") == F.col("k")), "left").withColumn("parts", F.coalesce("of", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    celled = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("table", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "rep")
    cells = celled.groupBy("table", "bucket", "low", "high").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).where(F.size("members") > 1).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fps: list[np.ndarray], reps: list[np.ndarray]) -> pa.RecordBatch:
            a, b = forest(np.concatenate(reps), *connecting(fps, kind.radius)) if fps else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            column = batch.column("members")
            flat, at = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            fp, rep = words_of(flat.field("fp"), 1), flat.field("rep").to_numpy(zero_copy_only=False)
            fps, reps_, load = [], [], 0
            for s, e in itertools.pairwise(at.tolist()):
                fps.append(fp[s:e])
                reps_.append(rep[s:e])
                load += (e - s) * (1 + (e - s) // 64)
                if load > 100_000:
                    yield linked(fps, reps_)
                    fps, reps_, load = [], [], 0
            yield linked(fps, reps_)

    return cells.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, kind: Exact = Exact()) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs."""
    marked = saved(fingerprints(docs, kind))
    known = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(links(known.where("rep IS NOT NULL"), kind))
    classes = known.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
    return join_by_key(marked, saved(classes), "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_in_buckets(nodes: DataFrame, kind: Similar, cell: int = CELL) -> DataFrame:
    """key, node, hub of the nodes that have another one within the radius in their bucket, by the bit-sliced comparison of all nodes of each bucket in cells. Buckets are coarse,
    so most of their nodes are there by chance."""
    tabled = bucketed(nodes, kind)
    large = tabled.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = saved(large.select("key", F.ceil(F.col("n") / cell).cast("int").alias("of")))
    met = tabled.select("node", "sketch", F.explode("keys").alias("key")).join(small(large, 100_000), "key", "left").withColumn("parts", F.coalesce("of", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    celled = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "sketch")
    cells = celled.groupBy("key", "low", "high").agg(F.collect_list(F.struct("node", "sketch")).alias("members")).where(F.size("members") > 1).select("key", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat, sizes = column.flatten(), np.diff(ends, prepend=0)
            # cells are compared together until they have so many words of candidates
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes * (1 + sizes // 64)) // 25_000, prepend=-1)) if len(sizes) else []
            for first, last in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                start = ends[first - 1] if first else 0
                own = flat.slice(start, ends[last - 1] - start)
                words = np.frombuffer(b"".join(own.field("sketch").to_pylist()), dtype="<u8").astype(np.uint64).reshape(-1, kind.words)
                at = np.unique(np.concatenate(close_pairs(np.split(words, ends[first : last - 1] - start), kind.radius)))
                of = np.searchsorted(ends[first:last] - start, at, side="right") + first
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), own.field("node").take(pa.array(at))], names=["key", "node"])

    return with_hubs(saved(cells.mapInArrow(run, "key bigint, node bigint").distinct()))


def first_of_groups(docs: DataFrame, kind: Similar = Similar()) -> DataFrame:
    """One row of docs for each group of documents that are linked by a similarity of their sets of shingles, all columns as they were: that of the least doc_id, any
    id before none, then of the least hash of the row. Texts without a word are one group.

    Groups are of texts, whatever the doc_ids: rows without one, or of one doc_id with texts that aren't linked, stay for each group. Equal rows are one before the
    shuffle; rows are told apart by two hashes of all columns, 128 bits."""
    kind = replace(kind, n=docs.count())
    # hashes aren't made of maps, but of their sorted entries
    plain = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name) for f in docs.schema]
    key = ["_first_hash", "_second_hash"]
    keyed = docs.withColumns({key[0]: F.xxhash64(*plain), key[1]: F.xxhash64(F.lit(SEED), *reversed(plain))})
    marked = saved(sketched(keyed, kind, *key))
    nodes = nodes_of(marked, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)).alias("first"))
    grouped = nodes.join(linked(docs, nodes, kind, near_in_buckets(nodes, kind)), "node", "left")
    first = grouped.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select(*(F.col(f"first.{k}").alias(k) for k in key))
    # the rows' key is the join's, so the texts are shuffled once
    return keyed.dropDuplicates(key).join(first, key, "left_semi").select(*docs.columns)
