"""Operator 13: alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

A text's tokens by A (a byte-level tokenizers file) and by B (a sentencepiece model) are laid over the bytes of space + text. Where tokens of both end, a group
ends and the two tokens that end there are linked. A link's pair of ids is one whole number, B's id in the upper 32 bits, so that the pairs of one B id stand
together. Each partition counts its pairs by np.unique over sorted numbers; the partial counts are range-partitioned and sorted over all, and summed by run
lengths. Each range becomes a shard, a sorted file of numbers and one of counts, in the shared folder. The look-up maps the shards that its documents'
numbers fall into (np.memmap) and finds them by np.searchsorted: no pair of a document is shuffled. Where the shared folder isn't a
mounted file system, shards stay a table, which is joined with each document's distinct pairs.

What is sent to all workers is the list of shards, and the highest count of each id of B: at most as many as its vocabulary.

A text that is null or empty, or whose tokens' bytes aren't those of space + text (as where it holds the character that stands for a space in B), has no tokens:
zeros, and an empty groups_sha256. Repeated rows count each and give a row each; rows without a doc_id too. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, join_by_key, saved, slices, texts
from tallyforge.llm.pretokens import BYTES, CACHE, CACHED_LENGTH, PreTokenEncoder

SPACE = "▁"
#: Distinct pairs that a partition holds before it gives its counts away and starts anew.
HELD = 1 << 20
SHARD = "name string, first bigint, pairs bigint, tops array<struct<b:bigint,top:bigint>>"


class PieceEncoder:
    """Ids of whole texts by a sentencepiece model, word by word, with a cache.

    No piece of the vocabulary goes on after a word with a space, so each run of spaces with what follows it is encoded on its own; where a model
    has such pieces, or changes texts before it encodes them, texts are encoded whole."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) or self.library.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        probe = " a  b   c "
        self.splits = SPACE in pieces and not any(SPACE in p[1:] and p.strip(SPACE) for p in pieces) and b"".join(self.bytes[i] for i in self.library.encode(probe)) == (" " + probe).encode()
        self.space = np.array([self.library.piece_to_id(SPACE)], dtype="<u4").tobytes()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, num_threads=1), dtype="<u4").tobytes()

    def _missed(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            # the library puts a space before it, unless it is empty
            found = self.whole(word[1:]) if word != " " else self.space
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE // 2:
                self.older, self.cache = self.cache, {}
            self.cache[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text or not self.splits or SPACE in text:
            return np.frombuffer(self.whole(text), dtype="<u4")
        words = _word.findall(" " + text)
        got = [*map(self.cache.get, words)]
        for at in [i for i, v in enumerate(got) if v is None] if None in got else ():
            got[at] = self._missed(words[at])
        return np.frombuffer(b"".join(got), dtype="<u4")


_word = re.compile(" +[^ ]*")


class Aligner:
    """Both tokenizers of one worker, the bytes of their tokens, and how ids are written in groups."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = PreTokenEncoder(a, lambda ids: np.array(ids, dtype="<u4").tobytes()), PieceEncoder(b)
        self.a.special = {}  # their strings in a text are plain text
        self.a.library.encode_special_tokens = True
        of = {chr(c): byte for byte, c in BYTES.items()}
        with open(a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        size = 1 + max(vocabulary.values(), default=-1)
        self.a_bytes, self.b_bytes = [b""] * size, self.b.bytes
        for token, i in vocabulary.items():
            if all(c in of for c in token):
                self.a_bytes[i] = bytes(of[c] for c in token)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.size = size
        self.written = [f"{i}{end}" for end, n in ((",", size), ("|", size), (",", len(self.b_bytes)), (";", len(self.b_bytes))) for i in range(n)]

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B, and the positions in them that end together; None where there are no tokens."""
        if not text:
            return None
        whole = (" " + text).encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return None
        a = np.frombuffer(b"".join(self.a.values(" " + text)), dtype="<u4")
        if a.max(initial=0) >= self.size or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole:
            return None
        ends_a, ends_b = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        at = np.searchsorted(ends_b, ends_a)
        together = ends_b[at] == ends_a
        return a, b, np.stack([np.flatnonzero(together), at[together]])

    def groups(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3"""
        n_a, n_b = np.diff(ends[0] + 1, prepend=0), np.diff(ends[1] + 1, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[ends[0]] = last_b[ends[1]] = True
        out = np.empty(len(a) + len(b), dtype=np.int64)
        # before a token of A stand B's of earlier groups, before one of B A's of its own group too
        out[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = a + np.where(last_a, self.size, 0)
        out[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = b + 2 * self.size + np.where(last_b, len(self.b_bytes), 0)
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


@functools.cache
def aligner(a: str, b: str) -> Aligner:
    """One for each worker process, kept between its tasks."""
    return Aligner(a, b)


def packed(x: np.ndarray, kind: str) -> bytes:
    """Whole numbers as the planes of their bytes, compressed."""
    by = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(by.T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and each document's distinct pairs (sorted differences) with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a, b)
        for whole in batches:
            for batch in slices(whole, 64):
                rows = []
                for text in texts(batch):
                    found = made.align(text)
                    if found is None:
                        rows.append((0, 0, 0, 0, "", packed(np.zeros(0), "<i8"), packed(np.zeros(0), "<i4")))
                        continue
                    ids_a, ids_b, ends = found
                    pairs, n = np.unique(ids_b[ends[1]].astype(np.int64) << 32 | ids_a[ends[0]].astype(np.int64), return_counts=True)
                    digest = hashlib.sha256(made.groups(*found).encode()).hexdigest()
                    rows.append((len(ids_a), len(ids_b), ends.shape[1], ends.shape[1], digest, packed(np.diff(pairs, prepend=0), "<i8"), packed(n, "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True))], names=["doc_id", *(f.name for f in fields)])

    fields = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("counts", pa.binary())])
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, counts binary")


def summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal numbers as one."""
    pairs, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(total, at, n)
    return pairs, total


def partial_counts(marked: DataFrame, held: int = HELD) -> DataFrame:
    """pair, n: one row for each pair of a partition, or several where it has more than `held` pairs."""

    def batch_of(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole):
                new = [np.cumsum(unpacked(x, "<i8")) for x in batch.column("pairs").to_pylist()]
                counts = [unpacked(x, "<i4") for x in batch.column("counts").to_pylist()]
                pairs, n = summed(np.concatenate([pairs, *new]), np.concatenate([n, *counts]))
                if len(pairs) > held:
                    yield batch_of(pairs, n)
                    pairs, n = pairs[:0], n[:0]
        yield batch_of(pairs, n)

    return marked.where("n_links > 0").select("pairs", "counts").mapInArrow(run, "pair bigint, n bigint")


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted numbers and their counts, equal ones as one, also across batches."""
    last, open_ = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pairs, n = batch.column("pair").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
        pairs, n = pairs[starts], np.add.reduceat(n, starts)
        if pairs[0] == last:
            n[0] += open_
        elif last is not None:
            pairs, n = np.insert(pairs, 0, last), np.insert(n, 0, open_)
        last, open_ = pairs[-1], n[-1]
        yield pairs[:-1], n[:-1]
    if last is not None:
        yield np.array([last]), np.array([open_])


def mounted(folder: str) -> str | None:
    """The folder's path where it is on a mounted file system."""
    return folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:") if folder.startswith("file:/") else folder if folder.startswith("/") else None


def shards(partial: DataFrame, folder: str) -> DataFrame:
    """Sorts and sums the partial counts and writes each range's numbers and counts to `folder`; returns name, first, pairs, tops: a row for each shard."""
    n = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, size = f"{folder}/{uuid.uuid4().hex}", None, 0
        tops_b, tops = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        with open(f"{name}.pairs", "wb") as keys, open(f"{name}.counts", "wb") as counts:
            for pairs, total in run_lengths(batches):
                if not len(pairs):
                    continue
                first = int(pairs[0]) if first is None else first
                size += len(pairs)
                keys.write(pairs.astype("<i8").tobytes())
                counts.write(total.astype("<i8").tobytes())
                b, starts = np.unique(pairs >> 32, return_index=True)
                tops_b, tops = np.concatenate([tops_b, b]), np.concatenate([tops, np.maximum.reduceat(total, starts)])
        if size:
            # an attempt's own files; only those that its committed row names are read
            yield pa.RecordBatch.from_pylist([{"name": os.path.basename(name), "first": first, "pairs": size, "tops": [{"b": x, "top": y} for x, y in zip(tops_b.tolist(), tops.tolist(), strict=True)]}], schema=schema)

    schema = pa.schema([("name", pa.string()), ("first", pa.int64()), ("pairs", pa.int64()), ("tops", pa.list_(pa.struct([("b", pa.int64()), ("top", pa.int64())])))])
    return partial.repartitionByRange(n, "pair").sortWithinPartitions("pair").mapInArrow(run, SHARD)


class CountLookup:
    """Counts of pairs from the shards, mapped into memory when they are first asked for."""

    def __init__(self, folder: str, names: list[str], first: np.ndarray) -> None:
        self.folder, self.names, self.first = folder, names, first
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.maps:
            self.maps[i] = tuple(np.memmap(f"{self.folder}/{self.names[i]}.{kind}", dtype="<i8", mode="r") for kind in ("pairs", "counts"))
        return self.maps[i]

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """pairs: sorted, all of them in the shards."""
        out = np.zeros(len(pairs), dtype=np.int64)
        own = np.searchsorted(self.first, pairs, side="right") - 1
        for i in np.unique(own).tolist():
            keys, n = self.shard(i)
            s, e = np.searchsorted(own, i), np.searchsorted(own, i, side="right")
            out[s:e] = n[np.searchsorted(keys, pairs[s:e])]
        return out


def looked_up(marked: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """marked with n_best and count_sum, from the shards that index lists."""
    spark = marked.sparkSession
    listed = index.select("name", "first").orderBy("first").collect()
    best = index.select(F.explode("tops").alias("t")).groupBy("t.b").agg(F.max("t.top").alias("top")).collect()
    top = np.zeros(1 + max((r.b for r in best), default=0), dtype=np.int64)
    for r in best:
        top[r.b] = r.top
    sent = spark.sparkContext.broadcast(([r.name for r in listed], np.array([r.first for r in listed], dtype=np.int64), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, highest = sent.value
        lookup = CountLookup(folder, names, first)
        for whole in batches:
            for batch in slices(whole):
                given = [(np.cumsum(unpacked(p, "<i8")), unpacked(c, "<i4").astype(np.int64)) for p, c in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
                distinct, at = np.unique(np.concatenate([p for p, _ in given]), return_inverse=True)
                n = lookup.counts(distinct)
                is_best = n == highest[distinct >> 32] if len(distinct) else np.zeros(0, dtype=bool)
                ends = np.cumsum([0] + [len(p) for p, _ in given])
                n_best, total = [], []
                for i, (_, c) in enumerate(given):
                    mine = at[ends[i] : ends[i + 1]]
                    n_best.append(int(c[is_best[mine]].sum()))
                    total.append(int((c * n[mine]).sum()))
                kept = [batch.column(c) for c in names_kept]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*names_kept, "n_best", "count_sum"])

    names_kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return marked.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")


def joined(marked: DataFrame, counts: DataFrame) -> DataFrame:
    """The same as `looked_up` where shards can't be mapped: each document's distinct pairs are joined with counts (pair, n)."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                p = [np.cumsum(unpacked(x, "<i8")) for x in batch.column("pairs").to_pylist()]
                c = [unpacked(x, "<i4").astype(np.int64) for x in batch.column("counts").to_pylist()]
                row = np.repeat(batch.column("row").to_numpy(), [len(x) for x in p])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(p)), pa.array(np.concatenate(c))], names=["row", "pair", "times"])

    marked = saved(marked.withColumn("row", F.monotonically_increasing_id()))
    b = F.shiftright("pair", 32)
    # a row for each id of B
    top = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("n").alias("top")))
    known = saved(counts.withColumn("b", b).join(top, "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best")))
    held = marked.select("row", "pairs", "counts").mapInArrow(pairs_of, "row bigint, pair bigint, times bigint")
    of = held.groupBy("pair").agg(F.count("*").alias("n"))
    found = join_by_key(held, saved(known.join(of, "pair")), "pair")
    total = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return marked.drop("pairs", "counts").join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row of docs. a: a byte-level tokenizers file; b: a sentencepiece model."""
    marked = saved(aligned(docs, a, b))
    partial = saved(partial_counts(marked))
    folder = Scratch(docs.sparkSession).root
    path = mounted(folder)
    if path is None:
        return joined(marked, saved(partial.groupBy("pair").agg(F.sum("n").alias("n"))))
    os.makedirs(path, exist_ok=True)
    return looked_up(marked, saved(shards(partial, path)), path)
