"""Pairs of similar sets of shingles, from sketches to links that were verified on whole sets: what operators 6 and 11 share.

A `Kind` says how a set is sketched, which buckets a sketch falls into and which pairs of sketches are likely to be similar. Documents of equal sets are one node.
First each bucket's nodes are paired with its least one, and likely pairs are verified: their sets are made anew from a text of each and compared whole. That joins most
of a group. Then buckets that still hold nodes of several components are searched for what it has missed: the nodes outside a bucket's largest component meet all of the
bucket in cells of bounded size. Nodes with a likely partner in another component stay, and in a second pass their cells get whole sets, in which all pairs are counted by bits.
A cell gives at most one link for each component in it, so no group's pairs are all made, and no link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, saved, slices, small, texts
from tallyforge.llm.components import components, forest

SEED = 11
#: Nodes of a cell's side, and shingles of their sets; pairs that are looked at together, and shingles that are counted together.
CELL, WEIGHT, LOAD, BITS = 1024, 1 << 20, 1 << 18, 1 << 13
#: Rows of what is broadcast here, at most.
SENT = 100_000


class Kind(Protocol):
    #: Words of a shingle, the least similarity of a link in hundredths, bytes of a sketch.
    shingle: int
    similar: int
    size: int

    def sketch(self, hashes: np.ndarray) -> bytes:
        """Of a set's sorted distinct hashes."""

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """A bucket of each table for each row of sketches (bytes)."""

    def likely(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Of pairs of sketches and sizes, whether they may be similar."""

    def pairs(self, sketches: np.ndarray, sizes: np.ndarray, component: np.ndarray, ask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the likely pairs of one that asks and one that doesn't, of two components, in cells that end at `ends`."""


def set_of(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    # of bytes, lower() changes A-Z only, and split() takes the six blanks of ASCII, as WORD does
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = (h ^ w[i : len(w) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def sketched(docs: DataFrame, kind: Kind, *more: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, the set's digest and its sketch, of each row, and more columns of docs, which are bigints."""
    names = ["doc_id", "text_hash", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [set_of(t, kind.shingle) for t in texts(batch)]
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([kind.sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, "n_shingles", "digest", "sketch"])

    return _given(docs, *more).mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", n_shingles bigint, digest binary, sketch binary")


def _given(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), *more)


def nodes_of(marked: DataFrame, *more: F.Column) -> DataFrame:
    """A row for each set of marked (see `sketched`), numbered: node, digest, n, n_shingles, a row of its text (rep_id, rep_hash), sketch, and more aggregates."""
    rep = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    grouped = marked.groupBy("digest").agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"), rep, F.max("sketch").alias("sketch"), *more)
    # numbers are fixed as they are written
    return saved(grouped.withColumns({"node": F.monotonically_increasing_id(), "rep_id": F.col("rep.doc_id"), "rep_hash": F.col("rep.text_hash")}).drop("rep"))


def bucketed(nodes: DataFrame, kind: Kind) -> DataFrame:
    """node, keys (a bucket of each table), sketch of each set with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1024):
                keys = kind.keys(_stack(batch.column("sketch"), kind.size))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel())), batch.column("sketch")], names=["node", "keys", "sketch"])

    return saved(nodes.where("n_shingles > 0").select("node", "sketch").mapInArrow(run, "node bigint, keys array<bigint>, sketch binary"))


def bucket_members(nodes: DataFrame, kind: Kind) -> DataFrame:
    """key, node, hub (the bucket's least node) of each node in a bucket with others."""
    return with_hubs(bucketed(nodes, kind).select("node", F.explode("keys").alias("key")))


def with_hubs(tabled: DataFrame) -> DataFrame:
    """tabled (key, node) with the least node of each bucket, where that isn't alone."""
    shared = saved(tabled.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
    # one row for each key there, so that adaptive execution can split the nodes of a common one
    return saved(tabled.join(shared, "key").select("key", "node", "hub"))


def _of_pairs(pairs: DataFrame, right: DataFrame, names: dict[str, str]) -> DataFrame:
    """pairs (a, b) with right's columns (of node) for both sides; names: right's column -> the name that a or b follows. A node of many pairs has one row in right, so
    that adaptive execution can split its pairs."""
    for side in ("a", "b"):
        pairs = pairs.join(right.select(F.col("node").alias(side), *(F.col(c).alias(f"{to}_{side}") for c, to in names.items())), side)
    return pairs


def likely(pairs: DataFrame, nodes: DataFrame, kind: Kind) -> DataFrame:
    """Of pairs (a, b), those that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _stack(batch.column("sketch_a"), kind.size), _stack(batch.column("sketch_b"), kind.size)
                found = kind.likely(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(found))

    # no pair whose sizes differ by more can reach the limit
    near = _of_pairs(pairs, nodes, {"sketch": "sketch", "n_shingles": "n"}).where(100 * F.least("n_a", "n_b") >= kind.similar * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint")


def sets_of(docs: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """node, hashes of the asked nodes (node, digest, rep_id, rep_hash), made from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                out = []
                for node, digest, text in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), texts(batch), strict=True):
                    if node not in seen and xxhash.xxh128_digest((made := set_of(text, kind.shingle)).tobytes()) == digest:
                        seen.add(node)
                        out.append((node, made.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["node", "hashes"])

    rows = _given(docs)
    asked = small(asked.select("node", "digest", "rep_id", "rep_hash"), SENT)
    met = rows.join(asked, (rows.text_hash == asked.rep_hash) & rows.doc_id.eqNullSafe(asked.rep_id))
    return met.select("node", "digest", "text").mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, kind: Kind) -> DataFrame:
    """Of pairs (a, b), those whose whole sets reach the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                keep = []
                for a, b in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                    x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= kind.similar * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = saved(sets_of(docs, nodes.join(ends, "node", "left_semi"), kind))
    return _of_pairs(pairs, sets, {"hashes": "hashes"}).select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a bigint, b bigint")


def missed(met: DataFrame, nodes: DataFrame, labels: DataFrame, kind: Kind, cell: int = CELL) -> DataFrame:
    """key, row, column (a cell), ask, node, component: those that have a likely partner in another component, in the cells of buckets that hold several.
    labels: node, component of linked nodes."""
    sizes = nodes.select("node", F.col("n_shingles").alias("size"))
    own = met.select("key", "node").join(labels, "node", "left").join(sizes, "node").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    held = own.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("size").alias("w")).groupBy("key").agg(F.max(F.struct("c", "component", "w")).alias("most"), F.sum("c").alias("n"), F.sum("w").alias("w"))

    def parts(n: F.Column, weight: F.Column) -> F.Column:
        return F.ceil(F.greatest(n / cell, weight / WEIGHT)).cast("int")

    # of each mixed bucket: its largest component, and the parts of what is outside of it and of all
    others = parts(F.col("n") - F.col("most.c"), F.col("w") - F.col("most.w"))
    mixed = held.where(F.col("n") > F.col("most.c")).select("key", F.col("most.component").alias("largest"), others.alias("rows"), parts(F.col("n"), F.col("w")).alias("columns"))
    rows = own.join(mixed, "key").join(nodes.select("node", "sketch"), "node")

    def to(parts: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    def part(parts: str) -> F.Column:
        return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")

    asks = rows.where("component <> largest").select("key", part("rows").alias("row"), to("columns").alias("column"), F.lit(True).alias("ask"), "node", "component", "size", "sketch")
    all_ = rows.select("key", to("rows").alias("row"), part("columns").alias("column"), F.lit(False).alias("ask"), "node", "component", "size", "sketch")
    cells = asks.unionByName(all_).groupBy("key", "row", "column").agg(F.collect_list(F.struct("ask", "node", "component", "size", "sketch")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("members")
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = column.flatten()
            ask = flat.field("ask").to_numpy(zero_copy_only=False)
            asking = np.concatenate([[0], np.cumsum(ask)])[np.concatenate([[0], ends])]
            load = np.diff(asking) * (np.diff(ends, prepend=0) - np.diff(asking))
            # cells are looked at together until they have LOAD pairs
            cuts = np.flatnonzero(np.diff(np.cumsum(load) // LOAD, prepend=-1)) if len(load) else []
            for first, last in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                start = ends[first - 1] if first else 0
                own = flat.slice(start, ends[last - 1] - start)
                component, size = (own.field(c).to_numpy() for c in ("component", "size"))
                left, right = kind.pairs(_stack(own.field("sketch"), kind.size), size, component, ask[start : ends[last - 1]], ends[first:last] - start)
                at = pa.array(np.unique(np.concatenate([left, right])))
                of = pa.array(np.searchsorted(ends[first:last] - start, at.to_numpy(), side="right") + first)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("key", "row", "column")), *(own.field(c).take(at) for c in ("ask", "node", "component"))], names=["key", "row", "column", "ask", "node", "component"])

    return cells.mapInArrow(run, "key bigint, row int, column int, ask boolean, node bigint, component bigint")


def linking(found: DataFrame, sets: DataFrame, kind: Kind) -> DataFrame:
    """a, b: links that connect what any two whole sets of a cell of `missed` connect. Cells of the same nodes, of which tables make many, are one before sets are joined to them."""
    alike = found.groupBy("key", "row", "column").agg(F.sort_array(F.collect_list(F.struct("ask", "node", "component"))).alias("members")).select("members").distinct()
    told = saved(alike.select(F.monotonically_increasing_id().alias("cell"), "members")).select("cell", F.explode("members").alias("m")).select("cell", "m.*")
    cells = told.join(sets, "node").groupBy("cell").agg(F.collect_list(F.struct("ask", "component", "hashes")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 16):
                for i in range(batch.num_rows):
                    flat = batch.column("members").slice(i, 1).flatten()
                    component, ask = flat.field("component").to_numpy(), flat.field("ask").to_numpy(zero_copy_only=False)
                    i, j = similar_sets([np.frombuffer(h, dtype=np.uint64) for h in flat.field("hashes").to_pylist()], component, ask, kind.similar)
                    known, at = np.unique(component, return_inverse=True)
                    a, b = forest(known, at[i], at[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def similar_sets(sets: list[np.ndarray], component: np.ndarray, ask: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one that asks and one that doesn't, of two components, whose sets reach the similarity (in hundredths). Shared hashes are numbered, and
    counted as bits, BITS at a time."""
    left, right, n = np.flatnonzero(ask), np.flatnonzero(~ask), np.array([len(s) for s in sets], dtype=np.int64)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = count[number] > 1
    number, owner = (np.cumsum(count > 1) - 1)[number[shared]], owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, BITS):
        s, e = np.searchsorted(number, at), np.searchsorted(number, at + BITS)
        bits = np.zeros((len(sets), BITS), dtype=bool)
        bits[owner[s:e], number[s:e] - at] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        words = words[:, : -(-int(number[e - 1] - at + 1) // 64)]
        others = np.ascontiguousarray(words[right])
        for k, i in enumerate(left.tolist()):
            both[k] += np.bitwise_count(others & words[i]).sum(axis=1, dtype=np.int64)
    reached = (100 * both >= similar * (n[left][:, None] + n[right][None, :] - both)) & (component[left][:, None] != component[right][None, :])
    i, j = np.nonzero(reached)
    return left[i], right[j]


def linked(docs: DataFrame, nodes: DataFrame, kind: Kind, met: DataFrame | None = None) -> DataFrame:
    """node, component of the nodes that are linked with others. met: key, node, hub of the buckets' nodes, as `bucket_members` gives them."""
    scratch = Scratch(docs.sparkSession)
    met = bucket_members(nodes, kind) if met is None else met
    stars = met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.saved(verified(docs, scratch.saved(likely(stars, nodes, kind)), nodes, kind))
    labels = scratch.saved(components(links))
    found = scratch.saved(missed(met, nodes, labels, kind))
    if not found.limit(1).count():
        return labels
    sets = scratch.saved(sets_of(docs, nodes.join(found.select("node").distinct(), "node", "left_semi"), kind))
    more = linking(found, sets, kind)
    # what was connected is so by its labels
    return components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def between(sizes: np.ndarray, component: np.ndarray, ask: np.ndarray, ends: np.ndarray, similar: int, load: int = LOAD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one that asks and one that doesn't in each cell, of two components and of sizes that allow the similarity, about `load` of them at a time."""
    cell = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    others = np.flatnonzero(~ask)
    first, last = np.searchsorted(cell[others], np.arange(len(ends))), np.searchsorted(cell[others], np.arange(len(ends)), side="right")
    asks = np.flatnonzero(ask)
    n = (last - first)[cell[asks]]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // load, prepend=-1)) if len(n) else []
    for s, e in zip(cuts, [*cuts[1:], len(asks)], strict=True):
        left = np.repeat(asks[s:e], n[s:e])
        right = others[np.arange(len(left)) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e]) + np.repeat(first[cell[asks[s:e]]], n[s:e])]
        fits = (component[left] != component[right]) & (100 * np.minimum(sizes[left], sizes[right]) >= similar * np.maximum(sizes[left], sizes[right]))
        yield left[fits], right[fits]
