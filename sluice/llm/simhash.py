"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Fingerprints that differ in at most `radius` bits are linked. Of radius + 1 blocks of bits, linked fingerprints
share at least one, so each block value is a group in which links are searched by a hierarchical index: the
fingerprints are sorted by Gray rank, runs of them become leaves, bits in which all of a run agree are factored
out into its node, runs of nodes likewise into upper nodes; a search goes down with the differences found so far
and drops every node at which they exceed the radius. Groups are indexed together, whatever their sizes are, so that each
link is found by the hierarchy.

Defined results: null text is empty text; a text without words has fingerprint zero, which links like any other;
equal texts and repeated rows share a fingerprint and so a component; an empty table gives an empty one. A null
id takes part, but can't name a component unless all ids of the component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import map_arrow, materialise, one_of_each, slices
from sluice.llm.components import connected_components

BITS = 64
#: Fingerprints that one group indexes at once. Larger groups are cut into slices, and each fingerprint searches all
#: slices up to its own, so that a group of any size is searched whole by many tasks of bounded memory.
SLICE = 8192
#: Fingerprints of whole groups that are indexed together, about, and those that search at once.
CHUNK, TOGETHER = 2048, 256
#: Fingerprints of a leaf, and children of an upper node.
LEAF = 16
#: Hashes summed at once for one text.
BLOCK = 65536


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each of a text's word shingles, repeats included; A-Z count as a-z."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    cuts = zip(begins[: len(parts) - words + 1], ends[words - 1 :].tolist(), strict=True)
    return np.array([hashed(joined[a:b], seed) for a, b in cuts], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text's word shingles."""
    return majority(shingle_hashes(text, words, seed))


def _fingerprints(words: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over fingerprints in Gray order. Each node keeps the bits that all fingerprints below it share and
    that no node above it has (a mask and their values); leaves keep the rest of each fingerprint."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        codes = codes[self.order]
        shared, value = np.full(len(codes), ~np.uint64(0)), codes
        levels = []
        while len(value) > 1 or not levels:
            starts = np.arange(0, len(value), LEAF)
            ones = np.bitwise_and.reduceat(value & shared, starts)
            zeros = np.bitwise_and.reduceat(~value & shared, starts)
            levels.append((shared, value))
            shared, value = ones | zeros, ones
        levels.append((shared, value))
        self.levels = []
        for k, (mask, bits) in enumerate(levels):  # from the codes up; take out of each node what its parent has
            own = mask if k + 1 == len(levels) else mask & ~np.repeat(levels[k + 1][0], LEAF)[: len(mask)]
            self.levels.append((own, bits & own))

    def search(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within the radius: numbers of the codes searched, and of the indexed ones. The codes go down the
        hierarchy together, each with the nodes that its differences so far leave."""
        mask, bits = self.levels[-1]
        asked, nodes = np.repeat(np.arange(len(codes), dtype=np.int32), len(mask)), np.tile(np.arange(len(mask), dtype=np.int32), len(codes))
        apart = np.bitwise_count((codes[asked] & mask[nodes]) ^ bits[nodes])
        for mask, bits in self.levels[-2::-1]:
            keep = np.flatnonzero(apart <= radius)
            asked, apart = np.repeat(asked[keep], LEAF), np.repeat(apart[keep], LEAF)
            nodes = (nodes[keep, None] * LEAF + np.arange(LEAF, dtype=np.int32)).ravel()
            if len(mask) % LEAF:
                real = nodes < len(mask)
                asked, apart, nodes = asked[real], apart[real], nodes[real]
            apart += np.bitwise_count((codes[asked] & mask[nodes]) ^ bits[nodes])
        keep = apart <= radius
        return asked[keep], self.order[nodes[keep]]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let all pairs (a, b) have one root: each root of a pair moves to the lesser one until none is left to move."""
    while True:
        one, two = parent[a], parent[b]
        apart = one != two
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


class _Chunk:
    """Groups indexed together. What is linked is reduced to one link for each fingerprint at once, so that the memory follows
    the chunk and TOGETHER, however many pairs there are."""

    def __init__(self, radius: int):
        self.radius, self.own, self.others, self.n_own, self.n_others = radius, [], [], 0, 0
        self.index: GrayIndex | None = None

    def _indexed(self) -> GrayIndex:
        if self.index is None:
            self.codes = np.concatenate(self.own)
            self.index, self.parent = GrayIndex(self.codes), np.arange(self.n_own)
        return self.index

    def meet(self) -> pa.RecordBatch:
        """Links of the others, which only search."""
        codes, self.others, self.n_others = np.concatenate(self.others), [], 0
        u, v = [codes[:0]], [codes[:0]]
        for at in range(0, len(codes) if self.n_own else 0, TOGETHER):
            some = codes[at : at + TOGETHER]
            asked, near = self._indexed().search(some, self.radius)
            both = np.concatenate([self.parent, np.arange(self.n_own, self.n_own + len(some))])
            _join(both, asked + self.n_own, near)
            self.parent = both[: self.n_own]
            linked = np.unique(asked)
            u.append(some[linked])
            v.append(self.codes[both[self.n_own + linked]])
        return _edges(np.concatenate(u), np.concatenate(v))

    def links(self) -> pa.RecordBatch:
        """Links among the chunk's own fingerprints, those by way of others included."""
        if not self.n_own:
            return _edges(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        index = self._indexed()
        for at in range(0, self.n_own, TOGETHER):
            asked, near = index.search(self.codes[at : at + TOGETHER], self.radius)
            _join(self.parent, asked + at, near)
        far = self.parent != np.arange(self.n_own)
        return _edges(self.codes[far], self.codes[self.parent[far]])


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def _links(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group with the group's indexed fingerprints first. Whole groups are indexed together, about CHUNK
    fingerprints at once. Gives links enough to reach all that is reachable within the groups."""
    chunk, now = _Chunk(radius), None
    for batch in slices(batches, 4096):
        group = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        codes = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
        for (*key, other), a, b in zip(group[:, starts].T.tolist(), starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
            if key != now and (chunk.n_own >= CHUNK or chunk.index is not None or chunk.n_others):
                if chunk.n_others:
                    yield chunk.meet()
                yield chunk.links()
                chunk = _Chunk(radius)
            now = key
            if other:
                chunk.others.append(codes[a:b])
                chunk.n_others += b - a
                if chunk.n_others >= 4096:
                    yield chunk.meet()
            else:
                chunk.own.append(codes[a:b])
                chunk.n_own += b - a
    if chunk.n_others:
        yield chunk.meet()
    yield chunk.links()


def linked(prints: DataFrame, fp: str, radius: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, enough to reach all that links within the radius reach."""
    codes = prints.select(F.col(fp).alias("code")).distinct()
    width = BITS // (radius + 1)
    masks = [(1 << (BITS if k == radius else (k + 1) * width)) - (1 << k * width) for k in range(radius + 1)]
    keyed = codes.select(
        "code",
        F.posexplode(F.array(*[F.shiftrightunsigned(F.col("code").bitwiseAND(m - (1 << 64) if m >> 63 else m), k * width) for k, m in enumerate(masks)])).alias("block", "value"),
    )
    keyed = materialise(keyed, "simhash-keys")
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("size")).where("size > 1")
    if width <= 16:  # at most (radius + 1) * 2^16 rows of 20 bytes
        sizes = F.broadcast(sizes)
    pieces = keyed.join(sizes, ["block", "value"]).withColumn("n", F.ceil(F.col("size") / SLICE).cast("int"))
    pieces = pieces.withColumn("own", F.pmod(F.xxhash64("code"), "n").cast("int"))
    dealt = pieces.select("block", "value", F.explode(F.sequence(F.lit(0), "own")).alias("slice"), "own", "code")
    dealt = dealt.select("block", "value", "slice", (F.col("slice") != F.col("own")).cast("int").alias("other"), "code")
    grouped = dealt.repartition("block", "value", "slice").sortWithinPartitions("block", "value", "slice", "other")
    return map_arrow(grouped, _links, "u long, v long", radius)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """A row for each row of `docs`: `key`, fp (long, the fingerprint's bits) and component (smallest key reachable)."""
    kind = docs.schema[key].dataType.simpleString()
    prints = materialise(map_arrow(docs.select(key, text), _fingerprints, f"`{key}` {kind}, fp long", words, seed), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash-classes")
    reach = connected_components(materialise(linked(classes, "fp", radius), "simhash-links"), "u", "v")
    named = classes.join(reach, classes.fp == reach.node, "left").select(classes.fp, "least", F.coalesce("component", classes.fp).alias("part"))
    named = materialise(named, "simhash-named")
    smallest = named.groupBy("part").agg(F.min("least").alias("component"))
    return prints.join(named.join(smallest, "part").select("fp", "component"), "fp", "left").select(key, "fp", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component: the one of the smallest key, see `one_of_each`."""
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(rows, "_row", text, words, radius).select("_row", F.col("component").alias("_component"))
    return one_of_each(rows.join(found, "_row"), "_component", "_row", key).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
