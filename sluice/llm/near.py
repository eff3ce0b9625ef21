"""Near copies of texts: pairs whose sets of word shingles have a Jaccard similarity of at least ALIKE, and all they reach.

Candidates come from two sides. SimHash fingerprints of the shingles are linked within RADIUS bits through the Gray-order index of
`simhash`, which finds copies with few changes. Pairs of similarity 0.8 differ in about 10 of 64 bits, a radius at which no
index of such fingerprints leaves anything out; so a text's set is also reduced to BANDS keys of BAND minima each (MinHash), and
texts that share a key are candidates: two of similarity 0.8 share none with a chance of (1 - 0.8^5)^25, about 1 in 20,000,
and more similar ones with less. Candidates of both sides are verified by their whole sets, so what is linked is certain. Sets are only
made for texts with candidates, and groups of the same texts under several keys are verified once.

Defined results: A-Z count as a-z and white space only separates; null text is empty text; texts without words are
equal; a text of fewer than WORDS words has one shingle, so equals only its like.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import simhash
from sluice.llm._common import discard, map_arrow, materialise, precedence, sift, slices
from sluice.llm.components import connected_components
from sluice.llm.simhash import majority, shingle_hashes

WORDS, ALIKE, SEED = 5, 0.8, 42
#: Bits in which linked fingerprints differ at most.
RADIUS = 3
BANDS, BAND = 25, 5
#: Texts of a group that are held at once; of larger groups, each text meets all slices up to its own.
SLICE = 512
#: Shingles whose minima are taken at once.
BLOCK = 2048
_RNG = np.random.Generator(np.random.PCG64(7))
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * BAND, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, WORDS, SEED))


def keys_of(found: np.ndarray) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[at : at + BLOCK] * _TIMES + _PLUS).min(axis=1))
    raw, step = least.tobytes(), 8 * BAND
    return [xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) - (1 << 63) for b in range(BANDS)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (_row, text) the class (digest of the set), the keys and the fingerprint of the text."""
    for batch in slices(batches):
        hashes = [shingle_hashes(t, WORDS, SEED) for t in batch.column(1).to_pylist()]
        sets = [np.unique(h) for h in hashes]
        classes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
        columns = [batch.column(0), pa.array(classes, pa.binary()), pa.array([keys_of(s) for s in sets], pa.list_(pa.int64())), pa.array(prints)]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "class", "keys", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, places, text) the same with the set of the text's shingles in its stead."""
    for batch in slices(batches):
        sets = [shingles(t).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "places", "hashes"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' similarity reaches ALIKE."""
    both, less = len(a) + len(b), min(len(a), len(b))
    if less < ALIKE * (both - less):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= ALIKE * (both - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group with the slice's own texts first. Gives links of similar texts, enough to reach all that
    they reach: a text is compared with the texts of a part until it is similar to one."""

    def rows() -> Iterator[tuple]:
        for batch in slices(batches):
            yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)

    found: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
        found.clear()
        return out

    for _, group in groupby(rows(), key=lambda r: r[0]):
        parts: list[list[tuple[int, np.ndarray]]] = []
        for _, other, code, raw in group:
            mine = np.frombuffer(raw, np.uint64)
            joined, apart = [], []
            for part in parts:
                near = next((c for c, s in part if alike(mine, s)), None)
                (apart if near is None else joined).append(part)
                if near is not None:
                    found.append((code, near))
            if not other:
                joined.append([(code, mine)])
            parts = [*apart, *([[m for part in joined for m in part]] if joined else [])]
            if len(found) >= 4096:
                yield flush()
    yield flush()


def linked(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of similar classes (id, keys, fp) in the shared folder; the text of a class is that of its id in `texts` (id, text).

    Only texts of candidates are shuffled, and those that a filter over the ids of candidates can't tell from them.
    """
    prints = classes.groupBy("fp").agg(F.count("*").alias("n"))
    reach = connected_components(materialise(simhash.linked(prints, "fp", RADIUS), "near-prints"), "u", "v")
    reach = materialise(reach.select(F.col("node").alias("fp"), "component"), "near-reached")
    alone = F.xxhash64(F.coalesce("component", "fp"), F.lit("print"))
    by_print = classes.select("id", "fp").join(prints.join(reach, "fp", "left").where("n > 1 OR component IS NOT NULL").select("fp", alone.alias("key")), "fp").select("id", "key")
    keyed = materialise(classes.select("id", F.explode("keys").alias("key")).union(by_print), "near-keys")
    # groups of the same classes have the same marks; one of them is enough
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    groups = keyed.groupBy("key").agg(F.count("*").alias("size"), *marks).where("size > 1")
    groups = materialise(groups.groupBy("size", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "size"), "near-groups")
    members = materialise(sift(keyed, groups, "key").join(groups, "key"), "near-members")
    # a text goes once to where its groups are known, of which it has a few, and from there its set to each of them
    place = F.struct("key", F.ceil(F.col("size") / SLICE).cast("int").alias("n"))
    places = materialise(members.groupBy("id").agg(F.collect_list(place).alias("places")), "near-places")
    known = sift(texts, places, "id").join(places, "id").select("id", "places", "text")
    sets = map_arrow(known, _sets, "id long, places array<struct<key: long, n: int>>, hashes binary")
    pieces = sets.select("id", "hashes", F.explode("places").alias("place")).select("id", "hashes", "place.key", F.pmod(F.xxhash64("id"), "place.n").cast("int").alias("own"))
    dealt = pieces.select("key", F.explode(F.sequence(F.lit(0), "own")).alias("slice"), "own", "id", "hashes")
    dealt = dealt.select("key", "slice", (F.col("slice") != F.col("own")).cast("int").alias("other"), "id", "hashes")
    links = materialise(map_arrow(dealt.repartition("key", "slice").sortWithinPartitions("key", "slice", "other"), _verified, "u long, v long"), "near-links")
    for done in (reach, keyed, groups, members, places):
        discard(done)
    return links


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one of the smallest key, see `precedence`. Rows are chosen without their texts;
    only rows that a filter over the ids of dropped rows can't clear are shuffled. Columns may have any names."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    name, at = inner[docs.columns.index(text)], inner[docs.columns.index(key)]
    rows = docs.toDF(*inner).withColumn("_row", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("_order", precedence(rows, at, "_row")), "near-rows")
    sketches = materialise(map_arrow(rows.select("_row", name), _sketches, "_row long, class binary, keys array<bigint>, fp bigint"), "near-sketches")
    firsts = sketches.groupBy("class").agg(F.min(F.struct("_row", "keys", "fp")).alias("first"))
    firsts = materialise(firsts.select("class", F.col("first._row").alias("id"), "first.keys", "first.fp"), "near-firsts")
    classes = firsts.select("id", "keys", "fp")
    reach = connected_components(linked(classes, rows.select(F.col("_row").alias("id"), F.col(name).alias("text"))), "u", "v")
    reach = materialise(reach.select(F.col("node").alias("id"), "component"), "near-reach")
    # of each class, then of each group the first row
    first = F.min("_order").alias("_order")
    chosen = sketches.select("class", "_row").join(rows.select("_row", "_order"), "_row").groupBy("class").agg(first).join(firsts.select("class", "id"), "class")
    chosen = chosen.join(reach, "id", "left").groupBy(F.coalesce("component", "id")).agg(first).select("_order.row")
    gone = materialise(sketches.select("_row").join(chosen.withColumnRenamed("row", "_row"), "_row", "left_anti"), "near-gone")
    kept = sift(rows, gone, "_row", clear=True).unionByName(sift(rows, gone, "_row").join(gone, "_row", "left_anti"))
    return kept.select(*inner).toDF(*docs.columns)
