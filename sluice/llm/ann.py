"""Approximate nearest neighbours by query-centred collision counting.

Vectors are dealt into blocks by a hash of their ids. In a block each of PROJECTIONS random directions gives a sorted array of
projections. A query opens a window around its own projection in each array; widening all windows together plays
the part of coarser hash tables (virtual rehashing). Vectors that lie in enough windows are verified by their exact cosine.
Widening ends only once the k best verified are within the radius at which vectors hardly fail to collide; at
the last width all of the block are verified, so that there is no cap and small blocks need no rule of their own. Equal vectors of a block are one entry with their smallest ids, so that
a vector that very many rows share costs as much as any other.

A stated set of queries meets all rows block by block: each block streams the queries past its index, so a task holds
one block and one slice of queries. Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as query or candidate; vectors of different lengths don't meet; a null id takes no part;
rows that repeat an id are candidates of their own, none of them for a query of that id; a query that is repeated with its vector is asked once; ties go to the smaller id;
with fewer than k candidates all are given. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm._common import map_arrow, slices

#: Vectors of a block, about.
BLOCK = 16384
PROJECTIONS = 128
#: Share of the windows that a vector must lie in to be verified.
THRESHOLD = 0.62
#: Half-widths of the windows, for unit vectors; in the last one everything lies.
WIDTHS = (0.35, 0.5, 0.65, 0.8, 0.95, 1.1, 1.25, 1.45, 1.75, 2.2, np.inf)
#: A search ends once its k best are within this part of the half-width. A vector at that distance lies in a window with a
#: chance of 0.71, so that it reaches the threshold with two standard deviations to spare; nearer ones have more.
REACH = 0.95
#: Ranks compared at once.
CELLS = 1 << 17
#: Queries of which the windows are looked up together.
TOGETHER = 128


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes; their cosines stay the same to the last bit."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


class BlockIndex:
    """Sorted projections of a block. Of each vector the rank in each array is kept: a window is a range of ranks, and the
    vectors in it are told by one comparison of ranks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        """ids and vectors of a block's rows; of each distinct vector the k + 1 smallest ids stay."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], _scaled(vectors[order])
        self.vectors, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(group.ravel(), kind="stable")
        starts = np.searchsorted(group.ravel()[by], np.arange(len(self.vectors)))
        ends = np.append(starts[1:], len(by))
        self.ids = [ids[by[a : min(b, a + k + 1)]].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.units = self.vectors / self.norms[:, None]
        self.k = k
        n, d = self.vectors.shape
        self.directions = np.random.Generator(np.random.PCG64(d)).normal(size=(d, PROJECTIONS))
        projected = (self.units @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.kind = np.uint16 if n < 1 << 16 else np.uint32
        self.rank = np.empty((PROJECTIONS, n), self.kind)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=self.kind)[None, :], axis=1)
        self.enough, self.first = int(np.ceil(THRESHOLD * PROJECTIONS)), 0

    def _windows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, width and projection, the first rank of the window and the number of ranks."""
        centre, halves = (units @ self.directions).T, np.array(WIDTHS)
        lows = np.stack([row.searchsorted((c[:, None] - halves).ravel()) for row, c in zip(self.sorted, centre, strict=True)])
        highs = np.stack([row.searchsorted((c[:, None] + halves).ravel(), "right") for row, c in zip(self.sorted, centre, strict=True)])
        shape = (PROJECTIONS, len(units), len(halves))
        return lows.astype(self.kind).reshape(shape).transpose(1, 2, 0), (highs - lows).astype(self.kind).reshape(shape).transpose(1, 2, 0)

    def search(self, query_ids: list[int], queries: np.ndarray) -> list[list[tuple[int, float]]]:
        """Of each query the k nearest, as (id, cosine)."""
        found = []
        for a in range(0, len(query_ids), TOGETHER):
            some = _scaled(queries[a : a + TOGETHER])
            units = some / np.sqrt((some * some).sum(axis=1))[:, None]
            for query_id, query, unit, lows, spans in zip(query_ids[a : a + TOGETHER], some, units, *self._windows(units), strict=True):
                found.append(self._nearest(query_id, query, unit, lows, spans))
        return found

    def _collisions(self, low: np.ndarray, span: np.ndarray) -> np.ndarray:
        """In how many of the windows each vector lies."""
        count, some = np.zeros(len(self.vectors), np.uint8), max(1, CELLS // len(self.vectors))
        for j in range(0, PROJECTIONS, some):
            apart = self.rank[j : j + some] - low[j : j + some, None]  # ranks below the window wrap around to large numbers
            count += np.add.reduce((apart < span[j : j + some, None]).view(np.uint8), axis=0, dtype=np.uint8)
        return count

    def _nearest(self, query_id: int, query: np.ndarray, unit: np.ndarray, lows: np.ndarray, spans: np.ndarray) -> list[tuple[int, float]]:
        n, k = len(self.vectors), self.k
        about = np.full(n, -np.inf)  # cosines of what is verified, in any order of summation
        for step in range(self.first, len(WIDTHS)):
            half = WIDTHS[step]
            if np.isinf(half):
                about = self.units @ unit
                break
            fresh = np.flatnonzero((self._collisions(lows[step], spans[step]) >= self.enough) & (about == -np.inf))
            about[fresh] = self.units[fresh] @ unit
            verified = np.flatnonzero(about > -np.inf)
            if len(verified) > k:
                # the query itself may be among them, so the k + 1st counts; |x - y|^2 = 2 - 2 cos
                worst = np.partition(about[verified], len(verified) - k - 1)[len(verified) - k - 1]
                if np.sqrt(max(0.0, 2 - 2 * worst)) <= half * REACH:
                    break
        # the next search begins a step narrower than this one ended: a window wider than needed only verifies more
        self.first = max(0, step - 1)
        best = np.flatnonzero(about > -np.inf)
        if len(best) > k + 1:
            # what may equal the k + 1st stays, for exact cosines and ids to decide
            best = best[about[best] >= np.partition(about[best], len(best) - k - 1)[len(best) - k - 1] - 1e-9]
        exact = (self.vectors[best] * query).sum(axis=1) / (self.norms[best] * np.sqrt((query * query).sum()))
        near = [(i, float(s)) for b, s in zip(best.tolist(), exact.tolist(), strict=True) for i in self.ids[b] if i != query_id]
        return sorted(near, key=lambda f: (-f[1], f[0]))[:k]


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, those to index before queries."""

    def rows() -> Iterator[tuple[tuple[int, int, int], int, np.ndarray]]:
        for batch in slices(batches, 1024):
            column = batch.column(4)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for j, (block, size, query, vec_id) in enumerate(zip(*cols, strict=True)):
                yield (block, size, query), vec_id, values[ends[j] : ends[j + 1]].astype(np.float64)

    def flush(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    index, indexed, found = None, None, []
    for (block, size, query), members in groupby(rows(), key=lambda r: r[0]):
        if not query:
            held = [(vec_id, v) for _, vec_id, v in members]
            index, indexed = BlockIndex(np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held]), k), (block, size)
            continue
        while indexed == (block, size) and (some := list(islice(members, TOGETHER))):
            near = index.search([vec_id for _, vec_id, _ in some], np.array([v for _, _, v in some]))
            found += [(vec_id, i, s) for (_, vec_id, _), own in zip(some, near, strict=True) for i, s in own]
            if len(found) >= 4096:
                yield flush(found)
                found = []
    yield flush(found)


def nearest(vectors: DataFrame, k: int, queries: str, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest rows of each row that meets the SQL condition `queries`."""
    usable = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.expr(queries).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    blocks = max(1, -(-usable.count() // block))
    held = usable.select(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("size"), F.lit(0).alias("query"), "id", "v")
    asking = usable.where("asks").select("id", "v").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("v").alias("size"), F.lit(1).alias("query"), "id", "v")
    dealt = held.union(asking).repartition("block", "size").sortWithinPartitions("block", "size", "query", "id")  # the order of queries tells where windows begin
    near = map_arrow(dealt, _search, "query_id long, vec_id long, score double", k)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, "vec_id % 50 = 0")
