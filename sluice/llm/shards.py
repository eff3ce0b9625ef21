"""Token-id shards with a minimal perfect hash index over document keys.

Documents are dealt by range of (key, text digest), so that shards are in key order and copies of one key, however
many, spread over shards. A task writes the ids of its range to one file of its own and gives one manifest row; the
manifest names the file of the attempt that succeeded, so that a lost executor leaves only a file no one reads.

File: magic, raw ids (16 bits if all fit, else 32), then for each document its key, offset and number of ids, then
the index: the bits of a minimal perfect hash over the distinct keys and, for each slot, a 32-bit fingerprint of the
key and the first and last+1 of its documents; at the end the sizes of these sections. A key is found by one hash, one slot
and one read; a key that isn't there is told by its fingerprint, with an error of 2^-32, and then by the stored key.

Shards are of about SHARD_BYTES of text, so that the keys and sizes that a task holds for its index follow the shard and not the
table. Defined results: null text is empty: one id, the end. A null key is a key of its own and comes first; the key
-2^63, which stands for it in files, raises an error. Rows of equal
keys are all stored, in the order of their texts' digests. Empty tables give no shards and no rows. Only the key (long) and
text columns are read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import kept_by, map_arrow, materialise, scratch_path, slices
from sluice.llm._tokens import Bytes, encoder
from sluice.llm.mph import MinimalPerfectHash, key_hash

_ENCODERS: dict = kept_by(__name__)

MAGIC = b"IDSHARD1"
#: In files null keys are this, the least of all; no other key may be.
NULL_KEY = -(1 << 63)
_TAIL = struct.Struct("<6Q8s")
#: Ids read at once.
READ_IDS = 1 << 22
#: Bytes of text of a shard, about, with ROW_BYTES for each row; a table of so many bytes that this makes more than MOST_SHARDS
#: has that many larger ones, so that the manifest stays small.
SHARD_BYTES, ROW_BYTES, MOST_SHARDS = 32 << 20, 16, 1 << 16


def _hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    return np.array([key_hash(struct.pack("<q", k), seed) for k in keys.tolist()], np.uint64)


def _index(keys: np.ndarray) -> tuple[int, MinimalPerfectHash, np.ndarray, np.ndarray]:
    """Seed, hash, and for each slot the fingerprint and the run of documents; keys are sorted."""
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    for seed in range(64):
        hashes = _hashes(distinct, seed)
        try:
            mph = MinimalPerfectHash.build(hashes)
        except ValueError:
            continue
        at = mph.slots(hashes)
        prints, runs = np.zeros(mph.n, "<u4"), np.zeros((mph.n, 2), "<u8")
        prints[at] = (hashes >> np.uint64(32)).astype(np.uint32)
        runs[at] = np.stack([first, first + count], axis=1)
        return seed, mph, prints, runs
    raise RuntimeError("no seed parts the keys")


def _write(folder: str, tokenizer: str, end: int, narrow: bool, special_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    files, root = pafs.FileSystem.from_uri(folder)
    coder, last = encoder(_ENCODERS, tokenizer, Bytes, special_text), array("I", [end]).tobytes()
    name, out, keys, sizes = f"{uuid.uuid4().hex}.ids", None, array("q"), array("Q")
    try:
        for batch in slices(batches):
            ids = [i + last for i in coder.batch([t or "" for t in batch.column(1).to_pylist()])]
            keys.extend(batch.column(0).fill_null(NULL_KEY).to_pylist())
            sizes.extend(len(i) // 4 for i in ids)
            if out is None:
                out = files.open_output_stream(f"{root}/{name}")
                out.write(MAGIC)
            raw = b"".join(ids)
            out.write(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if narrow else raw)
        if out is not None:
            all_keys, counts = np.array(keys, "<i8"), np.array(sizes, "<u8")
            seed, mph, prints, runs = _index(all_keys)
            for part in (all_keys, counts, np.array(mph.sizes, "<u8"), np.packbits(mph.bits), prints, runs):
                out.write(part.tobytes())
            out.write(_TAIL.pack(2 if narrow else 4, len(all_keys), int(counts.sum()), len(mph.sizes), mph.n, seed, MAGIC))
    finally:
        if out is not None:
            out.close()
    if out is not None:
        row = (TaskContext.get().partitionId(), name, min(keys), max(keys), len(keys), int(counts.sum()))
        names = ["shard", "file", "first_key", "last_key", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)


@dataclass(frozen=True)
class Shard:
    file: str
    first_key: int
    last_key: int
    n_docs: int
    n_ids: int
    start: int


class ShardFile:
    """One shard, opened for keyed access."""

    def __init__(self, folder: str, name: str):
        files, root = pafs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        size = self.file.size()
        self.width, self.n_docs, self.n_ids, levels, slots, self.seed, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is not a whole shard")
        at = len(MAGIC) + self.width * self.n_ids
        rest = self.file.read_at(size - _TAIL.size - at, at)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal rest
            got = np.frombuffer(rest, kind, n)
            rest = rest[got.nbytes :]
            return got

        self.keys, self.counts, sizes = take("<i8", self.n_docs), take("<u8", self.n_docs).astype(np.int64), take("<u8", levels).tolist()
        bits = np.unpackbits(take("u1", -(-sum(sizes) // 8)), count=sum(sizes)).astype(bool)
        self.mph = MinimalPerfectHash(sizes, bits)
        self.prints, self.runs = take("<u4", slots), take("<u8", 2 * slots).reshape(-1, 2)
        self.offsets = np.cumsum(self.counts) - self.counts

    def find(self, key: int) -> range:
        """The documents of a key, as numbers in this shard."""
        h = key_hash(struct.pack("<q", key), self.seed)
        slot = self.mph.slot(h)
        if slot < 0 or self.prints[slot] != h >> 32 or self.keys[self.runs[slot, 0]] != key:
            return range(0)
        return range(int(self.runs[slot, 0]), int(self.runs[slot, 1]))

    def ids(self, first: int, n: int) -> np.ndarray:
        raw = self.file.read_at(n * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.offsets[number]), int(self.counts[number]))


def _read(folder: str, shards: list[Shard], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number in batch.column(0).to_pylist():
            shard = shards[number]
            file = ShardFile(folder, shard.file)
            first = 0
            while first < file.n_docs:  # documents up to READ_IDS ids at once, one at least
                past = max(first + 1, int(np.searchsorted(file.offsets, file.offsets[first] + READ_IDS)))
                ids = file.ids(int(file.offsets[first]), int(file.counts[first:past].sum())).tobytes()
                at = ((file.offsets[first:past] - file.offsets[first]) * 4).tolist()
                sizes = (file.counts[first:past] * 4).tolist()
                keys = file.keys[first:past].tolist()
                if any(number not in file.find(k) for number, k in enumerate(keys, first)):
                    raise ValueError(f"the index of {shard.file} misses a document")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, sizes, strict=True)]
                cols = [pa.array([None if k == NULL_KEY else k for k in keys], pa.int64()), pa.array(file.offsets[first:past] + shard.start), pa.array(file.counts[first:past]), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "start", "n_tokens", "ids_crc32"])
                first = past
            file.file.close()


def _route(shards: list[Shard], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    firsts, lasts = [s.first_key for s in shards], [s.last_key for s in shards]
    for batch in slices(batches, 4096):
        rows = [(k, n) for k in batch.column(0).fill_null(NULL_KEY).to_pylist() for n in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int32())], names=["key", "shard"])


def _lookup(folder: str, shards: list[Shard], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, file = -1, None
    for batch in slices(batches):
        rows = []
        for key, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if of != number:
                number, file = of, ShardFile(folder, shards[of].file)
            rows += [(None if key == NULL_KEY else key, int(file.offsets[d]) + shards[of].start, file.document(d).tolist()) for d in file.find(key)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["key", "start", "ids"])


class ShardSet:
    """The shards of one table; `shards` has a row for each file, MOST_SHARDS at most."""

    def __init__(self, spark: SparkSession, folder: str, shards: list[Shard]):
        self.spark, self.folder, self.shards = spark, folder, shards

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, end: int = 0, key: str = "doc_id", text: str = "text", ids_below: int = 1 << 16, special_text: bool = False) -> ShardSet:
        """Shards of the documents' ids, each followed by `end`. `special_text`: see `_tokens.encoder`."""
        spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "id-shards")
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        least = F.raise_error(F.lit(f"{NULL_KEY} is no key: it stands for null in the files")).cast("long")
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
        rows = rows.withColumn("key", F.when(F.col("key") == NULL_KEY, least).otherwise(F.col("key")))
        size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES)).first()[0] or 0
        n = max(1, min(MOST_SHARDS, -(-size // SHARD_BYTES)))
        dealt = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
        schema = "shard long, file string, first_key long, last_key long, n_docs long, n_ids long"
        manifest = materialise(map_arrow(dealt, _write, schema, folder, tokenizer, end, ids_below <= 1 << 16, special_text), "id-manifest")
        shards, start = [], 0
        for r in sorted(manifest.collect(), key=lambda r: r.shard):
            shards.append(Shard(r.file, r.first_key, r.last_key, r.n_docs, r.n_ids, start))
            start += r.n_ids
        return cls(spark, folder, shards)

    def read(self) -> DataFrame:
        """key, start, n_tokens, ids_crc32 of each document, from the files, each found through the index."""
        each = self.spark.range(0, len(self.shards), 1, max(1, len(self.shards)))
        return map_arrow(each, _read, "key long, start long, n_tokens long, ids_crc32 long", self.folder, self.shards)

    def lookup(self, keys: DataFrame, key: str) -> DataFrame:
        """key, start, ids (array of long) of each document whose key is in `keys`, once for each row of `keys`."""
        routed = map_arrow(keys.select(F.col(key).cast("long").alias("key")), _route, "key long, shard int", self.shards)
        placed = routed.repartition("shard").sortWithinPartitions("shard")
        return map_arrow(placed, _lookup, "key long, start long, ids array<long>", self.folder, self.shards)


def op10_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ShardSet.write(docs, public_tokenizers.path("byte_bpe_50k.json")).read().withColumnRenamed("key", "doc_id")
