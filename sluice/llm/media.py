"""Media columns: content-defined chunks of media payloads, stored once, and media rebuilt from chunk lists.

Storing is one pass: each task cuts its media by a rolling gear hash, drops chunks it has already met, writes the
rest compressed into a pack file of its own in the shared folder, and gives a row for each chunk of each medium.
A Spark aggregation then names one place for each chunk digest, and a join puts these places into the ordered chunk
lists, so that a chunk that many tasks wrote is read from one place; bytes at the other places are dead, and
`dead_bytes` tells a compaction how many. Rebuilding reads the chunks in list order and checks every digest.

Media are 8-bit mono PCM in a RIFF container. Defined results: a null or empty payload is stored as padding only;
equal payloads give equal media; repeated rows give a row each; an empty table gives an empty one. Only the key and
text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import map_arrow, materialise, scratch_path, slices

#: A cut needs the 12 highest bits of the hash to be zero: 4 KiB between cuts on average, after the shortest length.
MASK = np.uint32(0xFFF00000)
SHORTEST, LONGEST = 1024, 16384
#: Digests a task remembers of its own chunks; a forgotten chunk is written again and merged by the aggregation.
KNOWN = 500_000
#: Bytes of decompressed chunks a rebuilding task keeps for lists that share them.
KEPT_BYTES = 16 << 20
RATE = 8000
UNIT = 192
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), "<u4")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The 32-bit gear hash of a place depends on the 32 bytes up to it, so it is computed for
    all places at once by doubling the window."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h = np.concatenate([h[:width], h[width:] + (h[:-width] << np.uint32(width))])
    found, start = [], 0
    for end in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while end - start > LONGEST:
            start += LONGEST
            found.append(start)
        if end - start >= SHORTEST:
            found.append(end)
            start = end
    while n - start > LONGEST:
        start += LONGEST
        found.append(start)
    if start < n:
        found.append(n)
    return found


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, padded by blanks to a positive multiple of UNIT; their number without padding."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def wrap(samples: bytes) -> bytes:
    """A RIFF file of 8-bit mono samples."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def unwrap(media: bytes) -> bytes:
    """The samples of a RIFF file; raises ValueError if it isn't one that `wrap` makes."""
    if len(media) < 44 or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit RIFF file")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def feature(samples: bytes) -> str:
    """Length in seconds, mean, root mean square and share of crossings of the middle, of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    above = x >= 0
    crossings = int((above[1:] != above[:-1]).sum())
    return f"seconds={len(x) / RATE:.4f};mean={x.sum() / len(x):.4f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};zcr={crossings / len(x):.4f}"


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _store(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, root = pafs.FileSystem.from_uri(folder)
    pack, out, at, row = uuid.uuid4().hex, None, 0, 0
    packer, known = zstandard.ZstdCompressor(level=3), OrderedDict()
    try:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                data, n = payload(text)
                data = wrap(data)
                start = 0
                for seq, end in enumerate(cuts(data)):
                    chunk = data[start:end]
                    start, digest = end, _digest(chunk)
                    place = known.get(digest)
                    if place is None:
                        packed = packer.compress(chunk)
                        out = out or files.open_output_stream(f"{root}/{pack}")
                        out.write(packed)
                        place = known[digest] = (at, len(packed))
                        at += len(packed)
                        if len(known) > KNOWN:
                            known.popitem(last=False)
                    rows.append((row, seq, n, digest, *place))
                row += 1
            take = pa.array([r[0] - (row - batch.num_rows) for r in rows], pa.int64())
            cols = [batch.column(0).take(take), pa.array([pack] * len(rows))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
            cols += [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "pack", "row", "seq", "n_bytes", "digest", "at", "size"])
    finally:
        if out is not None:
            out.close()


class _Packs:
    """Chunks by place, with the open pack and the last chunks kept."""

    def __init__(self, folder: str):
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.kept: OrderedDict[bytes, bytes] = OrderedDict()
        self.bytes, self.unpack = 0, zstandard.ZstdDecompressor()

    def chunk(self, digest: bytes, pack: str, at: int, size: int) -> bytes:
        found = self.kept.get(digest)
        if found is None:
            file = self.open.get(pack)
            if file is None:
                file = self.open[pack] = self.files.open_input_file(f"{self.root}/{pack}")
                if len(self.open) > 64:
                    self.open.popitem(last=False)[1].close()
            found = self.unpack.decompress(file.read_at(size, at))
            if _digest(found) != digest:
                raise ValueError(f"a chunk in pack {pack} at {at} is damaged")
            self.kept[digest] = found
            self.bytes += len(found)
            while self.bytes > KEPT_BYTES:
                self.bytes -= len(self.kept.popitem(last=False)[1])
        return found

    def close(self) -> None:
        for file in self.open.values():
            file.close()


def _rebuilt(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row of the key column, unpadded bytes, media) of each chunk list; rows come sorted by list and sequence."""

    def rows() -> Iterator[tuple]:
        for batch in slices(batches, 4096):
            names = ("home", "row", "seq", "n_bytes", "digest", "pack", "at", "size")
            yield from zip(batch.column(0).to_pylist(), *(batch.column(x).to_pylist() for x in names), strict=True)

    packs = _Packs(folder)
    try:
        for _, chunks in groupby(rows(), key=lambda r: r[1:3]):
            parts = []
            for key, _, _, seq, n, digest, pack, at, size in chunks:
                if seq != len(parts):
                    raise ValueError("a chunk list is not whole")
                parts.append(packs.chunk(digest, pack, at, size))
            yield key, n, b"".join(parts)
    finally:
        packs.close()


def _described(folder: str, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows: list[tuple] = []
    for key, n, media in _rebuilt(folder, batches):
        samples = unwrap(media)
        sha = hashlib.sha256
        rows.append((key, n, len(samples), sha(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), sha(media).hexdigest(), feature(samples)))
        if len(rows) == 1024:
            yield flush(rows)
            rows = []
    yield flush(rows)


def _media(folder: str, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, n, media in _rebuilt(folder, batches):
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([n], pa.int64()), pa.array([media], pa.binary())], names=["key", "n_bytes", "media"])


class MediaStore:
    """Chunk lists and packs of the media of one table."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        spark, self.kind = docs.sparkSession, docs.schema[key].dataType
        self.folder = scratch_path(spark, "media-packs")
        pafs.FileSystem.from_uri(self.folder.rpartition("/")[0])[0].create_dir(pafs.FileSystem.from_uri(self.folder)[1], recursive=True)
        schema = f"key {self.kind.simpleString()}, pack string, row long, seq int, n_bytes long, digest binary, at long, size int"
        self.lists = materialise(map_arrow(docs.select(key, text), _store, schema, self.folder), "media-lists")
        place = F.struct("pack", "at", "size")
        self.places = self.lists.groupBy("digest").agg(F.min(place).alias("place"))

    def dead_bytes(self) -> int:
        """Bytes in packs that no chunk list uses."""
        written = self.lists.select("pack", "at", "size").distinct().agg(F.sum("size")).first()[0] or 0
        return written - (self.places.agg(F.sum("place.size")).first()[0] or 0)

    def _ordered(self) -> DataFrame:
        lists = self.lists.select("key", F.col("pack").alias("home"), "row", "seq", "n_bytes", "digest")
        placed = lists.join(self.places, "digest").select("key", "home", "row", "seq", "n_bytes", "digest", "place.*")
        # neighbours in a pack stay neighbours here, so that packs are read from front to back
        return placed.repartition("home", F.floor(F.col("row") / 1024)).sortWithinPartitions("home", "row", "seq")

    def _kind(self) -> pa.DataType:
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(self.kind)

    def described(self) -> DataFrame:
        """Digests and features of the media as rebuilt from the packs."""
        schema = f"key {self.kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
        return map_arrow(self._ordered(), _described, schema, self.folder, self._kind())

    def media(self) -> DataFrame:
        """The media as rebuilt from the packs: key, n_bytes (unpadded), media (binary)."""
        return map_arrow(self._ordered(), _media, f"key {self.kind.simpleString()}, n_bytes long, media binary", self.folder, self._kind())


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MediaStore(spark.read.parquet(f"{sf_dir}/documents.parquet")).described().withColumnRenamed("key", "doc_id")
