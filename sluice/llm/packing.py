"""Packing of tokenised documents into sequences by the online sum-of-squares rule.

Each task packs the documents of its own partition, so nothing is shuffled. A document of more than a window's
tokens fills whole windows first; what is left goes where the sum of squares of the numbers of open windows per
fill level becomes smallest: into an open window at level h (its count falls, that of level h + length rises) or
into a new one. Levels are an array of `window` counts. A document may also be cut at the brim of an open window, which
closes it, the rest being placed like a document; a cut counts CUT in the sum, so that it is made only where levels
crowd. That bounds the open windows of a task by the rule itself, to about CUT / 2 at each level.

At the end of a partition the fullest open windows stay as they were placed and are filled to the brim with pieces of the
emptiest ones, as many as that takes; the last tokens make sequences whose lengths are powers of two, which need no padding.

Defined results: null text is empty: one token, the end id. Equal texts are packed separately. Repeated rows
give their own pieces. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sluice.llm._common import kept_by, map_arrow, slices
from sluice.llm._tokens import Words, encoder

_ENCODERS: dict = kept_by(__name__)

#: What a cut counts in the sum of squares.
CUT = 16
_NEVER = np.iinfo(np.int64).max


class Packer:
    """Pieces of documents in sequences: rows (document, start, length, crc32, tokens, sequence, offset)."""

    def __init__(self, window: int):
        self.window, self.next = window, 0
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.rows: list[tuple] = []
        #: Tokens moved out of the windows that they were placed in.
        self.moved = 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def level(self, length: int) -> tuple[int, int]:
        """The fill level that a piece goes to whole, and the growth of the sum: 0 opens a window. Of equals the fullest, so
        that windows close early."""
        counts, room = self.counts, self.window - length
        # growth of the sum of squares: 1 - 2 counts[h] from the level left, 1 + 2 counts[h + length] at the level reached
        cost = 2 * counts[length : self.window + 1] - 2 * counts[: room + 1] + 2
        cost[0] = 2 * counts[length] + 1
        cost[room] = 1 - 2 * counts[room] if room else 0  # a full window counts at no level
        cost[1:][counts[1 : room + 1] == 0] = _NEVER
        at = int(np.argmin(cost[::-1]))
        return room - at, int(cost[room - at])

    def cut_level(self, length: int) -> tuple[int, int]:
        """The fill level at whose brim a piece is best cut, and the growth of the sum, where the rest opens a window."""
        counts, room = self.counts, self.window - length
        if length < 2:
            return 0, _NEVER
        left, reached = counts[room + 1 : self.window], counts[1:length]
        cost = np.where(left > 0, 2 - 2 * left + 2 * reached + CUT, _NEVER)
        at = int(np.argmin(cost))
        return room + 1 + at, int(cost[at])

    def add(self, doc: object, ids: bytes) -> None:
        tokens, start, size = len(ids) // 4, 0, self.window * 4
        while tokens - start >= self.window:
            self._close([(doc, start, ids[start * 4 : start * 4 + size], tokens)])
            start += self.window
        while start < tokens:
            length = tokens - start
            h, growth = self.level(length)
            if growth > CUT // 2:  # below, no cut can be better: it grows by 2 + CUT - 2 counts[h] at least
                brim, cut_growth = self.cut_level(length)
                if cut_growth < growth:
                    h, length = brim, self.window - brim
            pieces = []
            if h:
                pieces = self.open[h].pop()
                self.counts[h] -= 1
            pieces.append((doc, start, ids[start * 4 : (start + length) * 4], tokens))
            start += length
            if h + length == self.window:
                self._close(pieces)
            else:
                self.open[h + length].append(pieces)
                self.counts[h + length] += 1

    def finish(self) -> None:
        """Close all open windows."""
        held = [(fill, w) for fill, level in enumerate(self.open) for w in level][::-1]
        self.open, self.counts[:] = [[] for _ in range(self.window + 1)], 0
        total = sum(fill for fill, _ in held)
        stay = total // self.window
        loose = [p for _, w in held[stay:] for p in w]
        self.moved += sum(len(p[2]) for p in loose) // 4

        def take(room: int) -> list[tuple]:
            """Pieces of `room` tokens, the last of them cut."""
            got = []
            while room:
                doc, start, ids, tokens = loose.pop()
                n = min(room, len(ids) // 4)
                got.append((doc, start, ids[: n * 4], tokens))
                if n < len(ids) // 4:
                    loose.append((doc, start + n, ids[n * 4 :], tokens))
                room -= n
            return got

        for fill, pieces in held[:stay]:
            self._close(pieces + take(self.window - fill))
        left = total - stay * self.window
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                self._close(take(1 << bit))


def _pack(path: str, window: int, end: int, special_text: bool, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    coder, packer, last = encoder(_ENCODERS, path, Words, special_text), Packer(window), array("I", [end]).tobytes()
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def flush() -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        cols = [pa.array([r[0] for r in rows], kind), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5))]
        cols += [pa.array([base + r[5] for r in rows], pa.int64()), pa.array([r[6] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in slices(batches):
        for doc, ids in zip(batch.column(0).to_pylist(), coder.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
            packer.add(doc, ids + last)
        if len(packer.rows) >= 4096:
            yield flush()
    packer.finish()
    yield flush()


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text", special_text: bool = False) -> DataFrame:
    """A row for each piece of each document of `docs`. `special_text`: see `_tokens.encoder`."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(docs.select(key, text), _pack, schema, path, window, end, special_text, to_arrow_type(kind))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
