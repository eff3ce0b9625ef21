"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves pre-tokens that are vocabulary entries as a whole; for the others a
heap of ranked pairs merges a doubly linked list of bytes. Results are those of the tiktoken library.

Null text counts as empty: no ids. Repeated rows and equal texts each give their own, equal row. Other columns
are not read, so their names don't matter. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sluice.llm._common import Splitter, map_arrow, slices
from sluice.llm.mph import MinimalPerfectHash, key_hash

#: Entries of each generation of a worker's memos. A full memo becomes the older generation, from which entries that are
#: met again come back, so that frequent ones outlive the many that are met once.
MEMO_ENTRIES = 300_000
_AWAY = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?:\s|\Z)")
_ODD = re.compile("[\x1c-\x1f]")


class Vocabulary:
    """Ranks of byte strings, behind a minimal perfect hash that stores its keys."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = MinimalPerfectHash.build(np.array([key_hash(k) for k in keys], np.uint64))
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = [0] * len(keys)
        for key in keys:
            at = self.hash.slot(key_hash(key))
            self.keys[at], self.ids[at] = key, ranks[key]
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for key, rank in ranks.items():
            self.bytes_of[rank] = key
        self.longest = max(map(len, keys), default=0)
        #: Every two tokens that make a token when put together, with its id.
        self.pairs = {(ranks[k[:c]], ranks[k[c:]]): r for k, r in ranks.items() for c in range(1, len(k)) if k[:c] in ranks and k[c:] in ranks}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines) if key})

    def get(self, key: bytes) -> int | None:
        if len(key) > self.longest:
            return None
        at = self.hash.slot(key_hash(key))
        return self.ids[at] if at >= 0 and self.keys[at] == key else None


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, Splitter(pattern)
        self.single = [vocabulary.get(bytes([b])) for b in range(256)]
        self.words: dict[str, list[int]] = {}
        self.older_words: dict[str, list[int]] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.pair = vocabulary.pairs.get

    def merge(self, word: bytes) -> list[int]:
        """The merges of lowest rank first, leftmost of equals, until no neighbours form a token."""
        pair, n = self.pair, len(word)
        ids = [self.single[b] for b in word]
        ranks: list = [*map(pair, zip(ids, ids[1:])), None]  # of each token with the one after it
        heap = [r * n + i for i, r in enumerate(ranks) if r is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heappop(heap), n)
            if ranks[i] != rank:
                continue  # one of the two has been merged since
            ids[i], j = rank, after[i]
            ranks[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = new = pair((rank, ids[k]))
                if new is not None:
                    heappush(heap, new * n + i)
            else:
                ranks[i] = None
            h = before[i]
            if h >= 0:
                ranks[h] = new = pair((ids[h], rank))
                if new is not None:
                    heappush(heap, new * n + h)
        found, i = [], 0
        while i < n:
            found.append(ids[i])
            i = after[i]
        return found

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if ids is None:
                raw = word.encode()
                whole = self.vocabulary.get(raw)
                ids = self.merge(raw) if whole is None else [whole]
            if len(self.words) >= MEMO_ENTRIES:
                self.older_words, self.words = self.words, {}
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        raw = self.chunks.get(chunk) or self.older_chunks.get(chunk)
        if raw is None:
            raw = array("i", [i for w in self.split(chunk) for i in self.word(w)]).tobytes()
        if len(self.chunks) >= MEMO_ENTRIES:
            self.older_chunks, self.chunks = self.chunks, {}
        if len(chunk) <= 64:
            self.chunks[chunk] = raw
        return raw

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text.

        No match of the pattern crosses the start of a lone space before a visible character, so the text is cut
        there and the pieces are looked up first.
        """
        if _ODD.search(text):
            return np.array([i for w in self.split(text) for i in self.word(w)], np.int32)
        known, miss = self.chunks.get, self._chunk  # of the generation at the text's start; miss looks in the current two
        first, *rest = _AWAY.split(text) if _RUN.search(text) else text.split(" ")
        found = [miss(first)]
        found += [known(c) or miss(c) for c in [f" {r}" for r in rest]]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder; built once, kept between tasks."""
    return Encoder(Vocabulary.from_file(path), pattern)


@lru_cache(maxsize=2)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def _encode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    for batch in slices(batches):
        ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
        values = np.concatenate([np.empty(0, np.int32), *ids])
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], names=["key", "ids"])


def _decode(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    for batch in slices(batches):
        raw = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["key", "raw"])


def _round_trip(path: str, pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    decimal = _decimals(len(coder.vocabulary.bytes_of)).__getitem__
    for batch in slices(batches):
        rows: list[list] = [[], [], []]
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text or "").tolist()
            rows[0].append(len(ids))
            rows[1].append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
            rows[2].append(hashlib.sha256(coder.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])],
            names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `key` and `ids` (array of int), a row for each row of `docs`."""
    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), _encode, f"`{key}` {kind}, ids array<int>", path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Columns `key` and `raw` (binary): the bytes of the ids, which need not be UTF-8 if ids were cut; null stays null."""
    kind = encoded.schema[key].dataType.simpleString()
    return map_arrow(encoded.select(key, ids), _decode, f"`{key}` {kind}, raw binary", path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's ids and of the bytes that decoding these ids gives, without moving the ids."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select(key, text), _round_trip, schema, path, pattern)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
