"""Ids by the tokenizers library, with texts cut where no token can cross and each part encoded once.

Texts are cut into pieces at blanks, by plain string functions; a piece not met before that isn't a plain word is split into pre-tokens by the
tokenizer's own pattern; pre-tokens not met before go to the library's model, in its letters for bytes.
"""

from __future__ import annotations

import os
import re
from array import array

from sluice.llm._common import Splitter, narrow

#: Pieces and pre-tokens that a worker remembers; a full memo starts anew.
MEMO = 700_000
#: Characters of the longest piece that is remembered.
LONGEST = 128
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python only
_AWAY = re.compile(r" (?=\S)")
_RUN = re.compile(r" (?:\s|\Z)")
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_UNSEEN = [b for b in range(256) if b not in _SEEN]
#: The letter that stands for each byte in the library's models: itself if it is visible in Latin-1, else the next from U+0100 on.
_LETTERS = {b: chr(b if b in _SEEN else 256 + _UNSEEN.index(b)) for b in range(256)}


class Words:
    """A tokenizer that ignores case and drops white space. Pieces: what stands between white space."""

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    lead = shown_lead = ""

    @staticmethod
    def cut(text: str) -> tuple[str, list[str]]:
        return "", text.split()

    @staticmethod
    def simple(piece: str) -> bool:
        """Whether a piece is one pre-token for certain."""
        return piece.islower() and piece.isalpha()

    @staticmethod
    def plain(piece: str) -> str | None:
        """The piece as the tokenizer's normaliser leaves it; None where that is left to the library."""
        return piece.lower() if narrow(piece) and "İ" not in piece else None


class Bytes:
    """A tokenizer of bytes whose pattern takes a blank with what it stands before. Pieces begin at blanks before visible characters."""

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    #: What every piece but a text's first begins with, which pieces are remembered without; and the letter for it.
    lead, shown_lead = " ", "\u0120"

    @staticmethod
    def cut(text: str) -> tuple[str, list[str]]:
        """The first piece, and the others without their lead."""
        first, *rest = _AWAY.split(text) if _RUN.search(text) else text.split(" ")
        return first, rest

    @staticmethod
    def simple(piece: str) -> bool:
        return piece.isalpha()

    @staticmethod
    def plain(piece: str) -> str | None:
        return piece


class PieceEncoder(dict):
    """Ids (unsigned, 32 bits, little-endian) of pieces, by what follows their lead; pieces not yet met are encoded when
    looked up. Pre-tokens without the lead are remembered apart."""

    def __init__(self, path: str, style: type[Words] | type[Bytes], special_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.style, self.split = Tokenizer.from_file(path), style, Splitter(style.pattern)
        self.tokenizer.encode_special_tokens = special_text
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_text and t.special)]
        #: Finds what the library takes for a token of its own before it splits a text.
        self.added = re.compile("|".join(re.escape(t.content) for t in added), re.IGNORECASE).search if added else None
        self.tokenize = self.tokenizer.model.tokenize
        self.bare: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece with its lead, from those of its pre-tokens."""
        text = self.style.plain(piece)
        if text is None:
            return self.whole(piece)
        found, lead = [], self.style.lead
        for word in self.split(text):
            memo, key = (self, word[len(lead) :]) if word.startswith(lead) else (self.bare, word)
            ids = memo.get(key)
            if ids is None:
                ids = self._model(word.encode().decode("latin-1").translate(_LETTERS))
                if len(key) <= LONGEST:
                    memo[key] = ids
            found.append(ids)
        return b"".join(found)

    def __missing__(self, key: str) -> bytes:
        if len(self) + len(self.bare) >= MEMO:
            self.clear()
            self.bare.clear()
        ids = self._model(self.style.shown_lead + key) if key.isascii() and self.style.simple(key) else self.piece(self.style.lead + key)
        if len(key) <= LONGEST:
            self[key] = ids
        return ids

    def _text(self, text: str) -> bytes:
        if _ODD.search(text) or self.added and self.added(text):
            return self.whole(text)
        first, rest = self.style.cut(text)
        return self.piece(first) + b"".join(map(self.__getitem__, rest))

    def batch(self, texts: list[str]) -> list[bytes]:
        """Unsigned 32-bit little-endian ids of each text."""
        return [self._text(t) for t in texts]


def encoder(kept: dict, path: str, style: type[Words] | type[Bytes], special_text: bool = False) -> PieceEncoder:
    """A worker's encoder; built once, kept between tasks in the caller's `kept`. The strings of special tokens in a text become these tokens, as
    the library does by default, unless `special_text` makes them ordinary text."""
    key = (path, style, special_text)
    if key not in kept:
        kept[key] = PieceEncoder(*key)
    return kept[key]
