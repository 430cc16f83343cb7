"""Whole texts to token ids with the ``tokenizers`` library, one call per distinct piece of text.

Both public BPE files split a text into pieces that are encoded independently.  For texts of plain Latin
characters the pieces of a white-space-free unit do not depend on its neighbours, so a unit's ids are kept in a
bounded table per worker; all other texts, and those that hold an added token's literal, go through ``Tokenizer.encode`` whole.  Ids are the library's in
either case (tests compare the two on every kind of white space).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# Characters for which splitting, lower-casing and normal forms are the same in every Unicode version.
OTHER = regex.compile(r"[^\t\n\r\x0b\x0c\x20-\x7e\xa1-\xffŒœŸ]")
CONTROL = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]")  # those among them that are ASCII
# The split patterns of the two public vocabulary files.
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
TABLE_SIZE = 450_000   # entries of a worker's table of units before it becomes the old one
FIRST_SIZE = 50_000    # entries of the tables of units without a space before them and of pieces that are no words
LONGEST_KEPT = 32      # longer units are encoded each time
CLOSING = ".,;:!?)]}\"*%&$#"  # a letter run followed by these only is two pieces


class _Whole(Exception):
    """The text has white space that a unit cannot be cut at: encode it whole."""


class _Table(dict):
    """Ids by unit: the newest ``most`` units and those of the table before."""

    def __init__(self, encoder: Encoder, before: str, most: int):
        super().__init__()
        self.encoder, self.before, self.most, self.old = encoder, before, most, {}
        self.tokenize, self.space = encoder.model.tokenize, encoder.space if before else ""

    def __missing__(self, unit: str) -> bytes:
        value = self.old.get(unit)
        if value is None:
            if unit.isalpha():  # letters only are one piece
                spelled = unit if unit.isascii() else unit.translate(self.encoder.spelled)
                value = array("I", [t.id for t in self.tokenize(self.space + spelled)]).tobytes()
            else:
                value = self.encoder.odd_unit(unit, self.before)
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = value
        return value


class _Pieces(dict):
    """Ids of the newest ``FIRST_SIZE`` pieces that are no words."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        value = self.encoder.piece(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= FIRST_SIZE:
                self.clear()
            self[piece] = value
        return value


class _Spelled(dict):
    """Characters as the byte-level alphabet spells them, each worked out once."""

    def __init__(self, chars: dict[int, str]):
        super().__init__()
        self.chars = chars

    def __missing__(self, code: int) -> str:
        self[code] = value = "".join(self.chars[b] for b in chr(code).encode())
        return value


class Encoder:
    """``encode(text)`` gives a text's ids as little-endian unsigned 32-bit integers; null is an empty text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path).model
        self.model._resize_cache(0)  # units are kept here instead
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_words = bool(file["model"].get("end_of_word_suffix"))
        added = file.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.never_cut = any(t["normalized"] for t in added)  # such tokens match other spellings as well
        chars = _byte_chars()
        self.spelled = _Spelled(chars)
        self.space = "" if self.by_words else chars[32]
        self.pieces = WORD_PIECES if self.by_words else BYTE_PIECES
        self.first, self.units = _Table(self, "", FIRST_SIZE), _Table(self, " " if self.space else "", TABLE_SIZE)
        self.others = _Pieces(self)

    def piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.translate(self.spelled))]).tobytes()

    def kept(self, piece: str) -> bytes:
        """Ids of a piece, from the tables: words that occur as units are met there."""
        if self.by_words:
            return self.units[piece] if piece.isalpha() else self.others[piece]
        if piece[0] == " " and piece[1:].isalpha():
            return self.units[piece[1:]]
        return self.first[piece] if piece.isalpha() else self.others[piece]

    def odd_unit(self, unit: str, before: str) -> bytes:
        """Ids of a unit of more than plain letters, after a space or (``before`` empty) without one."""
        word = unit.rstrip(CLOSING)
        if word.isalpha():
            return (self.units if before or self.by_words else self.first)[word] + self.others[unit[len(word):]]
        if not self.by_words and not (unit and unit.isprintable()):
            if not unit or unit[0].isspace() or unit[-1].isspace() or CONTROL.search(unit):
                raise _Whole
            first, *lines = unit.split("\n")
            if lines and first.isprintable() and first and all(x and x.isprintable() for x in lines):  # a single line end is a piece
                begun = self.units[first] if before else self.first[first]
                return self.others["\n"].join([begun, *map(self.first.__getitem__, lines)])
        return b"".join(map(self.kept, self.pieces.findall(before + unit)))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.never_cut or any(t in text for t in self.added):  # the library finds added tokens before it splits
            return self.whole(text)
        if (self.by_words or not text.isascii()) and OTHER.search(text):
            return self.whole(text)
        if self.by_words:
            return b"".join(map(self.units.__getitem__, text.lower().split()))
        first, *rest = text.split(" ")
        try:
            return self.first[first] + b"".join(map(self.units.__getitem__, rest))
        except _Whole:
            return self.whole(text)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = {b for b in range(256) if chr(b) in set(ByteLevel.alphabet())}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees the tables of this worker."""
    _ENCODERS.clear()


def in_slices(rows: Iterator, size, most: int = 8 << 20) -> Iterator[list]:
    """Lists of consecutive rows whose ``size(row)`` sums to about ``most`` at most."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part
