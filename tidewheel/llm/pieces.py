"""Splitting text into the pieces that byte-pair merges stay within, and bounded tables of pieces.

The result of a byte-pair encoder on a text is the concatenation of its results on the pieces, so a
table from piece to result encodes a corpus with one library call for each different piece.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import struct

import regex

#: White space of the tokenizers' patterns (Unicode White_Space), spelled out as regex engines differ.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Characters on which Unicode versions, normal forms and lower-casing rules all agree.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u012f\u0132-\u017e\u2010-\u2027\u2030-\u205e]")


#: Letters and digits among the plain characters, and the two patterns for texts of plain characters only.
_L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BYTE_LEVEL = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\\t\\n\\r {_L}{_N}]+|[\\t\\n\\r ]+(?![^\\t\\n\\r ])|[\\t\\n\\r ]+")
_WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\\t\\n\\r {_L}{_N}]+")


def odd(text: str) -> bool:
    """Whether the text has characters that only the library itself should split."""
    return _ODD.search(text) is not None


@functools.cache
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s+", f"[{WHITE}]+"))


def byte_level():
    import public_tokenizers

    return splitter(public_tokenizers.PATTERN)


def byte_level_pieces(text: str) -> list[str]:
    """The matches of the byte-level pattern, by the shorter pattern where it says the same."""
    return byte_level().findall(text) if odd(text) else _BYTE_LEVEL.findall(text)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table(dict):
    """From piece to value, made at need; it is emptied when full, and long pieces are not kept."""

    every: list[Table] = []

    def __init__(self, make, entries: int = 600_000, longest: int = 12):
        super().__init__()
        self.every.append(self)
        self.make, self.entries, self.longest = make, entries, longest

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value


def keep_only(*tables: Table) -> None:
    """Empty all other tables: a Python worker goes from operator to operator and would hold those of each."""
    for t in Table.every:
        if t and all(t is not k for k in tables):
            t.clear()
            trim()


def trim() -> None:
    """Give memory that is free back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Library:
    """The tokenizers library over whole texts: ids as little-endian unsigned integers of width bytes.

    Texts with special strings or characters outside the plain set go to the library whole; of the
    others, every different piece goes to it once.  Both give the library's ids.
    """

    def __init__(self, path: str, words: bool = False, width: int = 4):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size, self.width = self.tokenizer.get_vocab_size(), width
        if self.size > 1 << 8 * width:
            raise ValueError(f"ids of {self.size} tokens don't fit {width} bytes")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.words, self.split = words, _WORDS if words else _BYTE_LEVEL
        self.table = Table(self.whole, entries=650_000, longest=14)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if odd(text) or self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.table.__getitem__, self.split.findall(text.lower() if self.words else text)))


@functools.cache
def library(path: str, words: bool = False, width: int = 4) -> Library:
    return Library(path, words, width)
