"""Exact token counts of every prefix, by dynamic programming over byte positions.

In a byte-pair encoding with ordered merges, a sequence of tokens is the encoding of its bytes if and
only if each two neighbours are the encoding of theirs.  So exactly one token can end the encoding of
each prefix, and the count of a prefix is one more than the count of the prefix before that token.  The
table over a piece is filled left to right; a text's table is that of its pieces, with runs of white
space, which the split pattern cuts by what follows them, filled as if the text ended there.  A text's count is the sum of
the last entries of its pieces' tables; where a budget cuts a text is read off the tables about the piece that
exceeds it, without encoding anything again.

Defined results: a null or empty text has 0 tokens; a special string counts as the one token that the
library makes of it; rows of equal doc_id are counted one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.common import batch, documents, slices, table
from tidewheel.llm.pieces import WHITE, Table, byte_level, byte_level_pieces, vocabulary

LIMIT = 512
_BLANK = regex.compile(f"[{WHITE}]+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """merges: pairs of byte strings in rank order; special: strings that are one token wherever they stand."""

    def __init__(self, vocab: set[bytes], merges: list[tuple[bytes, bytes]], special: list[str]):
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.vocab, self.special = vocab, special
        self.longest = max(map(len, vocab))
        self.fits = Table(self._fits, entries=300_000, longest=2)
        self.counts = Table(lambda piece: int(self.piece(piece.encode())[-1]), entries=1_000_000, longest=14)
        self.split = byte_level()
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) or r"(?!)")

    @classmethod
    def from_file(cls, path: str) -> PrefixCounter:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        return cls({as_bytes(t) for t in spec["model"]["vocab"] if t not in special}, [(as_bytes(a), as_bytes(b)) for a, b in merges], special)

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding of a short byte string, by its merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), len(self.ranks)), i) for i in range(len(parts) - 1))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        return self.merge(pair[0] + pair[1]) == list(pair)

    def piece(self, data: bytes) -> list[int]:
        """Counts of the prefixes of one piece, by bytes: entry i is that of the first i bytes."""
        n, vocab, fits = len(data), self.vocab, self.fits
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                token = data[j:i]
                if token in vocab and ((j == 0 and self.merge_is_one(token)) or (j and fits[(last[j], token)])):
                    counts[i], last[i] = counts[j] + 1, token
                    break
            else:
                raise ValueError(f"no token ends at byte {i}")
        return counts

    @functools.lru_cache(maxsize=100_000)  # noqa: B019  one counter lives as long as its worker
    def merge_is_one(self, token: bytes) -> bool:
        return len(self.merge(token)) == 1

    def count(self, text: str) -> int:
        """The tokens of the text: the last entry of its prefix table."""
        parts = [text]
        for s in self.special:
            parts = [x for p in parts for x in p.split(s)]
        total = len(parts) - 1
        for p in parts:
            total += sum(map(self.counts.__getitem__, byte_level_pieces(p)))
        return total

    def prefixes(self, text: str) -> np.ndarray:
        """Entry i is the exact number of tokens of text[:i], for i from 0 to len(text).

        Within a special string, and where a contraction is cut short, the prefix is split anew from
        the last boundary that no longer moves.
        """
        out = np.zeros(len(text) + 1, np.uint32)
        special = [m for m in self._specials(text)]
        at, base = 0, 0
        for begin, end in [*special, (len(text), None)]:
            self._plain(text[at:begin], out[at : begin + 1], base)
            if end is None:
                break
            for i in range(begin + 1, end):
                out[i] = self.count(text[at:i]) + base
            base = int(out[begin]) + 1
            out[end], at = base, end
        return out

    def _specials(self, text: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.special_at.finditer(text))

    def _pieces(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Begin, end and number of tokens of each piece, special strings being one."""
        at = 0
        for begin, end in [*self._specials(text), (len(text), len(text))]:
            for piece in byte_level_pieces(text[at:begin]):
                yield at, at + len(piece), self.counts[piece]
                at += len(piece)
            if begin < end:
                yield begin, end, 1
            at = end

    def _plain(self, text: str, out: np.ndarray, base: int) -> None:
        out[0], total, ran = base, base, 0
        for piece_match in self.split.finditer(text):
            begin, end = piece_match.span()
            blank = _BLANK.match(text, begin)
            solid = blank.end() if blank else begin
            if blank and begin >= ran:  # a prefix that ends in a run of white space ends in one piece of it
                ran = solid
                out[begin + 1 : ran + 1] = total + self._by_char(blank.group())[1:]
            piece = piece_match.group()
            counts = self._by_char(piece)
            if solid < end:
                out[solid + 1 : end + 1] = total + counts[solid - begin + 1 :]
            if piece[0] == "'" and len(piece) > 2 and piece[1:].isalpha():  # 'll cut after one letter
                out[begin + 2] = total + sum(map(self.counts.__getitem__, self.split.findall(piece[:2])))
            total += int(counts[-1])

    def _by_char(self, piece: str) -> np.ndarray:
        ends = np.cumsum([0, *(len(c.encode()) for c in piece)])
        return np.asarray(self.piece(piece.encode()), np.uint32)[ends]

    def truncate(self, text: str, budget: int) -> int:
        """The length of the longest prefix of at most budget tokens whose longer ones all exceed it.

        It ends near the piece at which the sum of counts exceeds the budget: pieces before it are within, and what comes
        after the next two has a prefix that exceeds it.  So only the tables of five pieces are looked at.
        """
        total, recent, pieces = 0, deque([(0, 0)], maxlen=3), self._pieces(text)
        for begin, end, n in pieces:
            recent.append((begin, total))
            total += n
            if total > budget:
                (at, base), end = recent[0], max([end, *(e for _, e, _ in islice(pieces, 2))])
                return at + int(np.flatnonzero(self.prefixes(text[at:end]) + base <= budget)[-1])
        return len(text)


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter.from_file(path)


def prefix_counts(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and counts: the tokens of text[:i] for every i, as an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = counter(tokenizer or vocabulary("byte_bpe_50k.json")), pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int32()))])
        for b in slices(batches, 16):
            yield batch(schema, b.column(0), [c.prefixes(t).astype(np.int32) for t in b.column(1).to_pylist()])

    return documents(df).mapInArrow(run, "doc_id long, counts array<int>")


def token_counts(df: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and within_limit: how many characters the limit leaves of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer or vocabulary("byte_bpe_50k.json"))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("within_limit", pa.int64())])
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            within = [c.truncate(t, limit) if x > limit else len(t) for t, x in zip(texts, n, strict=True)]
            yield batch(schema, b.column(0), [len(t.encode()) for t in texts], n, [x > limit for x in n], within)

    return documents(df).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, within_limit long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
