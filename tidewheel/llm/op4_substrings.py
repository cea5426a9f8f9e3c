"""Removing word windows that occur earlier in the corpus, by difference-cover anchors.

The residues {0, 1, 3, 9} modulo 13 are a difference cover: whatever two positions are, some shift
below 13 takes both to a residue of the cover.  So two equal windows of 20 words share an anchor, 8 words
at a cover position, at one place within both.

1. Anchors: hashes of 8 words at cover positions, 4 of 13 positions, meet by hash.  A slice of
   documents sends each hash once, so a passage that a third of the documents hold meets as one entry for
   each slice.  What comes back to a document is where it has a repeated anchor.
2. Extension: the windows that hold a repeated anchor, a small part of all, meet by the 128-bit hash of
   their 20 words, again once a slice; all but the earliest occurrence are repeats.
3. Removal: each document drops the words that its repeated windows cover.

Documents with the same words as an earlier one are told by their hash in step 1 and take no part in
step 2: each of their windows starts earlier.

Defined results: a null text has no words; a text of fewer than 20 words keeps all; null ids come before
all others; documents that share an id are ordered by a hash of their text, and of rows that agree in
both neither is earlier; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.blobs import dealt, joined, ordered, pack, signed
from tidewheel.llm.common import LEAST, batch, buckets_for, partitions_for, quoted, slices, table, written
from tidewheel.llm.pieces import trim
from tidewheel.llm.words import BASES, Slice, mixed, runs

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
SLICE = 500
#: Bits of a text's hash that go with an id where documents are dealt and marked, so that a shared id is no hot key.
TAG = (1 << 24) - 1
_U = np.uint64
_BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
#: kinds of blobs: anchors and whole documents that meet, and anchors and documents known to be repeated
_ANCHOR, _WHOLE, _KNOWN, _COPY = range(4)


def _keyed(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """row (the other columns), key (the id, null as the least number), sub (a hash of the text), text, bucket."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    key = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(LEAST))
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns if c != text_col] or [F.lit(0).alias("none")])
    keyed = df.select(row.alias("row"), key.alias("key"), F.xxhash64(text).alias("sub"), text.alias("text"))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("key", F.col("sub").bitwiseAND(F.lit(TAG))), F.lit(buckets)).cast("int"))


def _marks(keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """A number for each document's id and tag; documents that share one are looked at more closely than they need."""
    return mixed(keys + mixed(tags + _U(1)))


def _first(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by keys, then order; a number for each run of equal keys; the size of each run."""
    rows = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = np.any([k[rows][1:] != k[rows][:-1] for k in keys], axis=0)
    run = np.cumsum(new) - 1
    return rows, run, np.bincount(run, minlength=1)


def _anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    width = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.isin(np.arange(PERIOD), COVER)
        for b in slices(batches, SLICE):
            s = Slice(b.column(2).to_pylist())
            keys, subs = ordered(b.column(0).to_numpy()), ordered(b.column(1).to_numpy())
            at = np.flatnonzero(s.whole(width) & inside[s.place[: max(0, len(s.hashes) - width + 1)] % PERIOD])
            at = at[s.counts[s.document[at]] >= window]
            hashes = mixed(runs(s.hashes, width, BASES[0])[at]) >> _U(16)
            rows, group, sizes = _first([hashes], [at])
            at, hashes, many = at[rows], hashes[rows], (sizes > 1)[group]
            first = np.ones(len(at), bool)
            first[1:] = group[1:] != group[:-1]
            out = []
            for kind, take in ((_ANCHOR, first), (_KNOWN, many & ~first)):
                i = at[take]
                key, place = keys[s.document[i]], s.place[i].astype(np.uint64)
                tag = subs[s.document[i]] & _U(TAG)
                if kind == _ANCHOR:
                    flag = many[take].astype(np.uint64)
                    out += [(p, kind, x) for p, x in dealt((hashes[take] % _U(parts)).astype(np.int64), hashes[take], key, tag, place, flag)]
                elif len(i):
                    out.append((int(key[0] % _U(parts)), kind, pack(key, tag, place)))
            full = np.flatnonzero(s.counts >= window)
            digests = [xxhash.xxh3_128_intdigest(b" ".join(s.words[i])) for i in full]
            high, low = (np.array([d >> k & (1 << 64) - 1 for d in digests], np.uint64) for k in (64, 0))
            if len(full):
                whole = _earliest(high, low, keys[full], subs[full])
                out += [(p, _WHOLE, x) for p, x in dealt((whole[0] % _U(parts)).astype(np.int64), *whole)]
            late = _later(high, low, keys[full], subs[full])
            if len(late):
                out.append((int(keys[full][late[0]] % _U(parts)), _COPY, pack(keys[full][late], subs[full][late])))
            yield batch(_BLOB, *(zip(*out, strict=True) if out else [[]] * 3))
        trim()

    return docs.select("key", "sub", "text").mapInArrow(run, "part int, kind int, blob binary")


def _later(high: np.ndarray, low: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Rows whose key (high, low) an earlier row, with another order, has too."""
    rows, group, _ = _first([high, low], list(order))
    if not len(rows):
        return rows
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = rows[begins][group]
    return rows[np.any([o[rows] != o[least] for o in order], axis=0)]


def _earliest(high: np.ndarray, low: np.ndarray, *order: np.ndarray) -> list[np.ndarray]:
    rows, group, _ = _first([high, low], list(order))
    begins = rows[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))]
    return [x[begins] for x in (high, low, *order)]


def _by_part(df: DataFrame, n: int, finish, schema: str) -> DataFrame:
    """finish(kinds to blobs) for every part, as soon as the last of its rows has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for part, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    if held:
                        yield from finish(held)
                    now, held = part, {}
                held.setdefault(kind, []).append(blob)
        if held:
            yield from finish(held)

    return df.repartitionById(n, "part").sortWithinPartitions("part").mapInArrow(run, schema)


_FLAG = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_FLAGS = "bucket int, kind int, blob binary"


def _bucket_column(keys: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark's xxhash64 gives each key and tag."""
    values, back = np.unique(np.stack([keys, tags], axis=1), axis=0, return_inverse=True)
    raw = np.stack([signed(values[:, 0]), values[:, 1].view(np.int64)], axis=1).astype("<i8").tobytes() if len(values) else b""
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(raw[i + 8 : i + 16], digest(raw[i : i + 8], 42)) for i in range(0, len(raw), 16)], np.uint64).view(np.int64)
    return (own % buckets)[back.ravel()]


def _repeated_anchors(anchors: DataFrame, n: int, buckets: int) -> DataFrame:
    """By bucket: places of repeated anchors (kind _KNOWN: key, tag, place), later copies (kind _COPY: key, sub)."""

    def finish(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        out = []
        if _ANCHOR in held:
            hashes, keys, tags, places, flags = joined(held[_ANCHOR], 5)
            rows, group, sizes = _first([hashes], [keys])
            flagged = np.bincount(group, flags[rows], len(sizes)) > 0 if len(rows) else sizes > 0
            rows = rows[((sizes > 1) | flagged)[group]]
            out += [(b, _KNOWN, x) for b, x in dealt(_bucket_column(keys[rows], tags[rows], buckets), keys[rows], tags[rows], places[rows])]
        if _KNOWN in held:
            keys, tags, places = joined(held[_KNOWN], 3)
            out += [(b, _KNOWN, x) for b, x in dealt(_bucket_column(keys, tags, buckets), keys, tags, places)]
        copies = joined(held[_COPY], 2) if _COPY in held else [np.zeros(0, np.uint64)] * 2
        if _WHOLE in held:
            high, low, keys, subs = joined(held[_WHOLE], 4)
            late = _later(high, low, keys, subs)
            copies = [np.concatenate([a, b[late]]) for a, b in zip(copies, (keys, subs), strict=True)]
        out += [(b, _COPY, x) for b, x in dealt(_bucket_column(copies[0], copies[1] & _U(TAG), buckets), *copies)]
        yield batch(_FLAG, *(zip(*out, strict=True) if out else [[]] * 3))

    return _by_part(anchors, n, finish, _FLAGS)


def _held(flags: pa.Table, kind: int) -> list[np.ndarray]:
    mine = [b for k, b in zip(flags["kind"].to_pylist(), flags["blob"].to_pylist(), strict=True) if k == kind]
    return joined(mine, 2 if kind == _COPY else 3)


def _windows(docs: DataFrame, flags: DataFrame, window: int, parts: int) -> DataFrame:
    """Windows that hold a repeated anchor, of documents that aren't later copies; once a slice each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, copies = _held(right, _KNOWN), _held(right, _COPY)
        gone = set(zip(copies[0].tolist(), copies[1].tolist(), strict=True))
        keys, subs = ordered(left["key"].to_numpy()), ordered(left["sub"].to_numpy())
        marked = _marks(known[0], known[1])
        order = np.lexsort([known[2], marked])
        marked, places, own = marked[order], known[2][order].astype(np.int64), _marks(keys, subs & _U(TAG))
        begins, ends = np.searchsorted(marked, own), np.searchsorted(marked, own, "right")
        keep = [i for i, x in enumerate(zip(keys.tolist(), subs.tolist(), strict=True)) if begins[i] < ends[i] and x not in gone]
        out = []
        for j in range(0, len(keep), SLICE):
            mine = np.array(keep[j : j + SLICE])
            s = Slice(left["text"].take(pa.array(mine)).to_pylist())
            n = max(0, len(s.hashes) - window + 1)
            edge = np.zeros(len(s.hashes) + 1, np.int64)
            for k, i in enumerate(mine):
                p = places[begins[i] : ends[i]]
                p = p[p < s.counts[k]]  # of a document with the same mark
                np.add.at(edge, s.begins[k] + np.maximum(0, p - (PERIOD - 1)), 1)
                np.add.at(edge, s.begins[k] + p + 1, -1)
            at = np.flatnonzero(s.whole(window) & (np.cumsum(edge)[:n] > 0))
            high, low = (mixed(runs(s.hashes, window, b)[at]) for b in BASES)
            key, sub, place = keys[mine][s.document[at]], subs[mine][s.document[at]], s.place[at].astype(np.uint64)
            late = _later(high, low, key, sub, place)
            if len(late):
                out.append((int(key[late[0]] % _U(parts)), _KNOWN, pack(key[late], sub[late], place[late])))
            if len(at):
                first = _earliest(high, low, key, sub, place)
                out += [(p, _ANCHOR, x) for p, x in dealt((first[0] % _U(parts)).astype(np.int64), *first)]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, _BLOB, strict=True)], schema=_BLOB)

    return docs.select("bucket", "key", "sub", "text").groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(run, "part int, kind int, blob binary")


def _repeated_windows(windows: DataFrame, n: int, buckets: int) -> DataFrame:
    def finish(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        found = joined(held[_KNOWN], 3) if _KNOWN in held else [np.zeros(0, np.uint64)] * 3
        if _ANCHOR in held:
            high, low, *order = joined(held[_ANCHOR], 5)
            late = _later(high, low, *order)
            found = [np.concatenate([a, b[late]]) for a, b in zip(found, order, strict=True)]
        out = [(b, _WHOLE, x) for b, x in dealt(_bucket_column(found[0], found[1] & _U(TAG), buckets), *found)]
        yield batch(_FLAG, *(zip(*out, strict=True) if out else [[]] * 3))

    return _by_part(windows, n, finish, _FLAGS)


def _removed(docs: DataFrame, repeats: DataFrame, window: int, digest: bool) -> DataFrame:
    """row, n_words, n_removed and kept: the words that are left, or their digest."""
    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies, marks = _held(right, _COPY), _held(right, _WHOLE)
        gone = set(zip(copies[0].tolist(), copies[1].tolist(), strict=True))
        of = _marks(marks[0], marks[1])  # the whole hash of the text is there
        order = np.lexsort([marks[2], of])
        marked, places = of[order], marks[2][order].astype(np.int64)
        keys, subs = ordered(left["key"].to_numpy()), ordered(left["sub"].to_numpy())
        own, out = _marks(keys, subs), []
        begins, ends = np.searchsorted(marked, own), np.searchsorted(marked, own, "right")
        for i, text in enumerate(left["text"].to_pylist()):
            words = text.encode().split()
            removed, kept = 0, words
            if len(words) >= window and (int(keys[i]), int(subs[i])) in gone:
                removed, kept = len(words), []
            elif len(words) >= window:
                p = places[begins[i] : ends[i]]
                if len(p):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                    removed = len(words) - len(kept)
            value = hashlib.sha256(b" ".join(kept)).hexdigest() if digest else text if not removed else b" ".join(kept).decode()
            out.append((len(words), removed, value))
        new = [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, schema, strict=True)]
        return pa.table([left["row"].combine_chunks(), *new], names=["row", *schema.names])

    row = T.StructType([docs.schema["row"]])
    out = row.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return docs.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(run, out)


def _kept(df: DataFrame, id_col: str, text_col: str, window: int, digest: bool) -> DataFrame:
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    n = partitions_for(df, 16)
    buckets = buckets_for(df, n)
    docs = _keyed(df, id_col, text_col, buckets)
    flags = written(_repeated_anchors(_anchors(docs, window, n), n, buckets), "anchors")
    repeats = written(_repeated_windows(_windows(docs, flags, window, n), n, buckets), "windows")
    both = repeats.unionByName(flags.where(F.col("kind") == _COPY))
    return _removed(docs, both, window, digest)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with the text that is left, their other columns, n_words and n_removed.

    Texts that lose nothing stay as they are (null ones become empty); of others the kept words are joined by
    one space.  Columns named n_words or n_removed are replaced.
    """
    kept = _kept(df, id_col, text_col, window, False)
    own = [c for c in df.columns if c not in ("n_words", "n_removed")]
    return kept.select(*[(F.col("kept") if c == text_col else F.col(f"row.{quoted(c)}")).alias(c) for c in own], "n_words", "n_removed")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the sha256 of the kept words joined by one space."""
    kept = _kept(df.select(quoted(id_col), quoted(text_col)), id_col, text_col, window, True)
    return kept.select(F.col(f"row.{quoted(id_col)}").cast("long").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Windows by their words, with the same result.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20
), h AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM s
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h
), c AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM r WHERE k > 1 GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS n_gone,
         CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_sort(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i))), lambda i: ws[i]) END AS kept
  FROM w LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
