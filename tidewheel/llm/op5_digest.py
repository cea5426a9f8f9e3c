"""Quartile bucket digests of documents.

Every three neighbouring bytes of a text are hashed to one of 256 buckets and counted.  The digest holds
the text's length, on a logarithmic scale, in one byte, and for each bucket the quartile of its count
among all buckets in two bits, in hexadecimal digits.  The difference of two digests is a bounded score: 0
to 6 for each bucket by how many quartiles lie between, plus the distance of the lengths up to a cap.
Likeness is 1 for equal digests and falls to 0 at the score that unrelated texts reach.

The edited text of a document takes its second half from the next one.  For that, documents are dealt to
ranges of (id, hash of the text), cut at quantiles of a sample, so outlying, null or shared ids make no range
larger than others; the first document of each range is also given to the range before.  Within a range a
stream of rows keeps only the one before.  Ranges follow the input's size, up to RANGES, with SAMPLES rows of the
sample each; the sample only places the cuts and has no bearing on the result.

Defined results: a null text is empty; an empty text has the digest with no counts; texts of one or two
bytes count one triplet, filled up with zeros; null ids come before all others; of documents that share
an id, the order is that of hashes of their texts, and equal rows follow each other; a single document is its
own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import LEAST, batch, identified, partitions_for, slices, table

BUCKETS = 256
RANGES, SAMPLES = 50_000, 50
#: Scores at which the parts of a difference are cut off, and the one at which likeness is 0.
LENGTH_CAP, UNLIKE = 40, 400
_LETTERS = np.array([np.random.default_rng(k).permutation(256).astype(np.uint8) for k in (11, 12, 13)])


def digests(texts: list[bytes]) -> np.ndarray:
    """A row of 65 bytes for each text: its length, then its buckets, four to a byte."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for i, t in enumerate(texts):
        if t:
            a = np.frombuffer(t.ljust(3, b"\0"), np.uint8)
            counts[i] = np.bincount(_LETTERS[0][a[:-2]] ^ _LETTERS[1][a[1:-1]] ^ _LETTERS[2][a[2:]], minlength=BUCKETS)
    ranked = np.sort(counts, axis=1)
    codes = sum((counts > ranked[:, k : k + 1]).astype(np.uint8) for k in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    packed = codes[:, 0::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    length = np.rint(np.log(np.array([len(t) for t in texts]) + 1.0) / np.log(1.2)).astype(np.uint8)
    return np.concatenate([length[:, None], packed], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of rows of a against rows of b."""
    length = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), LENGTH_CAP)
    apart = np.zeros(len(a), np.int64)
    for shift in (6, 4, 2, 0):
        d = np.abs((a[:, 1:] >> shift & 3).astype(np.int8) - (b[:, 1:] >> shift & 3).astype(np.int8))
        apart += (d + 3 * (d == 3)).sum(axis=1)
    return apart + length


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.minimum(difference(a, b), UNLIKE) / UNLIKE


def _cuts(docs: DataFrame, rows: int, n: int) -> list[tuple[int, int]]:
    """The first (key, sub) of every range but the first; all are rows of the table."""
    sample = docs.select("key", "sub").sample(min(1.0, SAMPLES * n / max(rows, 1)), 7).toPandas()  # about SAMPLES * n rows of two numbers
    sample = sample.sort_values(["key", "sub"])
    return sorted({(int(sample["key"].iloc[i]), int(sample["sub"].iloc[i])) for i in (len(sample) * k // n for k in range(1, n))}) if len(sample) else []


def _place(cuts: list[tuple[int, int]]):
    """A pandas UDF: the range of key and sub."""
    keys, subs = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def place(key: pd.Series, sub: pd.Series) -> pd.Series:
        k, s = key.to_numpy(), sub.to_numpy()
        low, high = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
        for i in np.flatnonzero(low < high):  # cuts within an id
            low[i] += np.searchsorted(subs[low[i] : high[i]], s[i], "right")
        return pd.Series(low.astype(np.int32))

    return place


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in streams: range, tail, key, text, sorted; a tail is the first document of the next range."""
    spark, docs = df.sparkSession, identified(df, id_col, text_col)
    whole = docs.agg(F.count("*").alias("n"), F.min(F.struct("key", "sub")).alias("least")).first()
    cuts = _cuts(docs, whole["n"], min(partitions_for(df, 16), RANGES))
    least = [tuple(whole["least"])] if whole["n"] else []
    if least and cuts and cuts[0] == least[0]:
        cuts = cuts[1:]
    place, n = _place(cuts), len(cuts) + 1
    placed = docs.withColumn("range", place("key", "sub"))
    # of each range the first document of the next; the last one is followed by the first of all: at most RANGES rows
    tails = spark.createDataFrame([(i, *c) for i, c in enumerate([*cuts, *least])], "before int, key long, sub long")
    tail = docs.join(F.broadcast(tails), ["key", "sub"]).groupBy("before").agg(F.min(F.struct("key", "sub", "sub2", "text")).alias("t"))
    columns = ("key", "sub", "sub2", "text")
    both = placed.select("range", F.lit(0).alias("tail"), *columns).unionByName(tail.select(F.col("before").alias("range"), F.lit(1).alias("tail"), *[F.col(f"t.{c}") for c in columns]))
    return both.repartitionById(n, "range").sortWithinPartitions("range", "tail", "key", "sub", "sub2").select("range", "tail", "key", "text")


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, the sha256 and digest of its edited text, its digest, and two likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in slices(batches):
            pairs = []
            for r, tail, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] == r:
                    pairs.append((last[1], last[2], text))
                last = None if tail else (r, key, text)
            if not pairs:
                continue
            edited = [(t[: len(t) - len(t) // 2] + following[: len(t) // 2]).encode() for _, t, following in pairs]
            own = digests([t.encode() for _, t, _ in pairs] + [pairs[-1][2].encode()])
            if any(a[2] is not b[1] for a, b in zip(pairs, pairs[1:], strict=False)):  # a range ends within the slice
                after = digests([p[2].encode() for p in pairs])
                own = own[:-1]
            else:
                own, after = own[:-1], own[1:]
            changed = digests(edited)
            yield batch(
                _SCHEMA,
                [None if k == LEAST else k for k, _, _ in pairs],
                [len(t) for _, t, _ in pairs],
                [hashlib.sha256(e).hexdigest() for e in edited],
                [x.tobytes().hex() for x in own],
                [x.tobytes().hex() for x in changed],
                likeness(own, changed),
                likeness(own, after),
            )

    return with_next(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
