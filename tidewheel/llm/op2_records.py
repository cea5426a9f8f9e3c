"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

A record of a shard file is

    length of the payload, unsigned 64-bit | masked crc32 of those 8 bytes | payload | masked crc32 of the payload | newline

with all numbers little-endian.  A payload is the document's id (signed 64-bit), one byte that is 1 if
that id is null, one byte with the width of an id (2 where the vocabulary allows it, else 4), and the
ids.  A crc is masked as in common record formats (rotated by 15 bits, plus a constant), so that
checksums of data that hold checksums stay useful.  The newline is the separator that Spark's text
writer puts after a row, through which shards reach any file system with Spark's own commit protocol.

Shards are in ascending order of doc_id, within and between files, and of their numbers, which are more than
their names once there are 100,000.  Rows of one id are in the order of hashes of their text, so a shared id may
go on in the next shard.  The index is a table with a row
for each record: shard, position, doc_id, offset and length of the record, and the number of ids.

Defined results: a null text is an empty one and gives the end id only; null ids of documents come
first (the least long counts as null); documents of equal id keep one record each, equal rows too; an empty table gives no shards and an empty index.
Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import LEAST, batch, identified, new_path, partitions_for, releasing_shuffles, slices, table
from tidewheel.llm.pieces import keep_only, library, vocabulary

MASK = 0xA282EAD8
HEAD, TAIL, BODY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qBB")
END_ID = 2
_INDEX = "shard string, position long, doc_id long, offset long, length long, n_tokens long, ids_crc32 long"


class BadRecord(ValueError):
    """A record whose length, checksum or separator is wrong."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its newline; ids: little-endian, width bytes each."""
    payload = BODY.pack(doc_id or 0, doc_id is None, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def _width(path: str, end_id: int) -> int:
    """Bytes of an id: 2 if the vocabulary and the end id allow it, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def unframe(data: bytes, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The document's id, the ids as unsigned 32-bit integers, and where the next record begins."""
    if offset + HEAD.size > len(data):
        raise BadRecord(f"record at {offset}: cut short")
    size, check = HEAD.unpack_from(data, offset)
    if masked(data[offset : offset + 8]) != check:
        raise BadRecord(f"record at {offset}: wrong checksum of the length")
    body = offset + HEAD.size
    payload = data[body : body + size]
    end = body + size + TAIL.size
    if len(payload) < size or len(data) <= end or masked(payload) != TAIL.unpack_from(data, body + size)[0] or data[end] != 10:
        raise BadRecord(f"record at {offset}: wrong checksum or end")
    doc_id, null, width = BODY.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=BODY.size).astype("<u4"), end + 1


def write_records(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode documents and write shards to path/data, in ascending order of doc_id, and path/index."""
    spark, width = df.sparkSession, _width(tokenizer or vocabulary("byte_bpe_50k.json"), end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer or vocabulary("byte_bpe_50k.json"), width=width)
        keep_only(lib.table)
        last, schema = lib.packed([end_id]), pa.schema([("value", pa.binary())])
        for b in slices(batches):
            yield batch(schema, [frame(None if d == LEAST else d, lib.encode(t) + last, width) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    ordered = identified(df).repartitionByRange(partitions_for(df), "key", "sub").sortWithinPartitions("key", "sub", "sub2").select("key", "text")
    with releasing_shuffles(spark):
        ordered.mapInArrow(encode, "value binary").select(F.col("value").cast("string")).write.text(f"{path}/data")
        scan(spark, path).write.parquet(f"{path}/index")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Read every shard, checking every record: one index row each, with the crc32 of its ids."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("position", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, at, rows = data.as_py(), 0, []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    rows.append((name, len(rows), doc_id, at, after - at, len(ids), zlib.crc32(ids.tobytes())))
                    at = after
                yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 7))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(parse, _INDEX)


def read_at(shard: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard by its index entry, as a shuffled reader wants it."""
    return unframe(shard, offset)[:2]


def read_shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """The index in a random order that depends on the seed alone: what a training reader walks."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index").orderBy(F.xxhash64("shard", "position", F.lit(seed)), "shard", "position")


def shard_number(shard):
    """The number in a shard's name: names of more than five digits don't sort as their numbers do."""
    return F.regexp_extract(shard, r"^part-(\d+)", 1).cast("long")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the index that reading the files back has made: doc_id, start, n_tokens, ids_crc32.

    start is a running sum: within shards, each of a bounded size, plus what earlier shards hold,
    one row a shard.
    """
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    per_shard = index.groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = per_shard.select("shard", (F.sum("held").over(Window.orderBy(shard_number("shard"))) - F.col("held")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("position")) - F.col("n_tokens")
    rows = index.withColumn("within", within).join(before, "shard")
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    write_records(table(spark, sf_dir, "documents"), path)
    return starts(spark, path)
