"""What the operators share: the shared folder, written tables, and batches of rows."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python code at a time, so that a batch of long texts stays small.
ROWS = 256
#: What a null id counts as: it stands before all others.
LEAST = -(1 << 63)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only, so other columns can't clash; a null text counts as empty."""
    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))


def text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart, as two numbers."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def identity(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """key, sub, sub2: the identity of rows for all operators that order or join documents.

    A row is a document of its own, known and ordered by its id, null ids before all others, then by 128 bits of its
    text.  So rows that share an id, or have none, are told apart and are no hot key; rows that agree in id and text are
    one document.
    """
    subs = text_hashes(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    return [F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(LEAST)).alias("key"), subs[0].alias("sub"), subs[1].alias("sub2")]


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, sub, sub2 and text, a null text being empty."""
    return df.select(*identity(id_col, text_col), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column's name as a reference, whatever dots or quotes it has."""
    return "`" + name.replace("`", "``") + "`"


def mapped(df: DataFrame, run) -> DataFrame:
    """mapInArrow to rows of the same columns, whatever their names; run meets them by place."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return _own[key]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def releasing_shuffles(spark: SparkSession):
    """Shuffle files of what runs in here go as soon as its result is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with releasing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete written tables that no later plan reads."""
    for x in frames:
        for path in [x] if isinstance(x, str) else x.inputFiles()[:1]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path if isinstance(x, str) else path.rpartition("/")[0])
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def size_of(df: DataFrame) -> int:
    """Bytes of the files that a table is read from, by Spark's own statistics; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def partitions_for(df: DataFrame, mb: int = 64) -> int:
    """As many partitions as keep each at about mb of input: the session's number at least, 200,000 at most."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size_of(df) // (mb << 20), 200_000))


def buckets_for(df: DataFrame, partitions: int, mb: int = 16) -> int:
    """Two buckets a partition, which are dealt by hash, or as many as keep a bucket at about mb of input."""
    return partitions * max(2, -(-size_of(df) // (partitions * mb << 20)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
