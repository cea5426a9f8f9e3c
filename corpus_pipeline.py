"""A corpus pipeline: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage is given the documents that the one before kept and returns those it keeps, with the columns of
documents; the last returns their places in training sequences.  run() writes each stage's rows to the shared
folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import op1_pii, op3_jaccard, op4_substrings, op8_toxicity, op10_pack
from tidewheel.llm.common import identity, quoted, table, written

#: Near duplicates share four fifths of their shingles of five words.
SHINGLE, NUM, DEN = 5, 8, 10


#: Whether a text has words, white space being that of operator 3.
_HAS_WORDS = r"coalesce(text rlike r'[^\x20\x09-\x0D]', false)"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null text scores as an empty one.

    The score is learnt from the labels that aren't held out, on texts as they are in documents.  Rows are judged
    one by one, repeated ones alike; an empty table gives no rows; other columns, whatever their names, stay.
    """
    model = op8_toxicity.train(spark, sf_dir)
    return op8_toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the first, by id (null ids before all others), then a hash of the text; rows without words all stay.

    Every row is a document of its own: rows that share an id, or have none, are one group only if their texts
    link.  Of rows that agree in id and text one stays, the first by those other columns that have an order.  An empty
    table gives no rows; other columns, whatever their names, stay.
    """
    names = ["key", "sub", "sub2"]
    words = docs.where(_HAS_WORDS)
    groups = op3_jaccard.grouped(words, width=SHINGLE, num=NUM, den=DEN)
    keep = groups.groupBy("group").agg(F.min(F.struct(*names)).alias("least")).select("least.*")
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])
    kept = words.select(*identity(), row.alias("row")).join(keep, names, "left_semi")
    order = F.struct(*[F.col(f"row.{quoted(f.name)}") for f in docs.schema if f.name != "text" and _has_order(f.dataType)])
    one = kept.groupBy(*names).agg(F.min_by("row", order).alias("row"))
    return one.select("row.*").unionByName(docs.where(f"not {_HAS_WORDS}"))


def _has_order(kind) -> bool:
    return not any(x in kind.simpleString() for x in ("map<", "variant", "interval"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus; those with nothing left go.

    Rows of one id are ordered by a hash of their text, equal rows lose nothing to each other; null texts become
    empty ones; an empty table gives no rows; other columns, whatever their names, stay.
    """
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")])
    left = op4_substrings.remove_repeats(docs.select("doc_id", "text", row.alias("row")))
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _counted(left.select(*[F.col(c if c in ("doc_id", "text") else f"row.{quoted(c)}").alias(c) for c in docs.columns]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each span in its place; null texts stay null, rows and other columns as they are."""
    return _counted(op1_pii.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a training sequence; rows of one id are packed each on its own."""
    return op10_pack.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None  # scores and added spans come from trained models, ids from tokenizers


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
