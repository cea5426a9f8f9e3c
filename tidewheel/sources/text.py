"""Line files: payloads, labels, rules and reservoirs.

Lines end at line feeds only.  Where files are aligned by line number, blank lines go first and what is
left is numbered, block by block of the files, so that numbers follow the files' order on any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import trim_unicode
from tidewheel.operators.inspect import RuleGroup


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def numbered(df: DataFrame, name: str = "packet_id") -> DataFrame:
    """Rows of files with their number, from 0, in the order of file name and place; filters come before."""
    row = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    blocks = row.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_least"))
    # a row for each block of the input
    before = blocks.withColumn("_before", F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).drop("_n")
    out = row.join(before, ["_file", "_block"])
    return out.select((F.col("_before") + F.col("_row") - F.col("_least")).alias(name), *df.columns)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, payload: trimmed lines that aren't blank."""
    trimmed = lines(spark, path).withColumn("payload", trim_unicode(F.col("value"))).where("payload <> ''")
    return numbered(trimmed).select("packet_id", "payload")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, label: as payloads."""
    return payloads(spark, path).withColumnRenamed("payload", "label")


def rules(spark: SparkSession, path: str) -> list[bytes]:
    """The lines of a rule file that aren't empty.  Spaces count, case stays; a carriage return at the end goes."""
    found = numbered(lines(spark, path).withColumn("rule", F.regexp_replace("value", "\r$", "")).where("rule <> ''"), "n").orderBy("n").collect()
    return [r["rule"].encode() for r in found]


def rule_group(spark: SparkSession, name: str, path: str, fp_rate: float = 0.1) -> RuleGroup:
    return RuleGroup(name, tuple(rules(spark, path)), fp_rate)


def reservoir(spark: SparkSession, path: str) -> DataFrame:
    """seq, line of a reservoir file; blank lines before the first other one are left out."""
    n = numbered(lines(spark, path), "n")
    first = n.where("value <> ''").agg(F.min("n").alias("first"))
    return n.join(F.broadcast(first), F.col("n") >= F.col("first")).select((F.col("n") - F.col("first")).alias("seq"), F.col("value").alias("line"))


def nonempty_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, line of lines that aren't empty."""
    return numbered(lines(spark, path).where("value <> ''"), "id").select("id", F.col("value").alias("line"))
