"""Tables in files: flow labels, manifests, per-packet and summary results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.text import reservoir_name
from tidewheel.operators.evaluate import BENIGN, outcome_name
from tidewheel.operators.flows import tcp_flows

# The columns of result files, in their order.
PACKET_SCHEMA = "packet_id long, alert boolean, label string, tp int, tn int, fp int, fn int, windows long, candidates long, pruning_pct double, duration_ms double"
SUMMARY_SCHEMA = "run string, total long, skipped long, tp long, tn long, fp long, fn long, accuracy double, precision double, recall double, f1 double, fpr double, fnr double, mcc double, wall_time_s double, avg_time_ms double, total_windows long, total_candidates long, pruning_rate double"


def flow_labels(spark: SparkSession, path: str) -> DataFrame:
    """TCP rows of labelled flows, with row_seq for their order: file, then block, then place in it."""
    raw = spark.read.option("header", True).csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return tcp_flows(raw.select("*", order.alias("_order")), "_order")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest, with its reservoir's name, and min_len and hit_rate where they are given."""
    m = spark.read.option("multiLine", True).json(path)
    m = m.withColumn("reservoir", reservoir_name(F.col("category"), F.col("sublabel").cast("string") if "sublabel" in m.columns else F.lit(None).cast("string")))
    nested = "flow_index_stats" in m.columns and "hit_rate" in m.schema["flow_index_stats"].dataType.names
    return m.withColumn("hit_rate", F.col("flow_index_stats.hit_rate") if nested else F.lit(None).cast("double"))


def packet_results(spark: SparkSession, path: str, attack_label: str | None = None) -> DataFrame:
    """A per-packet file with is_attack, by one label or by any but the benign one, and outcome."""
    df = spark.read.option("header", True).schema(PACKET_SCHEMA).csv(path)
    attack = F.col("label") == attack_label if attack_label else F.col("label") != BENIGN
    return df.withColumn("is_attack", attack).withColumn("outcome", outcome_name(F.col("is_attack"), F.col("alert")))


def summary_results(spark: SparkSession, path: str) -> dict:
    """The first row of a summary file; an empty dict if it has none."""
    rows = spark.read.option("header", True).schema(SUMMARY_SCHEMA).csv(path).limit(1).collect()
    return rows[0].asDict() if rows else {}
