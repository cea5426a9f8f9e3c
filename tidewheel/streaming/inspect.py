"""Inspection and running metrics over streams; the plan is that of batches, as it has no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewheel.operators.evaluate import metrics, outcome_flags, with_labels
from tidewheel.operators.inspect import GROUPS, RuleGroup, inspect


def inspected(stream: DataFrame, groups: Sequence[RuleGroup] = GROUPS, **options) -> DataFrame:
    """As inspect, for a stream."""
    return inspect(stream, groups, **options)


def running_confusion(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts so far, for output mode complete; labels are a table."""
    labelled = with_labels(results, labels)
    flags = outcome_flags(F.col("is_attack"), F.col("alert"), F.col("skipped"))
    return labelled.groupBy().agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), *[F.sum(v).alias(k) for k, v in flags.items()])


def start_metrics(results: DataFrame, labels: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the metrics so far, with the batch they belong to, after every batch; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        metrics(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = running_confusion(results, labels).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def first_seen_lines(stream: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Lines of a stream once each within the delay; state older than that goes."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["category", "line"])
