"""Aggregates behind the charts: histograms, box-plot statistics, shares, run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """bin (0 on) and n of equal bins from low to high; the last has its upper end too, what lies outside has no row."""
    v = df.select(*by, value.cast("double").alias("v")).where((F.col("v") >= low) & (F.col("v") <= high))
    at = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return v.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def auto_histogram(df: DataFrame, value: Column, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A histogram between the least and the greatest value, which one aggregation finds."""
    ends = df.agg(F.min(value.cast("double")).alias("a"), F.max(value.cast("double")).alias("b")).first()
    if ends["a"] is None:
        return histogram(df.limit(0), value, 0.0, 1.0, bins, by)
    high = ends["b"] if ends["b"] > ends["a"] else ends["a"] + 1.0
    return histogram(df, value, ends["a"], high, bins, by)


def whole_histogram(df: DataFrame, value: Column, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A histogram from 0 to 1.05 times the greatest value, so no value from 0 on lies outside."""
    top = df.agg(F.max(value.cast("double"))).first()[0]
    return histogram(df, value, 0.0, top * 1.05 if top and top > 0 else 1.0, bins, by)


def box_stats(df: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The quartiles, interpolated."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)])


def pruning_profile(packets: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of pruning_pct of packets that have windows."""
    return histogram(packets.where("windows > 0"), F.col("pruning_pct"), 0.0, 100.0, bins)


def pruning_mean(packets: DataFrame) -> DataFrame:
    return packets.where("windows > 0").agg(F.avg("pruning_pct").alias("mean_pruning_pct"))


def outcome_shares(confusion: DataFrame) -> DataFrame:
    """outcome, n, and its percentage of the total."""
    each = confusion.selectExpr("total", "stack(4, 'TP', tp, 'TN', tn, 'FP', fp, 'FN', fn) as (outcome, n)")
    return each.select("outcome", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("total")), F.lit(0.0)).alias("share_pct"))


# The metrics that the run table shows.
RUN_METRICS = ("accuracy", "precision", "recall", "f1")


def run_table(summaries: list[DataFrame]) -> DataFrame:
    """run and its metrics in percent, a row for each summary."""
    rows = None
    for s in summaries:
        s = s.select("run", *[(100.0 * F.col(m)).alias(f"{m}_pct") for m in RUN_METRICS], "fp", "fn")
        rows = s if rows is None else rows.unionByName(s)
    return rows
