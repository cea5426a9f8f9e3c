"""Scoring of inspection results against labels: outcomes, confusion matrix, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import trim_unicode

BENIGN, UNKNOWN = "BENIGN", "UNKNOWN"


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def is_attack(label: Column) -> Column:
    """Whether the label, trimmed, isn't the benign one; a missing label isn't an attack."""
    return F.coalesce(trim_unicode(label) != BENIGN, F.lit(False))


def with_labels(results: DataFrame, labels: DataFrame, id_col: str = "packet_id", label_col: str = "label") -> DataFrame:
    """Results with label and is_attack; rows without a label stay."""
    return results.join(labels.select(F.col(id_col).alias("packet_id"), F.col(label_col).alias("label")), "packet_id", "left").withColumn("is_attack", is_attack(F.col("label")))


def outcome_flags(attack: Column, alert: Column, skipped: Column) -> dict[str, Column]:
    """tp, tn, fp, fn as 0 or 1; what was skipped counts as not alerted."""
    hit = alert & ~skipped
    flags = {"tp": attack & hit, "tn": ~attack & ~hit, "fp": ~attack & hit, "fn": attack & ~hit}
    return {k: v.cast("int") for k, v in flags.items()}


def outcome_name(attack: Column, alert: Column) -> Column:
    return F.when(attack & alert, "TP").when(attack, "FN").when(alert, "FP").otherwise("TN")


def pruning_pct(windows: Column, candidates: Column, without: float = 100.0) -> Column:
    """Percentage of windows that the prefilter drops; without any, 100 in files and 0 on the console."""
    return F.when(windows > 0, 100.0 * (1.0 - candidates / windows)).otherwise(F.lit(without))


def packet_rows(labelled: DataFrame) -> DataFrame:
    """The eleven columns of the per-packet file.  There, unlike in the metrics, a missing label is an attack."""
    label = F.coalesce(trim_unicode(F.col("label")), F.lit(UNKNOWN))
    flags = outcome_flags(label != BENIGN, F.col("alert"), F.col("skipped"))
    duration = F.col("duration_ms") if "duration_ms" in labelled.columns else F.lit(None).cast("double")
    return labelled.select(
        "packet_id",
        "alert",
        label.alias("label"),
        *[v.alias(k) for k, v in flags.items()],
        "windows",
        "candidates",
        F.round(pruning_pct(F.col("windows"), F.col("candidates")), 1).alias("pruning_pct"),
        F.round(duration, 3).alias("duration_ms"),
    )


def confusion(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, skipped, tp, tn, fp, fn."""
    flags = outcome_flags(F.col("is_attack"), F.col("alert"), F.col("skipped"))
    return labelled.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in flags.items()])


def metrics(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, fpr, fnr and mcc of confusion counts, each 0 where undefined."""
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    rates = c.withColumns({"accuracy": ratio(tp + tn, F.col("total")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})
    p, r = F.col("precision"), F.col("recall")
    a, b, d, e = (x.cast("double") for x in (tp, tn, fp, fn))
    return rates.withColumns({"f1": ratio(2.0 * p * r, p + r), "mcc": ratio(a * b - d * e, F.sqrt((a + d) * (a + e) * (b + d) * (b + e)))})


def summary(labelled: DataFrame, run: str = "run", wall_time_s: float | None = None) -> DataFrame:
    """One row for a run: counts, metrics, timing of what wasn't skipped, windows, candidates, pruning rate."""
    kept = lambda c: F.when(~F.col("skipped"), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    flags = outcome_flags(F.col("is_attack"), F.col("alert"), F.col("skipped"))
    aggregates = [F.count("*").alias("total"), F.count_if("skipped").alias("skipped"), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in flags.items()]]
    for out, c in (("total_windows", "windows"), ("total_candidates", "candidates")):
        known = kept(c) if c in labelled.columns else F.lit(None).cast("long")
        aggregates.append(F.coalesce(F.sum(known), F.lit(0)).alias(out))
    timed = "duration_ms" in labelled.columns
    for out, f in (("avg_time_ms", F.avg), ("min_time_ms", F.min), ("max_time_ms", F.max)):
        aggregates.append(zero(f(kept("duration_ms"))).alias(out) if timed else F.lit(0.0).alias(out))
    # one partial row a partition is all that is shuffled
    row = metrics(labelled.agg(*aggregates))
    w, c = F.col("total_windows"), F.col("total_candidates")
    return row.withColumns({"run": F.lit(run), "wall_time_s": F.lit(wall_time_s).cast("double"), "pruning_rate": F.when(w > 0, 1.0 - c / w).otherwise(F.lit(0.0))})
