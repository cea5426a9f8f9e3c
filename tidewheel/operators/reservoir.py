"""Reservoirs: per category the first lines, in scan order, that are printable, clean and new, up to a cap.

Admission is defined row by row, but its result and counters follow from sets: with s the place of the
cap-th accepted line (none if fewer), what counts is what stands at or before s.  Accepted lines are the
first of each (category, line), which is an aggregation with map-side partials, so a line or a category with a
third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions import text as t

CAP, SALTS = 1000, 64


def first_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group: first of each of SALTS parts of it, then of what those leave."""
    parts = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    some = parts.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank", "_salt")
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def verdicts(df: DataFrame, min_ratio: float = t.MIN_PRINTABLE_RATIO, min_len: int = t.MIN_LEN, payload: str = "payload") -> DataFrame:
    """category, seq, line and gate (not_printable, too_short or ok) of each offered row."""
    binary = df.schema[payload].dataType.typeName() == "binary"
    p = F.col(payload)
    # a projection of its own, so that ratio and line are computed once a row, and the line of printable rows only
    once = df.select("category", "seq", p, t.is_printable_enough(p, min_ratio, binary).alias("_printable"))
    cleaned = once.select("category", "seq", "_printable", F.when(F.col("_printable"), t.clean_text(p, binary)).alias("_line"))
    long_enough = F.length("_line") >= min_len
    gate = F.when(~F.col("_printable"), "not_printable").when(long_enough, "ok").otherwise("too_short")
    return cleaned.select("category", "seq", F.when(long_enough, F.col("_line")).alias("line"), gate.alias("gate"))


def first_seen(v: DataFrame, by: tuple[str, ...] = ("line",)) -> DataFrame:
    """category, line, seq: the first row of each line that passed the gates.

    The gate is looked at within the aggregation: a filter before it would be pushed into the scan and clean every
    text again.  All rows that fail in a category are one partial row a task.
    """
    passed = F.col("gate") == "ok"
    lines = v.select("category", "seq", passed.alias("_ok"), *[F.when(passed, F.col(c)).alias(c) for c in by])
    return lines.groupBy("category", *by).agg(F.min(F.when(F.col("_ok"), F.col("seq"))).alias("seq")).where("seq is not null")


def admit(df: DataFrame, cap: int = CAP, **options) -> DataFrame:
    """category, seq, line of what the reservoirs hold."""
    return admitted(verdicts(df, **options), cap)


def admitted(v: DataFrame, cap: int = CAP) -> DataFrame:
    """category, seq, line of what the reservoirs hold, from verdicts."""
    return first_k(first_seen(v), cap, ["category"], [F.col("seq")]).select("category", "seq", "line")


def stats(df: DataFrame, cap: int = CAP, stop_when_full: bool = False, **options) -> DataFrame:
    """The counters of each category.

    stop_when_full: nothing is offered to a full reservoir; else what is offered then counts as seen only.
    """
    return counters(verdicts(df, **options), cap, stop_when_full)


def counters(v: DataFrame, cap: int = CAP, stop_when_full: bool = False) -> DataFrame:
    """The counters of each category, from verdicts."""
    # lines are told apart by 128 bits here, so no text is moved
    two = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    v = v.select("category", "seq", "gate", *two)
    held = first_k(first_seen(v, ("h1", "h2")), cap, ["category"], [F.col("seq")])
    last = held.groupBy("category").agg(F.count("*").alias("accepted"), F.max("seq").alias("last"))
    last = last.withColumn("last", F.when(F.col("accepted") >= cap, F.col("last")))
    counts = v.join(last, "category", "left").withColumn("in_time", F.coalesce(F.col("seq") <= F.col("last"), F.lit(True)))
    gate = lambda g: F.count_if((F.col("gate") == g) & F.col("in_time"))
    accepted = F.coalesce(F.max("accepted"), F.lit(0))
    return counts.groupBy("category").agg(
        (F.count_if("in_time") if stop_when_full else F.count("*")).alias("candidates_seen"),
        gate("not_printable").alias("rejected_not_printable"),
        gate("too_short").alias("rejected_too_short"),
        (gate("ok") - accepted).alias("rejected_duplicate"),
        accepted.alias("accepted"),
        (accepted >= cap).alias("cap_hit"),
    )


def unique_lines(df: DataFrame, limit: int, payload: str = "payload") -> DataFrame:
    """The first lines without repeats, of payloads of at least MIN_LEN bytes, whatever their category."""
    long_enough = df.where(F.octet_length(payload) >= t.MIN_LEN).withColumn("category", F.lit("all"))
    return admit(long_enough, limit, payload=payload).select("seq", "line")


# Verification


def residual_duplicates(lines: DataFrame) -> DataFrame:
    """category, line, n of lines that a reservoir holds more than once."""
    return lines.groupBy("category", "line").agg(F.count("*").alias("n")).where("n > 1")


def problems(lines: DataFrame, manifests: DataFrame, min_hit_rate: float = 0.5) -> DataFrame:
    """category, problem, n.  lines: category, line; manifests: category, accepted, and maybe min_len and hit_rate."""
    m = manifests.select("category", "accepted", F.coalesce(F.col("min_len"), F.lit(t.MIN_LEN)).alias("min_len") if "min_len" in manifests.columns else F.lit(t.MIN_LEN).alias("min_len"), (F.col("hit_rate") if "hit_rate" in manifests.columns else F.lit(None).cast("double")).alias("hit_rate"))
    counted = m.join(lines.groupBy("category").agg(F.count("*").alias("n")), "category", "left")
    missing = counted.where(F.col("n").isNull() & (F.col("accepted") > 0)).select("category", F.lit("missing").alias("problem"), F.col("accepted").cast("long").alias("n"))
    count = counted.where(F.col("n") != F.col("accepted")).select("category", F.lit("count").alias("problem"), F.col("n"))
    known = lines.join(m, "category")
    changed = known.where(~t.clean_text(F.col("line")).eqNullSafe(F.col("line")))
    short = known.where(F.length("line") < F.col("min_len"))
    each = [df.groupBy("category").agg(F.count("*").alias("n")).select("category", F.lit(name).alias("problem"), "n") for name, df in (("not_clean", changed), ("too_short", short))]
    twice = residual_duplicates(lines).groupBy("category").agg(F.sum(F.col("n") - 1).alias("n")).select("category", F.lit("duplicate").alias("problem"), "n")
    low = m.where(F.col("hit_rate") < min_hit_rate).select("category", F.lit("hit_rate").alias("problem"), F.lit(1).cast("long").alias("n"))
    out = missing.unionByName(count).unionByName(twice).unionByName(low)
    for df in each:
        out = out.unionByName(df)
    return out


def verify(lines: DataFrame, manifests: DataFrame, min_hit_rate: float = 0.5) -> None:
    """An error that lists the problems, a bounded number of them, if there are any."""
    found = problems(lines, manifests, min_hit_rate).orderBy("category", "problem").take(100)
    if found:
        raise ValueError("; ".join(f"{r['category']}: {r['problem']} ({r['n']})" for r in found))
