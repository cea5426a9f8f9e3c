"""Payload inspection: does any rule occur in the payload, over groups of rules of equal length.

alert is a disjunction of containment tests on the payload in ASCII lower case, which stays in generated
code; windows has a closed form; candidates, the number of windows that a Bloom prefilter lets through, is
counted by a vectorised UDF and only where it is asked for.  Everything is local to a row: no shuffle, and the
same plan serves batches and streams.

Matching is on plaintext.  keyed_tokens() gives the variant that compares keyed digests of windows, which
hides the bytes but not which of them are equal.
"""

from __future__ import annotations

import dataclasses
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import text as t
from tidewheel.operators.bloom import FP_RATE, Bloom, candidate_counts

LARGE_PAYLOAD = 3000


@dataclasses.dataclass(frozen=True)
class RuleGroup:
    """Rules of one length, in lower case already; windows have that length."""

    name: str
    rules: tuple[bytes, ...]
    fp_rate: float = FP_RATE

    def __post_init__(self):
        object.__setattr__(self, "rules", tuple(r.encode() if isinstance(r, str) else bytes(r) for r in self.rules))
        if not self.rules:
            raise ValueError(f"{self.name}: a group has at least one rule")
        if len({len(r) for r in self.rules}) != 1:
            raise ValueError(f"{self.name}: all rules of a group have one length")

    @property
    def window_len(self) -> int:
        return len(self.rules[0])

    @functools.cached_property
    def bloom(self) -> Bloom:
        return Bloom.of(self.rules, self.window_len, self.fp_rate)


# The six groups that are shipped.
GROUPS = (
    RuleGroup("FTP-5byte", ("user ", "pass ", "stor ")),
    RuleGroup("FTP-6byte", ("retr /", "size /", "mdtm /")),
    RuleGroup("BruteForce-14byte", ("username=admin",)),
    RuleGroup("BruteForce-18byte", ("post /dv/login.php",)),
    RuleGroup("XSS-12byte", ("xss_r/?name=", "%3cscript%3e")),
    RuleGroup("XSS-15byte", ("document.cookie",)),
)


def min_window(groups: Sequence[RuleGroup]) -> int:
    return min((g.window_len for g in groups), default=1)


def normalised(c: Column, binary: bool = False) -> Column:
    """ASCII lower case; of a binary column, a string with a character for each byte."""
    return t.ascii_lower(t.as_bytes_text(c, binary))


def _size(norm: Column, binary: bool) -> Column:
    return F.length(norm) if binary else F.octet_length(norm)


def any_rule(norm: Column, groups: Sequence[RuleGroup], binary: bool = False) -> Column:
    read = "latin-1" if binary else "utf-8"
    tests = [F.contains(norm, F.lit(r.decode(read))) for g in groups for r in g.rules]
    return functools.reduce(operator.or_, tests, F.lit(False))


def window_count(size: Column, groups: Sequence[RuleGroup]) -> Column:
    each = [F.greatest(size - g.window_len + 1, F.lit(0)) for g in groups]
    return functools.reduce(operator.add, each, F.lit(0)).cast("long")


def inspect(df: DataFrame, groups: Sequence[RuleGroup] = GROUPS, id_col: str = "packet_id", payload_col: str = "payload", candidates: bool = False) -> DataFrame:
    """packet_id, alert, skipped, windows, and candidates if asked for.  A null payload is an empty one."""
    binary = df.schema[payload_col].dataType.typeName() == "binary"
    empty = F.lit(b"") if binary else F.lit("")
    base = df.select(F.col(id_col).alias("packet_id"), normalised(F.coalesce(F.col(payload_col), empty), binary).alias("norm"))
    sized = base.withColumn("size", _size(F.col("norm"), binary))
    short = F.col("size") < min_window(groups)
    out = [
        "packet_id",
        (~short & any_rule(F.col("norm"), groups, binary)).alias("alert"),
        short.alias("skipped"),
        F.when(short, F.lit(0)).otherwise(window_count(F.col("size"), groups)).cast("long").alias("windows"),
    ]
    if candidates:
        counted = candidate_counts([(g.bloom, g.window_len) for g in groups])
        raw = F.encode(F.col("norm"), "ISO-8859-1") if binary else F.col("norm").cast("binary")
        out.append(counted(F.when(short, F.lit(b"")).otherwise(raw)).alias("candidates"))
    return sized.select(*out)


def inspect_single(df: DataFrame, group: RuleGroup, **options) -> DataFrame:
    """Inspection with one group."""
    return inspect(df, (group,), **options)


def byte_windows(df: DataFrame, width: int, id_col: str = "packet_id", payload_col: str = "payload") -> DataFrame:
    """packet_id, position and window (binary) of every byte window; counting them needs no such rows."""
    raw = df.select(F.col(id_col).alias("packet_id"), normalised(F.col(payload_col)).cast("binary").alias("raw"))
    fits = raw.where(F.octet_length("raw") >= width)
    at = fits.withColumn("position", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - width)))
    return at.select("packet_id", "position", F.substring("raw", F.col("position") + 1, F.lit(width)).alias("window"))


def semi_join_alerts(df: DataFrame, groups: Sequence[RuleGroup], **options) -> DataFrame:
    """packet_id of payloads with a window that equals a rule: the relational form of any_rule."""
    spark, found = df.sparkSession, []
    for g in groups:
        rules = spark.createDataFrame([(r,) for r in g.rules], "window binary")
        found.append(byte_windows(df, g.window_len, **options).join(F.broadcast(rules), "window", "left_semi").select("packet_id"))
    return functools.reduce(DataFrame.unionByName, found).distinct()


def keyed_tokens(window: Column, key: str, group: str) -> Column:
    """A digest of a window under a secret key and its group.  It shows which windows are equal."""
    return F.sha2(F.concat(F.lit(f"{key}|{group}|").cast("binary"), window.cast("binary")), 256)


def keyed_alerts(df: DataFrame, groups: Sequence[RuleGroup], key: str, **options) -> DataFrame:
    """As semi_join_alerts, but only digests are compared."""
    spark, found = df.sparkSession, []
    for g in groups:
        rules = spark.createDataFrame([(r,) for r in g.rules], "window binary").select(keyed_tokens(F.col("window"), key, g.name).alias("token"))
        tokens = byte_windows(df, g.window_len, **options).select("packet_id", keyed_tokens(F.col("window"), key, g.name).alias("token"))
        found.append(tokens.join(F.broadcast(rules), "token", "left_semi").select("packet_id"))
    return functools.reduce(DataFrame.unionByName, found).distinct()


def phase(size: Column) -> Column:
    """Whether a payload is below the size from which one was inspected by itself."""
    return F.when(size < LARGE_PAYLOAD, "phase1").otherwise("phase2")


def group_table(spark, groups: Sequence[RuleGroup] = GROUPS) -> DataFrame:
    """group, rules, window_len, m, k, bits_set and bits of each group."""
    rows = [(g.name, [r.decode("utf-8", "replace") for r in g.rules], g.window_len, *g.bloom.stats(), sorted(g.bloom.bits)) for g in groups]
    return spark.createDataFrame(rows, "group string, rules array<string>, window_len int, m int, k int, bits_set int, bits array<int>")


def circuit_gates(windows: Column, rules: int, width: int) -> Column:
    """Gates that an encrypted comparison of that many windows takes: equality and selection for each bit, then an OR tree."""
    return windows * (rules * 17 * width + rules - 1)
