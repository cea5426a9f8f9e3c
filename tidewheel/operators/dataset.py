"""Balanced data sets from reservoirs: a fixed number of lines a class, in a seeded order.

The order is that of md5(seed, id), which any engine can replay; a class of just the wanted size is taken whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.evaluate import BENIGN
from tidewheel.operators.reservoir import first_k

SEED = 42


def order_key(seed: int, id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")).cast("binary"))


def sample(lines: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """count lines of each category.  lines: category, id, and others."""
    key = order_key(seed, F.col("id"))
    return first_k(lines.withColumn("_key", key), count, ["category"], [F.col("_key"), F.col("id")]).drop("_key")


def shuffled(df: DataFrame, seed: int = SEED) -> DataFrame:
    return df.orderBy(order_key(seed, F.col("id")), "id")


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def check_available(available: DataFrame, wanted: dict[str, int]) -> None:
    """available: category, n, a row for each class.  An error if a class has too few."""
    have = {r["category"]: r["n"] for r in available.where(F.col("category").isin(*wanted)).collect()}
    for name, count in wanted.items():
        if have.get(name, 0) < count:
            raise ValueError(f"{name}: {count} wanted, {have.get(name, 0)} there")


def balanced(lines: DataFrame, malicious: dict[str, int], seed: int = SEED, benign: str = BENIGN) -> DataFrame:
    """category, id, ... of count lines of each malicious class and as many benign ones as all those together."""
    wanted = {**malicious, benign: sum(malicious.values())}
    check_available(lines.groupBy("category").agg(F.count("*").alias("n")), wanted)
    parts = [sample(lines.where(F.col("category") == name), count, seed) for name, count in wanted.items()]
    return shuffled(union(parts), seed)


def build_report(built: DataFrame, lines: DataFrame, benign: str = BENIGN) -> DataFrame:
    """category, used, available, down_sampled."""
    used = built.groupBy("category").agg(F.count("*").alias("used"))
    available = lines.groupBy("category").agg(F.count("*").alias("available"))
    return used.join(available, "category").withColumn("down_sampled", F.col("used") < F.col("available"))


def class_ratio(built: DataFrame, benign: str = BENIGN) -> DataFrame:
    """malicious, benign, and the first by the second (null without benign lines)."""
    mine = F.col("category") == benign
    return built.agg(F.count_if(~mine).alias("malicious"), F.count_if(mine).alias("benign")).withColumn("ratio", F.try_divide(F.col("malicious"), F.col("benign")))


def describe(lines: DataFrame, text: str = "line", benign: str = BENIGN) -> DataFrame:
    """n, attack, benign, and the least, greatest and mean length in characters."""
    size, mine = F.length(text), F.col("category") == benign
    return lines.agg(F.count("*").alias("n"), F.count_if(~mine).alias("attack"), F.count_if(mine).alias("benign"), F.min(size).alias("min_len"), F.max(size).alias("max_len"), F.avg(size).alias("avg_len"))


def preview(lines: DataFrame, n: int = 8, width: int = 60, text: str = "line") -> DataFrame:
    """category and the beginning of the first n lines, by id, as a summary shows them."""
    short = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(F.col(text))
    return lines.orderBy("id").limit(n).select("id", "category", short.alias("preview"))


def synthetic(spark, n: int = 185, length: int = 40, seed: int = 99) -> DataFrame:
    """id, payload, label: n payloads with one of three tokens at a random place, and n without, shuffled.

    The distribution is what counts; the bytes follow from the seed and id alone.
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda salt: F.pmod(F.xxhash64(F.col("id"), salt, F.lit(seed)), F.lit(1 << 30))
    chars = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit(letters), (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(letters))) + 1).cast("int"), F.lit(1))), "")
    tokens = F.array(*[F.lit(x) for x in ("USER ", "PASS ", "STOR ")])
    token = F.element_at(tokens, (draw(F.lit("token")) % 3 + 1).cast("int"))
    at = (draw(F.lit("place")) % (length - 5 + 1)).cast("int")
    attack = F.concat(F.substr(F.col("filler"), F.lit(1), at), token, F.substr(F.col("filler"), at + 6))
    rows = spark.range(2 * n).withColumn("filler", chars)
    labelled = rows.select("id", F.when(F.col("id") < n, attack).otherwise(F.col("filler")).alias("payload"), F.when(F.col("id") < n, "FTP-Patator").otherwise(BENIGN).alias("label"))
    return shuffled(labelled, seed)
