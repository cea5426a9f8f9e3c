"""Connected components of a distributed graph, and a small union-find for within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import remove, written


class Sets:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.find(i), self.find(j)
        self.up[i] = j
        return i != j


CHUNK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every CHUNK of edges, each node's link to the least node that it is connected with in it."""
    up: dict = {}
    kind = pa.int64()

    def find(n):
        while (above := up.setdefault(n, n)) != n:
            up[n] = n = up.setdefault(above, above)
        return n

    def out() -> pa.RecordBatch:
        nodes = list(up)
        pairs = [(r, n) for n in nodes if (r := find(n)) != n]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        if len(up) > CHUNK:
            yield out()
    if up:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long or binary).  For each node of an edge: node, component (the least node it is linked with).

    First, tasks replace the edges they have by forests.  Then, in each round, every node follows the neighbour of the least random rank, if that is below its own,
    and edges are redrawn between the nodes followed.  Ranks are drawn anew each round, so the expected
    number of nodes left falls by a constant factor, chains and stars included.  As soon as no more than CHUNK / 2
    edges are left, one task, whose memory that bounds, joins them.  Each round's result is a written table;
    nothing but a count comes to the driver.
    """
    kind = edges.schema["a"].dataType.simpleString().replace("bigint", "long")
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().mapInArrow(_forest, f"a {kind}, b {kind}"), "edges")
    labels, left, turn, used = None, edges, 0, [edges]
    while (n := left.count()) or labels is None:
        if n <= CHUNK // 2:
            joined = left.coalesce(1).mapInArrow(_forest, f"a {kind}, b {kind}")
            step = written(joined.select(F.col("b").alias("a"), F.col("a").alias("to")), "step")
            again = None
        else:
            rank = lambda c, t=turn: F.xxhash64(c, F.lit(t))
            both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("node"))).alias("m"))
            step = written(best.select("a", F.when(F.col("m.rank") < rank("a"), F.col("m.node")).otherwise(F.col("a")).alias("to")), "step")
            to = lambda c, s=step: s.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
            redrawn = left.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
            again = written(redrawn.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
            used.append(again)
        used.append(step)
        if labels is None:
            labels = step.select(F.col("a").alias("node"), "to")
            if again is None:  # a root has no row of its own there
                labels = labels.unionByName(step.select(F.col("to").alias("node"), "to").distinct())
        else:
            moved = labels.join(step.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left")
            labels = moved.select("node", F.coalesce("next", "to").alias("to"))
        if again is None:
            break
        left, turn = again, turn + 1
    labels = written(labels, "labels")
    remove(labels.sparkSession, *used)
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(least, "to").select("node", "component")
