"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Unit vectors whose cosine is at least t lie within sqrt(2 - 2t) of each other.  A cover tree has nested
levels whose radii halve; each node covers its descendants within a radius that is measured, not just
bounded.  Two nodes farther apart than both radii and the distance of a link can't hold a link, and are
pruned; where the sum is within that distance every pair links, and is counted without a look at it; the
cosines of what is left are computed in double precision.

Equal vectors are one point with a weight, whatever their ids.  Points are dealt to cells by the nearest of at most
PIVOTS pivots, from a sample, which has no bearing on the result; a cell has one tree, or several of at
most TREE points.  Trees of neighbouring cells make a bundle of about BUNDLE points, and bundles meet in pairs; but a
tree goes to a pair only if its cell can hold a link with a cell of the other bundle, by the distance of the pivots
and the measured radii, so what can't link is never moved.  A task traverses each two trees of its pair, and
returns each point's number of links, and links that connect what it found connected, never all pairs.

On data without structure no metric index prunes: every tree then goes to every bundle, so the vectors moved are those
of the input times the number of bundles, and a pair of bundles costs a matrix product.

Defined results: vectors that are null, empty, zero or have null or non-finite components link with nothing,
nor do vectors of different lengths with each other, nor rows without an id; every row is a vector of its own,
whatever ids rows share, and component_id is the least id of its component; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import batch, quoted, remove, slices, table, written
from tidewheel.llm.components import Sets, components

#: Most pivots; points that a cell is meant to have; most points of a tree; points of a bundle.
PIVOTS, CELL, TREE, BUNDLE = 4096, 512, 2048, 8192
#: Room for rounding in distances; what it lets through is decided by the cosine.
SLACK = 1e-6
_CHUNK = 128


def radii(cosine: float) -> tuple[float, ...]:
    """Radii of the levels below the root, which covers the sphere: halving, to a quarter of the distance of a link."""
    out, finest = [1.0], max(math.sqrt(2 - 2 * cosine) / 4, 1e-4)
    while out[-1] / 2 >= finest:
        out.append(out[-1] / 2)
    return tuple(out)


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))


class CoverTree:
    """Nodes in preorder; the points of a node are a range of order.

    begin, end: the range; center: a point; radius: of the points about it; after: the node behind the
    subtree.
    """

    def __init__(self, order, begin, end, center, radius, after):
        self.order, self.begin, self.end, self.center, self.radius, self.after = order, begin, end, center, radius, after

    @classmethod
    def build(cls, points: np.ndarray, cosine: float = 0.9) -> CoverTree:
        levels = radii(cosine)
        order: list[int] = []
        rows: list[list] = []

        def grow(center: int, members: np.ndarray, far: np.ndarray, level: int) -> None:
            me = len(rows)
            rows.append([len(order), 0, center, float(far.max()), 0])
            if len(members) == 1 or level == len(levels) or far.max() == 0.0:
                order.extend(members.tolist())
            else:
                centers, nearest, distance = cover(points, center, members, far, levels[level])
                for k, c in enumerate(centers):
                    mine = nearest == k
                    grow(c, members[mine], distance[mine], level + 1)
            rows[me][1], rows[me][4] = len(order), len(rows)

        if len(points):
            everyone = np.arange(len(points))
            grow(0, everyone, _distance(points @ points[0]), 0)
        begin, end, center, radius, after = np.array(rows).T if rows else np.zeros((5, 0))
        return cls(np.array(order, np.int64), begin.astype(np.int64), end.astype(np.int64), center.astype(np.int64), radius, after.astype(np.int64))

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j < self.after[i]:
            out.append(j)
            j = int(self.after[j])
        return out

    def points(self, i: int) -> np.ndarray:
        return self.order[self.begin[i] : self.end[i]]


def cover(points: np.ndarray, center: int, members: np.ndarray, far: np.ndarray, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centers among the members, each farther than radius from the others, that cover all; of each member its nearest one and how far."""
    centers, nearest, distance = [center], np.zeros(len(members), np.int64), far.copy()
    while len(left := np.flatnonzero(distance > radius)):
        some = left[:_CHUNK]
        apart = _distance(points[members[some]] @ points[members[some]].T) > radius
        fresh: list[int] = []
        for k in range(len(some)):
            if apart[k, fresh].all():
                fresh.append(k)
        at = some[fresh]
        d = _distance(points[members[left]] @ points[members[at]].T)
        best = d.argmin(axis=1)
        closer = d[np.arange(len(left)), best] < distance[left]
        nearest[left[closer]] = len(centers) + best[closer]
        distance[left[closer]] = d[np.arange(len(left)), best][closer]
        centers += members[at].tolist()
        distance[at] = 0.0
        nearest[at] = len(centers) - len(at) + np.arange(len(at))
    return centers, nearest, distance


class Found:
    """Links of the points of two blocks: weighted numbers, and a forest."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.links = np.zeros(len(ids), np.int64)
        self.sets, self.edges = Sets(len(ids)), []

    def connect(self, i: int, j: int) -> None:
        if self.sets.join(i, j):
            self.edges.append((int(self.ids[i]), int(self.ids[j])))

    def every(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All of a link with all of b."""
        if same:
            self.links[a] += self.weights[a].sum() - self.weights[a]
        else:
            self.links[a] += self.weights[b].sum()
            self.links[b] += self.weights[a].sum()
        for i in a.tolist():
            self.connect(i, int(b[0]))
        for j in b.tolist():
            self.connect(int(a[0]), j)

    def some(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """Those of a link with those of b where linked says so; no point with itself."""
        self.links[a] += linked @ self.weights[b]
        if a is not b:
            self.links[b] += linked.T @ self.weights[a]
        for i, j in zip(*np.nonzero(linked), strict=True):
            self.connect(int(a[i]), int(b[j]))


class Traversal:
    """Links between points of two trees, or within one if y is x.  shifts: how many points come before those of each.

    What is left to do is kept as one node and all nodes of the other tree that it can't be told apart from, so that
    a step is one matrix product, however many pairs it prunes.
    """

    def __init__(self, x: CoverTree, y: CoverTree, points: np.ndarray, shifts: tuple[int, int], cosine: float, found: Found):
        self.trees, self.shifts, self.same = (x, y), shifts, x is y
        self.points, self.cosine, self.found = points, cosine, found
        self.reach = math.sqrt(2.0 - 2.0 * cosine)
        self.stack: list[tuple[int, int, np.ndarray]] = []

    def run(self) -> None:
        x, y = self.trees
        if not len(x.begin) or not len(y.begin):
            return
        mine = self._front(0)
        if self.same:
            self._step(0, mine, mine, True)
            for i in mine[x.end[mine] - x.begin[mine] > 1]:
                self._within(int(i))
        else:
            self._step(0, mine, self._front(1))
        while self.stack:
            side, i, others = self.stack.pop()
            self._step(side, np.array(self.trees[side].children(i)), others)

    def _front(self, side: int) -> np.ndarray:
        """The nodes to begin with: two wider ones, on a sphere of diameter 2, are never so far apart as to be pruned."""
        tree, front, todo = self.trees[side], [], [0]
        while todo:
            i = todo.pop()
            kids = tree.children(i) if 2 * tree.radius[i] + self.reach >= 2.0 else []
            todo += kids
            if not kids:
                front.append(i)
        return np.array(front)

    def _own(self, side: int, node: int) -> np.ndarray:
        return self.trees[side].points(node) + self.shifts[side]

    def _within(self, i: int) -> None:
        """Links within a node of the one tree."""
        todo, tree = [i], self.trees[0]
        while todo:
            i = todo.pop()
            if 2 * tree.radius[i] <= self.reach - SLACK:
                self.found.every(self._own(0, i), self._own(0, i), True)
            elif kids := tree.children(i):
                self._step(0, np.array(kids), np.array(kids), True)
                todo += [k for k in kids if tree.end[k] - tree.begin[k] > 1]
            else:
                a = self._own(0, i)
                linked = self.points[a] @ self.points[a].T >= self.cosine
                np.fill_diagonal(linked, False)
                self.found.some(a, a, linked)

    def _step(self, side: int, mine: np.ndarray, others: np.ndarray, above: bool = False) -> None:
        """Nodes of one tree against nodes of the other; above: each pair of a list with itself once.

        Nodes of one point have no radius: between them the cosine decides at once.
        """
        p, q = self.trees[side], self.trees[1 - side]
        lone, also = p.end[mine] - p.begin[mine] == 1, q.end[others] - q.begin[others] == 1
        self._points(side, mine[lone], others[also], above)
        if above:
            self._bounds(side, mine[~lone], others[~also], True)
            self._bounds(side, mine[~lone], others[also])
        else:
            self._bounds(side, mine[~lone], others)
            self._bounds(side, mine[lone], others[~also])

    def _points(self, side: int, mine: np.ndarray, others: np.ndarray, above: bool) -> None:
        p, q, f = self.trees[side], self.trees[1 - side], self.found
        a, b = p.center[mine] + self.shifts[side], q.center[others] + self.shifts[1 - side]
        linked = self.points[a] @ self.points[b].T >= self.cosine
        i, j = np.nonzero(np.triu(linked, 1) if above else linked)
        a, b = a[i], b[j]
        np.add.at(f.links, a, f.weights[b])
        np.add.at(f.links, b, f.weights[a])
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            f.connect(i, j)

    def _bounds(self, side: int, mine: np.ndarray, others: np.ndarray, above: bool = False) -> None:
        """Prune, count or keep pairs of nodes by their radii."""
        if not len(mine) or not len(others):
            return
        p, q = self.trees[side], self.trees[1 - side]
        d = _distance(self.points[p.center[mine] + self.shifts[side]] @ self.points[q.center[others] + self.shifts[1 - side]].T)
        around = p.radius[mine][:, None] + q.radius[others][None]
        keep = d <= around + self.reach + SLACK
        if above:
            keep = np.triu(keep, 1)
        inside = keep & (d + around <= self.reach - SLACK)
        for k, m in zip(*np.nonzero(inside), strict=True):
            self.found.every(self._own(side, mine[k]), self._own(1 - side, others[m]), False)
        keep &= ~inside
        grows = p.after[mine] > mine + 1
        for k in np.flatnonzero(grows & keep.any(axis=1)):
            self.stack.append((side, int(mine[k]), others[keep[k]]))
        keep[grows] = False
        grows = q.after[others] > others + 1
        for m in np.flatnonzero(grows & keep.any(axis=0)):
            self.stack.append((1 - side, int(others[m]), mine[keep[:, m]]))
        keep[:, grows] = False
        self._leaves(side, *(x[at] for x, at in zip((mine, others), np.nonzero(keep), strict=True)))

    def _leaves(self, side: int, mine: np.ndarray, others: np.ndarray) -> None:
        """Pairs of nodes without children, one of them with more than one point."""
        for k, m in zip(mine, others, strict=True):
            a, b = self._own(side, k), self._own(1 - side, m)
            self.found.some(a, b, self.points[a] @ self.points[b].T >= self.cosine)


def traverse(x: CoverTree, y: CoverTree, points: np.ndarray, shifts: tuple[int, int], cosine: float, found: Found) -> None:
    Traversal(x, y, points, shifts, cosine, found).run()


def unit(rows: np.ndarray) -> np.ndarray:
    v = rows.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stack(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.float64) for x in column.to_pylist()]


def _pivots(points: DataFrame) -> dict[int, np.ndarray]:
    """Of each length of vectors, pivots; their number follows that of points, up to PIVOTS.  Lengths beyond PIVOTS share one cell each without a pivot of their own."""
    lengths = points.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(PIVOTS).collect()
    sample = points.orderBy(F.xxhash64("pid"), "pid").limit(PIVOTS).select("length", "embedding").collect()
    out = {}
    for r in lengths:
        mine = [s["embedding"] for s in sample if s["length"] == r["length"]]
        n = min(PIVOTS, max(8, r["n"] // CELL))
        out[r["length"]] = unit(np.array(mine[:n])) if mine else unit(np.eye(1, r["length"]))
    return out


def _dealt(points: DataFrame, pivots: dict[int, np.ndarray], first: dict[int, int]) -> DataFrame:
    """cell and far (the distance from its pivot) of each point; a length without pivots is a cell below 0."""
    schema = pa.schema([("pid", pa.int64()), ("weight", pa.int64()), ("cell", pa.int32()), ("far", pa.float64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            vectors = _stack(b.column(2))
            cell, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                if int(length) not in pivots:
                    cell[rows], far[rows] = -int(length), 2.0
                    continue
                dot = unit(np.stack([vectors[r] for r in rows])) @ pivots[int(length)].T
                cell[rows], far[rows] = first[int(length)] + dot.argmax(axis=1), _distance(dot.max(axis=1))
            yield batch(schema, b.column(0), b.column(1), cell, far, b.column(2).cast(pa.list_(pa.float64())))

    return points.select("pid", "weight", "embedding").mapInArrow(run, "pid long, weight long, cell int, far double, embedding array<double>")


_TREE = "cell int, part int, ids binary, weights binary, points binary, width int, tree array<binary>"


def _trees(placed: DataFrame, cosine: float) -> DataFrame:
    schema = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("points", pa.binary()), ("width", pa.int32()), ("tree", pa.list_(pa.binary()))])

    def build(t: pa.Table) -> pa.Table:
        p = unit(np.stack(_stack(t["embedding"])))
        tree = CoverTree.build(p, cosine)
        parts = [np.ascontiguousarray(x).tobytes() for x in (tree.order, tree.begin, tree.end, tree.center, tree.radius, tree.after)]
        row = [t["cell"][0].as_py(), t["part"][0].as_py(), t["pid"].to_numpy().tobytes(), t["weight"].to_numpy().tobytes(), p.tobytes(), p.shape[1], parts]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return placed.groupBy("cell", "part").applyInArrow(build, _TREE)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, CoverTree]:
    parts = [np.frombuffer(x, np.float64 if i == 4 else np.int64) for i, x in enumerate(row["tree"])]
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64), np.frombuffer(row["points"]).reshape(-1, row["width"]), CoverTree(*parts)


def _links(pairs: DataFrame, n: int, cosine: float) -> DataFrame:
    """a, b: a link; or a and n: its number of links, with b null.  pairs: low, high (bundles), bundle, and a tree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def meet(rows: list[dict]) -> pa.RecordBatch:
        read = [_read(r) for r in rows]
        ids, weights, points = (np.concatenate([x[i] for x in read]) for i in range(3))
        shifts = np.concatenate([[0], np.cumsum([len(x[0]) for x in read])]).tolist()
        found, inside = Found(ids, weights), rows[0]["low"] == rows[0]["high"]
        for i, x in enumerate(rows):
            for j in range(i, len(rows)):
                if inside or x["bundle"] != rows[j]["bundle"]:
                    traverse(read[i][3], read[j][3], points, (shifts[i], shifts[j]), cosine, found)
        have = np.flatnonzero(found.links)
        a = [e[0] for e in found.edges] + ids[have].tolist()
        return batch(schema, a, [e[1] for e in found.edges] + [None] * len(have), [0] * len(found.edges) + found.links[have].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            if held and (held[0]["low"], held[0]["high"]) != (row["low"], row["high"]):
                yield meet(held)
                held = []
            held.append(row)
        if held:
            yield meet(held)

    return pairs.repartition(n, "low", "high").sortWithinPartitions("low", "high", "bundle", "cell", "part").mapInArrow(run, "a long, b long, n long")


def _bundles(pivots: dict[int, np.ndarray], first: dict[int, int], cells: dict[int, tuple[int, float]], reach: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, list[int]]]]:
    """(cell, part, bundle) of every tree, and of every cell the bundles that have a cell which can link with it.

    Cells follow each other by the nearest of some pivots, so a bundle is of neighbours.
    """
    trees, partners, bundle, room = [], [], 0, BUNDLE

    def place(cell: int) -> list[int]:
        nonlocal bundle, room
        n, out = cells[cell][0], []
        parts = -(-n // TREE)
        for part in range(parts):
            if room < n / parts and room < BUNDLE:
                bundle, room = bundle + 1, BUNDLE
            trees.append((cell, part, bundle))
            out.append(bundle)
            room -= n / parts
        return out

    for length, p in pivots.items():
        mine = np.array([i for i in range(len(p)) if first[length] + i in cells])
        if not len(mine):
            continue
        coarse = p[mine[:: max(1, int(math.sqrt(len(mine))))]]
        mine = mine[np.argsort((p[mine] @ coarse.T).argmax(axis=1), kind="stable")]
        bundle, room = bundle + (room < BUNDLE), BUNDLE
        of = [place(first[length] + int(i)) for i in mine]
        far = np.array([cells[first[length] + int(i)][1] for i in mine])
        for k, i in enumerate(mine.tolist()):
            near = np.flatnonzero(_distance(p[mine] @ p[i]) <= far + far[k] + reach + SLACK)
            partners.append((first[length] + i, sorted({b for j in near.tolist() for b in of[j]})))
    for cell in sorted(c for c in cells if c < 0):
        bundle, room = bundle + (room < BUNDLE), BUNDLE
        partners.append((cell, sorted(set(place(cell)))))
    return trees, partners


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    e = F.col("embedding")
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).alias("embedding"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    usable = rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding", *hashes)
    # a point has a number of its own, so rows that share an id, but not a vector, stay apart
    merged = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.any_value("embedding").alias("embedding"))
    points = written(merged.withColumn("length", F.size("embedding")).withColumn("pid", F.monotonically_increasing_id()), "vectors")
    pivots = _pivots(points)
    first, at = {}, 0
    for length, p in pivots.items():
        first[length], at = at, at + len(p)
    dealt = written(_dealt(points, pivots, first), "dealt")
    cells = {r["cell"]: (r["n"], r["r"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}  # a row for each pivot
    trees_of, partners = _bundles(pivots, first, cells, math.sqrt(2 - 2 * cosine))
    # a row for each tree, and for each cell the numbers of at most all bundles: a tree a TREE points, PIVOTS cells
    own = spark.createDataFrame(pd.DataFrame(trees_of, columns=["cell", "part", "bundle"]).astype("int32"), "cell int, part int, bundle int")
    to = spark.createDataFrame(partners, "cell int, others array<int>")
    parts = spark.createDataFrame([(c, -(-n // TREE)) for c, (n, _) in cells.items()], "cell int, k int")
    placed = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("pid"), "k").cast("int"))
    trees = written(_trees(placed.select("cell", "part", "pid", "weight", "embedding"), cosine), "trees")
    other = trees.join(F.broadcast(own), ["cell", "part"]).join(F.broadcast(to), "cell").withColumn("other", F.explode("others"))
    pairs = other.withColumn("low", F.least("bundle", "other")).withColumn("high", F.greatest("bundle", "other"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len({b for _, _, b in trees_of}))
    found = written(_links(pairs.select("low", "high", "bundle", "cell", "part", "ids", "weights", "points", "width", "tree"), n, cosine), "links")
    numbers = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "pid")
    label = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "pid")
    known = points.select("pid", "h1", "h2", "least", "weight").join(numbers, "pid", "left").join(label, "pid", "left").withColumn("component", F.coalesce("component", "pid"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    of = known.join(least, "component").select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = usable.select("vec_id", "h1", "h2").join(of, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    remove(spark, dealt, trees)
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
