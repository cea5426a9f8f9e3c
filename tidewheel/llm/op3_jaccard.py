"""Self-join of documents by the Jaccard likeness of their word shingles, with a count-vector R-tree.

Shingles are hashed into groups; a document's counts by group are a point.  The overlap of two sets is
at most the sum over groups of the lesser count, and that of any two points below two nodes of an R-tree
at most the sum of the lesser upper corners.  Node pairs whose bound is short of what the threshold needs
are pruned; pairs of points that survive are verified on their sets.

An R-tree in one place would not grow with the corpus, so points are first dealt to buckets, without loss.
Sets that link differ in at most D elements, where D follows from the larger size.  Split the hash space into
more than D parts, and two that link agree on a whole part.  So every set goes, for its own size class and
for the next, to the buckets of its parts' contents.  Then

1. parts meet by the hash of their content; a bucket with up to BUCKET_BLOCK different sets has a tree on
   their count vectors, and what survives the bound in it is joined to groups, as a spanning forest.  The sets
   of a larger bucket are a group about one of them, the pivot, so a group of near copies gives rows in
   proportion to its size;
2. each set of a group goes there once.  Groups of more than CELL_BLOCK sets, or CELL_ELEMENTS shingles, are cut into cells that share
   the pivot and some SHARED other sets.  In a cell the pivot is compared with all, then a tree gives the pairs to
   verify, but for those already connected; verified links give components;
3. large buckets and cut groups whose sets aren't all of one component by then are compared exactly: blocks
   of different components meet in pairs, and only sets of different components are verified.

Step 3 costs in proportion to a group's size times the number of sets outside its largest component, in
blocks; that is the one place where work can grow faster than the input.

Sets are known by 128-bit hashes of their shingles, shingles by 64-bit hashes; equal sets are one point, so
copies, however many, meet once.  A part without elements says little, so sets use it only if they have more
empty parts than were added for that.  A hot part's entries are streamed: no task holds them all.

Defined results: null texts and texts without words have no shingles and link with nothing; texts with
fewer words than a shingle have one, the whole sequence; every row is a document of its own, whatever ids
rows share; component_id is the least id that isn't null among the rows of a component, null if there is none; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.blobs import dealt, joined, ordered, signed
from tidewheel.llm.common import LEAST, batch, identified, partitions_for, remove, slices, table, written
from tidewheel.llm.components import components
from tidewheel.llm.pieces import trim
from tidewheel.llm.words import BASES, Slice, mixed, runs

GROUPS, LEAF, SLICE = 256, 16, 500
#: Most sets of a bucket that is compared whole, and of a cell; sets that all cells of a group share, besides the pivot.
BUCKET_BLOCK, CELL_BLOCK, SHARED = 512, 1024, 32
#: Most elements of a cell's sets, so that long texts make smaller cells; elements looked at in one step.
CELL_ELEMENTS, STEP = 1 << 20, 1 << 19
#: Entries of parts that a task holds before it sends those of large buckets on.
HELD = 2_000_000
_U = np.uint64
_PART, _DOC, _LARGE = 0, 1, 2
_IDENTITY = ["key", "sub", "sub2"]
_BLOB = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


class Threshold:
    """Sets link if intersection / union >= num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("a threshold is above 0 and at most 1")
        self.num, self.den = num, den

    def holds(self, overlap, sizes):
        """For counts or arrays: overlap against the sum of both sizes."""
        return overlap * (self.num + self.den) >= self.num * sizes

    @functools.lru_cache(maxsize=None)  # noqa: B019  a few hundred entries
    def class_at(self, k: int) -> tuple[int, int, int, int]:
        """Of size class k: its least and largest size, how many parts, and how many of them may be empty."""
        low = 1 if not k else self.class_at(k - 1)[1] + 1
        high = low * self.den // self.num
        most = 2 * high * (self.den - self.num) // (self.den + self.num)
        spare = 0
        if most:
            before = self.class_at(k - 1)[0] if k else low
            while (need := math.ceil(2 * (most + 1 + spare) * math.exp(-before / (most + 1 + spare)))) > spare and spare < 4 * most + 4:
                spare = need
        return low, high, most + 1 + spare, spare

    def classes(self, sizes: np.ndarray) -> np.ndarray:
        """The size class of each size."""
        lows, k, top = [], 0, int(sizes.max(initial=1))
        while not lows or lows[-1] <= top:
            lows.append(self.class_at(k)[0])
            k += 1
        return np.searchsorted(np.array(lows), sizes, "right") - 1


class Shingles:
    """The shingle sets of some documents: values, sorted within each document, and document numbers."""

    def __init__(self, texts: list[str], width: int):
        s = Slice(texts, lower=True)
        at = np.flatnonzero(s.whole(width))
        first, second, document = (*(mixed(runs(s.hashes, width, base)[at]) for base in BASES), s.document[at])
        short = np.flatnonzero((s.counts > 0) & (s.counts < width))
        if len(short):
            whole = [[mixed(runs(s.hashes[s.begins[i] : s.begins[i + 1]], int(s.counts[i]), base) + _U(s.counts[i]))[0] for base in BASES[::-1]] for i in short]
            first, second = (np.concatenate([x, np.array(w, np.uint64)]) for x, w in zip((first, second), zip(*whole, strict=True), strict=True))
            document = np.concatenate([document, short])
        order = np.lexsort([first, document])
        first, second, document = first[order], second[order], document[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (document[1:] != document[:-1])
        self.value, self.second, self.document = first[new], second[new], document[new]
        self.sizes = np.bincount(self.document, minlength=len(texts)).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each set, order playing no part; 0 for empty ones."""
        out = []
        for value, base in ((self.value, BASES[1]), (self.second, BASES[0])):
            total = np.zeros(len(self.sizes), np.uint64)
            np.add.at(total, self.document, mixed(value ^ _U(base)))
            out.append(np.where(self.sizes > 0, mixed(total + mixed(self.sizes.astype(np.uint64))), _U(0)))
        return out[0], out[1]

    def vectors(self) -> np.ndarray:
        return np.bincount(self.document * GROUPS + (self.value % _U(GROUPS)).astype(np.int64), minlength=len(self.sizes) * GROUPS).reshape(-1, GROUPS)

    def parts(self, of: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
        """For the documents in of: hashes of the contents of their parts, and the document of each."""
        hashes, owners = [], []
        for step in (0, 1):
            k = threshold.classes(self.sizes[of]) + step
            known = {int(c): threshold.class_at(int(c)) for c in np.unique(k)}
            n, spare = (np.array([known[int(c)][i] for c in k], np.int64) for i in (2, 3))
            begins = np.concatenate([[0], np.cumsum(n)])
            where = np.full(len(self.sizes), -1)
            where[of] = np.arange(len(of))
            mine = where[self.document]
            value, mine = self.value[mine >= 0], mine[mine >= 0]
            part = begins[mine] + (mixed(value ^ _U(BASES[0])) % n[mine].astype(np.uint64)).astype(np.int64)
            total, held = np.zeros(begins[-1], np.uint64), np.bincount(part, minlength=begins[-1]) > 0
            np.add.at(total, part, mixed(value))
            owner = np.repeat(np.arange(len(of)), n)
            number = (np.arange(begins[-1]) - begins[owner]).astype(np.uint64)
            empty = n - np.bincount(owner[held], minlength=len(of))
            use = held | (empty > spare)[owner]
            hashes.append(mixed(total + mixed((k[owner].astype(np.uint64) << _U(40)) + number))[use] >> _U(16))
            owners.append(of[owner[use]])
        return np.concatenate(hashes), np.concatenate(owners)


class CountTree:
    """An R-tree on count vectors, packed by halving along the widest coordinate.  A node's rows are a range of order."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.vectors, self.sizes = vectors.astype(np.int32), sizes.astype(np.int64)
        self.order = np.arange(len(sizes))
        self.nodes: list[tuple[np.ndarray, int, int, int, int, int]] = []  # upper corner, least size, range, children
        if len(sizes):
            self._grow(0, len(sizes))

    def _grow(self, begin: int, end: int) -> int:
        me, rows = len(self.nodes), self.order[begin:end]
        v = self.vectors[rows]
        self.nodes.append(None)
        high, least = v.max(axis=0), int(self.sizes[rows].min())
        if end - begin <= LEAF:
            self.nodes[me] = high, least, begin, end, 0, 0
        else:
            key = self.sizes[rows] if np.ptp(self.sizes[rows]) > np.ptp(v, axis=0).max() else v[:, np.ptp(v, axis=0).argmax()]
            self.order[begin:end] = rows[np.argsort(key, kind="stable")]
            middle = (begin + end) // 2
            left = self._grow(begin, middle)
            self.nodes[me] = high, least, begin, end, left, self._grow(middle, end)
        return me

    def pairs(self, threshold: Threshold, labels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i, j whose bound on the overlap reaches the threshold, each pair once, in arrays.

        labels, which the caller may change between arrays, leave out pairs of one label.
        """
        labels = np.arange(len(self.sizes)) if labels is None else labels
        stack = [(0, 0)] if self.nodes else []
        while stack:
            x, y = stack.pop()
            (high_x, least_x, begin_x, end_x, *below_x), (high_y, least_y, begin_y, end_y, *below_y) = self.nodes[x], self.nodes[y]
            rows_x, rows_y = self.order[begin_x:end_x], self.order[begin_y:end_y]
            if (labels[rows_x] == labels[rows_x[0]]).all() and (labels[rows_y] == labels[rows_x[0]]).all():
                continue
            if x != y and not threshold.holds(int(np.minimum(high_x, high_y).sum()), least_x + least_y):
                continue
            if not any(below_x) and not any(below_y):
                bound = np.minimum(self.vectors[rows_x][:, None], self.vectors[rows_y][None]).sum(axis=2)
                ok = threshold.holds(bound, self.sizes[rows_x][:, None] + self.sizes[rows_y][None]) & (labels[rows_x][:, None] != labels[rows_y][None])
                i, j = np.nonzero(np.triu(ok, 1) if x == y else ok)
                if len(i):
                    yield rows_x[i], rows_y[j]
            elif x == y:
                a, b = below_x
                stack += [(a, a), (a, b), (b, b)]
            elif any(below_x):
                stack += [(c, y) for c in below_x]
            else:
                stack += [(x, c) for c in below_y]


class Overlaps:
    """Sizes of the intersections of one set with others, by marking its elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.element = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        self.mark = np.zeros(int(self.element.max(initial=-1)) + 1, bool)

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sets without elements don't come here."""
        mine = self.element[self.begins[i] : self.begins[i + 1]]
        self.mark[mine] = True
        ends, out = np.cumsum(self.sizes[others]), []
        for part in np.split(others, np.searchsorted(ends, np.arange(STEP, ends[-1], STEP))):
            if len(part):
                starts = np.concatenate([[0], np.cumsum(self.sizes[part])])
                at = np.arange(starts[-1]) + np.repeat(self.begins[part] - starts[:-1], self.sizes[part])
                out.append(np.add.reduceat(self.mark[self.element[at]], starts[:-1], dtype=np.int64))
        self.mark[mine] = False
        return np.concatenate(out)


def connected(vectors: np.ndarray, sizes: np.ndarray, threshold: Threshold, overlaps: Overlaps | None = None, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the links between sets of different labels: those of the bound, or those verified if overlaps are given.

    The first set is compared with all others, so that a group of near copies is connected at once; then the
    tree's pairs, but for those that are connected by then.
    """
    labels, edges = np.arange(len(sizes)) if labels is None else labels.copy(), []

    def link(i: int, others: np.ndarray, bound: bool) -> None:
        others = others[labels[others] != labels[i]]
        if not len(others):
            return
        if overlaps is not None:
            hits = others[threshold.holds(overlaps(i, others), sizes[i] + sizes[others])]
        else:
            hits = others if bound else others[threshold.holds(np.minimum(vectors[i], vectors[others]).sum(axis=1), sizes[i] + sizes[others])]
        for j in hits.tolist():
            if labels[i] != labels[j]:
                labels[labels == labels[j]] = labels[i]
                edges.append((i, j))

    link(0, np.arange(1, len(sizes)), False)
    if (labels == labels[0]).all():
        return edges
    for i, j in CountTree(vectors, sizes).pairs(threshold, labels):
        begins = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        for row, others in zip(i[begins].tolist(), np.split(j, begins[1:]), strict=True):
            link(row, others, True)
    return edges


def _binary(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """Two columns of numbers as one of 16 bytes, in the same order."""
    data = np.stack([high, low], axis=1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(np.arange(0, 16 * len(high) + 1, 16, dtype=np.int32).tobytes()), pa.py_buffer(data)])


def _meetings(docs: DataFrame, width: int, threshold: Threshold, n: int) -> DataFrame:
    """Rows of parts: hash and set; and of documents: identity, size, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in slices(batches, SLICE):
            s = Shingles(b.column(3).to_pylist(), width)
            identity, sets = [ordered(b.column(i).to_numpy()) for i in range(3)], s.sets()
            # equal sets go on once
            of = np.unique(np.stack(sets, axis=1), axis=0, return_index=True)[1]
            of = np.sort(of[s.sizes[of] > 0])
            out = [(turn % n, _DOC, x) for _, x in dealt(np.zeros(b.num_rows, np.int64), *identity, s.sizes.astype(np.uint64), *sets)]
            if len(of):
                hashes, owner = s.parts(of, threshold)
                out += [(p, _PART, x) for p, x in dealt((hashes % _U(n)).astype(np.int64), hashes, *(x[owner] for x in sets))]
            turn += 1
            yield batch(_BLOB, *(zip(*out, strict=True) if out else [[]] * 3))
        trim()

    return docs.select(*_IDENTITY, "text").mapInArrow(run, "part int, kind int, blob binary")


def _named(high: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A name for each bucket by its members: parts that bring the same sets together are one bucket."""
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return mixed(np.add.reduceat(mixed(high ^ _U(BASES[0])) + mixed(low ^ _U(BASES[1])), begins) + sizes.astype(np.uint64)) >> _U(1)


_MET = "kind int, bucket long, key long, sub long, sub2 long, size long, set_id binary, pivot binary"
_MET_ROWS = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("bucket", *_IDENTITY, "size")), ("set_id", pa.binary()), ("pivot", pa.binary())])


def _met(kind: int, high: np.ndarray, low: np.ndarray, bucket=None, identity=None, size=None, pivot=None) -> pa.RecordBatch:
    k = len(high)
    zero = np.zeros(k, np.int64)
    pivots = pa.nulls(k, pa.binary()) if pivot is None else _binary(*pivot)
    return batch(_MET_ROWS, np.full(k, kind, np.int32), zero if bucket is None else bucket.view(np.int64), *(identity or [zero] * 3), zero if size is None else size, _binary(high, low), pivots)


class _Parts:
    """The entries of one part: hash of a content, and set.  Buckets beyond BUCKET_BLOCK go on as soon as they are known."""

    def __init__(self):
        self.new, self.waiting, self.limit = [], 0, HELD
        self.held = [np.zeros(0, np.uint64)] * 3
        self.pivots = [np.zeros(0, np.uint64)] * 3

    def add(self, blob: bytes) -> Iterator[pa.RecordBatch]:
        self.new.append(blob)
        self.waiting += int(np.frombuffer(blob, "<u8", 1)[0])
        if self.waiting >= self.limit:
            yield from self._settle()

    def _settle(self) -> Iterator[pa.RecordBatch]:
        hashes, high, low = (np.concatenate(x) for x in zip(self.held, joined(self.new, 3), strict=True))
        order = np.lexsort([low, high, hashes])
        hashes, high, low = hashes[order], high[order], low[order]
        new = np.ones(len(high), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        hashes, high, low = hashes[new], high[new], low[new]
        buckets, begins, counts = np.unique(hashes, return_index=True, return_counts=True)
        fresh = (counts > BUCKET_BLOCK) & ~np.isin(buckets, self.pivots[0])
        if fresh.any():
            at = begins[fresh]
            more = [np.concatenate(x) for x in zip(self.pivots, (hashes[at], high[at], low[at]), strict=True)]
            by = np.argsort(more[0])
            self.pivots = [x[by] for x in more]
        large = np.isin(hashes, self.pivots[0])
        if large.any():
            at = np.searchsorted(self.pivots[0], hashes[large])
            yield _met(_LARGE, high[large], low[large], hashes[large], pivot=(self.pivots[1][at], self.pivots[2][at]))
        self.held = [hashes[~large], high[~large], low[~large]]
        self.new, self.waiting, self.limit = [], len(self.held[0]), max(HELD, 2 * len(self.held[0]))

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._settle()
        hashes, high, low = self.held
        counts = np.unique(hashes, return_counts=True)[1]
        take = np.repeat(counts > 1, counts)
        high, low, sizes = high[take], low[take], counts[counts > 1]
        if len(sizes):
            name = _named(high, low, sizes)
            first = np.zeros(len(name), bool)
            first[np.unique(name, return_index=True)[1]] = True
            keep = np.repeat(first, sizes)
            yield _met(_PART, high[keep], low[keep], np.repeat(name, sizes)[keep])


def _buckets(meetings: DataFrame, n: int) -> DataFrame:
    """kind _DOC: identity, size, set_id; _PART: bucket and members of different sets; _LARGE: the same of large buckets, and their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, _Parts()
        for b in batches:
            for part, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    yield from parts.finish()
                    now, parts = part, _Parts()
                if kind == _DOC:
                    *identity, sizes, high, low = joined([blob], 6)
                    yield _met(_DOC, high, low, identity=[signed(x) for x in identity], size=sizes.astype(np.int64))
                else:
                    yield from parts.add(blob)
        yield from parts.finish()

    return meetings.repartitionById(n, "part").sortWithinPartitions("part").mapInArrow(run, _MET)


def _streamed(key: int, finish, out_schema: str):
    """A mapInArrow function over rows sorted by column key: finish(table) gets whole keys, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(k == k[-1])[0])  # the last key may go on in the next batch
            if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
                if done := [*held, *([b.slice(0, cut)] if cut else [])]:
                    yield from finish(pa.Table.from_batches(done))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run, out_schema


def _runs_of(keys: np.ndarray) -> list[np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.split(np.arange(len(keys)), begins[1:])


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _edges(ids: list[bytes], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch(_EDGE, [min(ids[i], ids[j]) for i, j in pairs], [max(ids[i], ids[j]) for i, j in pairs])


def _near(members: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """members: bucket, set_id, size, vector.  Sets within the bound of each other, as a forest in each bucket."""

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, sizes, ids = t["bucket"].to_numpy(), t["size"].to_numpy(), t["set_id"].to_pylist()
        vectors = np.stack([_vector(v) for v in t["vector"].to_pylist()])
        two = np.flatnonzero(bucket[1:] == bucket[:-1])
        # buckets of two by the vector, larger ones by a tree
        counts = np.repeat(*(lambda c: (c, c))(np.unique(bucket, return_counts=True)[1]))
        two = two[counts[two] == 2]
        ok = threshold.holds(np.minimum(vectors[two], vectors[two + 1]).sum(axis=1).astype(np.int64), sizes[two] + sizes[two + 1])
        found = [(i, i + 1) for i in two[ok].tolist()]
        more = np.flatnonzero(counts > 2)
        for rows in _runs_of(bucket[more]) if len(more) else []:
            rows = more[rows]
            found += [(int(rows[i]), int(rows[j])) for i, j in connected(vectors[rows], sizes[rows], threshold)]
        yield _edges(ids, found)

    return members.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(*_streamed(0, finish, "a binary, b binary"))


def _linked(members: DataFrame, n: int, threshold: Threshold) -> DataFrame:
    """members: cell, set_id, label, shingles.  Verified links between sets of different labels, as a forest in each cell.

    Without a label a set is by itself.
    """

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, ids, known = t["cell"].to_numpy(), t["set_id"].to_pylist(), t["label"].to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in t["shingles"].to_pylist()]
        found = []
        for rows in _runs_of(cell):
            sizes = np.array([len(sets[r]) for r in rows])
            if len(rows) == 2:
                x, y = rows.tolist()
                if (known[x] is None or known[x] != known[y]) and threshold.holds(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), int(sizes.sum())):
                    found.append((x, y))
                continue
            vectors = np.stack([np.bincount((sets[r] % _U(GROUPS)).astype(np.int64), minlength=GROUPS) for r in rows])
            labels = np.unique([ids[r] if known[r] is None else known[r] for r in rows], return_inverse=True)[1]
            found += [(int(rows[i]), int(rows[j])) for i, j in connected(vectors, sizes, threshold, Overlaps([sets[r] for r in rows]), labels)]
        yield _edges(ids, found)

    return members.repartition(n, "cell").sortWithinPartitions("cell", "set_id").mapInArrow(*_streamed(0, finish, "a binary, b binary"))


def _stored(vector: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs: 1, 2, 4 or 8."""
    top = int(vector.max(initial=0))
    return vector.astype(f"<u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}").tobytes()


def _vector(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{len(stored) // GROUPS}").astype(np.int64)


def _points(docs: DataFrame, width: int, sets: bool) -> DataFrame:
    """set_id, size, and the count vector of each document, or its shingles if sets."""
    schema = pa.schema([("set_id", pa.binary()), ("size", pa.int64()), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            s = Shingles(b.column(0).to_pylist(), width)
            held = [s.value[i:j].tobytes() for i, j in zip(s.begins, s.begins[1:], strict=False)] if sets else [_stored(v) for v in s.vectors()]
            yield batch(schema, _binary(*s.sets()), s.sizes, held)

    return docs.select("text").mapInArrow(run, "set_id binary, size long, held binary")


def _cells(groups: DataFrame) -> DataFrame:
    """groups: pivot, node, room.  cell, set_id: each group's sets in cells of at most about 1 in room, with the pivot and some others in all of them."""
    nodes = groups.where("pivot <> node").distinct()
    whole = nodes.groupBy("pivot").agg(F.count("*").alias("m"), F.ceil(F.sum("room")).cast("int").alias("k"))
    sized = nodes.join(whole, "pivot")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    shared = (F.col("k") > 1) & (F.pmod(F.xxhash64(F.lit(2), "node"), F.greatest(F.lit(1), F.floor(F.col("m") / SHARED))) == 0)
    own = sized.withColumn("block", F.explode(F.when(shared, every).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))))
    pivots = whole.withColumn("block", F.explode(every))
    cell = F.xxhash64("pivot", "block").alias("cell")
    return own.select(cell, F.col("node").alias("set_id")).unionByName(pivots.select(cell, F.col("pivot").alias("set_id")))


def _apart(groups: DataFrame, label: DataFrame) -> DataFrame:
    """groups: g, node, room; label: node, component.  The same and component of the groups that are of more than one component."""
    known = groups.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = known.groupBy("g").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("g")
    return known.join(more, "g", "left_semi").distinct()


def _across(apart: DataFrame) -> DataFrame:
    """cell, set_id, label: every two sets of a group that are of different components meet in a cell of about two blocks."""
    counts = apart.groupBy("g", "component").agg(F.sum("room").alias("n"))
    few = counts.where("n < 1").groupBy("g").agg(F.sum("n").alias("rest"))
    sized = apart.join(counts, ["g", "component"]).join(few, "g", "left")
    big = F.col("n") >= 1
    # a large component is cut by the sets' hashes; small ones are kept whole and pooled
    pool = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("component"), F.ceil("rest")))
    block = F.when(big, F.xxhash64(F.lit(1), "component", F.pmod(F.xxhash64("node"), F.ceil("n")))).otherwise(pool)
    placed = sized.select("g", "node", "component", F.when(big, F.col("component")).alias("own"), block.alias("block"))
    others = placed.select("g", F.col("own").alias("other_own"), F.col("block").alias("other")).distinct()
    met = placed.join(others, "g").where("own is null or other_own is null or own <> other_own")
    return met.select(F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), F.col("node").alias("set_id"), F.col("component").alias("label")).distinct()


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row: its identity (key, sub, sub2; see common.identified), size, and group, a name for its component; without shingles the group is null."""
    threshold, n = Threshold(num, den), partitions_for(df, 16)
    docs = identified(df, id_col, text_col)
    met = written(_buckets(_meetings(docs, width, threshold, n), n), "buckets")
    found = met.where(F.col("kind") == _DOC).select(*_IDENTITY, "size", "set_id")
    # the least document of each set stands for it, and has the set's text
    stands = found.where("size > 0").groupBy("set_id").agg(F.min(F.struct(*_IDENTITY)).alias("least"), F.max("size").alias("elements"))
    # sets that are near share many parts: their bucket is needed once
    members = met.where(F.col("kind") == _PART).select("bucket", "set_id").distinct()
    large = met.where(F.col("kind") == _LARGE)
    of = lambda sets: docs.join(sets.join(stands, "set_id").select("least.*"), _IDENTITY, "left_semi")
    points = written(_points(of(members.select("set_id").distinct()), width, False), "points")
    vectors = points.dropDuplicates(["set_id"]).withColumnRenamed("held", "vector")
    near = _near(members.join(vectors, "set_id").select("bucket", "set_id", "size", "vector"), n, threshold)
    room = F.greatest(F.lit(1.0 / CELL_BLOCK), F.col("elements") / CELL_ELEMENTS).alias("room")
    sized = lambda nodes: nodes.join(stands.select(F.col("set_id").alias("node"), room), "node")
    candidates = written(sized(components(near).select(F.col("component").alias("pivot"), "node")), "candidates")
    hot = written(sized(large.select("bucket", "pivot", F.col("set_id").alias("node")).distinct()), "hot")
    cells = written(_cells(candidates.unionByName(hot.drop("bucket"))), "cells")
    # few sets are left in cells; only theirs are read and moved whole
    shingles = written(_points(of(cells.select("set_id").distinct()), width, True).dropDuplicates(["set_id"]).select("set_id", F.col("held").alias("shingles")), "shingles")
    verify = lambda c: written(_linked(c.join(shingles, "set_id").select("cell", "set_id", "label", "shingles"), n, threshold), "links")
    links = verify(cells.withColumn("label", F.lit(None).cast("binary")))
    label = components(links)
    # what was not compared whole, and isn't connected by now
    cut = candidates.join(candidates.groupBy("pivot").agg(F.sum("room").alias("m")).where("m > 1"), "pivot", "left_semi")
    whole = hot.select(F.xxhash64("bucket").alias("g"), "node", "room").unionByName(cut.select(F.xxhash64("pivot").alias("g"), "node", "room"))
    apart = written(_apart(whole, label), "apart")
    used = [points, candidates, hot, cells, shingles, links, apart]
    if not apart.isEmpty():
        more = verify(_across(apart))
        label = components(links.unionByName(more))
        used.append(more)
    remove(df.sparkSession, *used)
    out = found.join(label.withColumnRenamed("node", "set_id"), "set_id", "left")
    return out.select(*_IDENTITY, "size", F.when(F.col("size") > 0, F.coalesce("component", "set_id")).alias("group"))


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    rows = grouped(df, id_col, text_col, width, num, den).withColumn("doc_id", F.when(F.col("key") != LEAST, F.col("key")))
    least = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "group", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS i
  FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9 GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p WHERE 100 * i >= 90 * (total - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 90 * (total - i)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m AS component_id
FROM s JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = s.doc_id
"""
