"""Toxic passages as maximum-scoring segments of token log-odds.

Model.  Tokens are words and, with a star, their beginnings of SHORTEST to LONGEST letters, since a word that is
formed from a toxic one may never have been seen.  A token is kept if the share of toxic documents that hold it is
higher than chance alone would bring one token to (by the likelihood ratio, over all tokens tried).  Its weight is the
log-odds of its occurrences in the toxic against the clean class, each with an informative Dirichlet prior
proportional to the token's share in both together, and at least that of odds EFFECT times as high.  A word has the
weight of the most significant of its tokens, once a document; any other word is one step down, the
log-odds of a word that isn't a kept one, and steeper than what clean documents gain on average, so that their scores drift downward.

Scan.  The maximal scoring segments of a document, all disjoint ones that can't be lengthened or
shortened for a higher score, are found in one pass.  Those of a score that chance would rarely give in a
document of that length are significant.  Segments begin and end at words of positive weight, so
the pass visits these only and treats the words between as one step down.

Calibration.  Weights that have seen a document flatter it, so the labelled documents are scored in FOLDS, each by
what the other folds have taught.  The best segment of clean documents follows an extreme-value law in the log of
the length; the score of a document is the posterior of a logistic curve over the tail's log-probability.

Fitting reads up to SAMPLE labelled documents, those with the least hash of their id, a documented bound, and of
those that are near copies of each other one (bands of min-hashes over that sample alone), as one text copied often is
no evidence about words; scoring reads every document.

Defined results: null or empty texts have no segments and the score of a document without any; labels
that are null or of rows without a text take no part; if a document has several labels it is toxic if one is; of
rows that share a labelled id one is learnt from, that of the least hash of its text; with no label of one of the
classes no token has a weight and every score is 0; rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import math
import re
import statistics
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import batch, mapped, remove, slices, table, written
from tidewheel.llm.components import Sets
from tidewheel.llm.pieces import Table, keep_only
from tidewheel.llm.words import BASES, Slice, mixed, runs

#: Bound on labelled documents for fitting, weight of the prior against all counts, least ratio of odds, parts of the calibration.
SAMPLE, PRIOR, EFFECT, FOLDS = 20_000, 0.2, 3.0, 5
#: Tasks that the sample is dealt to.
PARTS = 24
#: Beginnings of words that are tokens, in letters; documents that a token must be in to be looked at.
SHORTEST, LONGEST, LEAST_SEEN = 4, 8, 5
#: Bands of two min-hashes that tell near copies among the labelled documents.
BANDS = 4
THRESHOLD = 0.7
#: Beyond this a tail's log-probability says nothing more; it keeps few extreme documents from ruling the fit.
SURE = 20.0
_WORD = re.compile(r"\w+")


def tokens(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


@dataclasses.dataclass
class Model:
    weights: dict[str, float]
    step: float
    rate: float = 1.0  # of the extreme-value law
    volume: float = 1.0
    slope: float = 0.0
    offset: float = -50.0
    strength: dict[str, float] = dataclasses.field(default_factory=dict)  # how significant each token is

    def weight(self, word: str) -> float | None:
        """That of the word's most significant token, or nothing."""
        if "_starts" not in self.__dict__:
            self.__dict__["_starts"] = {t[:SHORTEST] for t in self.weights if t.endswith("*")}
        if word not in self.weights and word[:SHORTEST] not in self.__dict__["_starts"]:
            return None  # as nearly all words
        best = max((t for t in tokens(word) if t in self.weights), key=lambda t: (self.strength.get(t, 0.0), t), default=None)
        return None if best is None else self.weights[best]

    def known(self) -> Table:
        """From word to weight, as far as this worker has met words."""
        if "_known" not in self.__dict__:
            self.__dict__["_known"] = Table(self.weight, entries=300_000, longest=32)
        return self.__dict__["_known"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_starts")}

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """Maximal scoring segments as (score, first word, end word), and the number of words."""
        words = text.lower()
        found: list[list[float]] = []  # left sum, right sum, begin, end
        total, at, weight = 0.0, 0, self.known()
        n, met = 0, set()
        for n, w in enumerate(_WORD.findall(words), 1):
            if (x := weight[w]) is None or w in met:
                continue
            met.add(w)
            i = n - 1
            total -= self.step * (i - at)
            at = n
            new = [total, total + x, i, n]
            total += x
            # join leftward while a segment begins lower and ends lower than this one
            while found:
                j = len(found) - 1
                while j >= 0 and found[j][0] >= new[0]:
                    j -= 1
                if j < 0 or found[j][1] >= new[1]:
                    break
                new = [found[j][0], new[1], found[j][2], new[3]]
                del found[j:]
            found.append(new)
        return [(r - left, int(b), int(e)) for left, r, b, e in found], n

    def tail(self, score: float, n: int) -> float:
        """Minus the log-probability that a clean document of n words has a segment of that score, SURE at most."""
        if score <= 0:
            return 0.0
        x = self.rate * score - math.log(self.volume * max(n, 1))
        return SURE if x > SURE else -math.log(-math.expm1(-math.exp(-x)))

    def score(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """The probability of the toxic class, and the significant segments."""
        segments, n = self.segments(text)
        best = max((s for s, _, _ in segments), default=0.0)
        p = 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * self.tail(best, n)))))
        return p, [s for s in segments if self.tail(s[0], n) >= math.log(20)]


@dataclasses.dataclass
class Counts:
    """Of tokens, documents and occurrences by class (clean, toxic); and of all documents and words."""

    held: dict[str, tuple[np.ndarray, np.ndarray]]
    documents: np.ndarray
    words: np.ndarray
    tried: int

    def model(self) -> Model:
        """Weights of the tokens that are more than chance; the step is set when their rates are known."""
        weights, strength = {}, {}
        if not self.documents.all() or not self.words.all():
            return Model({}, 1.0)
        least = statistics.NormalDist().inv_cdf(1 - 1 / (self.tried + 1))
        for token, (documents, occurrences) in self.held.items():
            seen, share = documents.sum(), self.documents / self.documents.sum()
            if seen < LEAST_SEEN or documents[1] <= seen * share[1]:
                continue
            z = math.sqrt(2 * sum(k * math.log(k / (seen * p)) for k, p in zip(documents.tolist(), share.tolist(), strict=True) if k))
            shrunk = [math.log((o + PRIOR * t) / ((1 + PRIOR) * all_)) for counts, totals in ((documents, self.documents), (occurrences, self.words)) for t in [counts.sum()] for o, all_ in zip(counts.tolist(), totals.tolist(), strict=True)]
            by_document, weight = shrunk[1] - shrunk[0], shrunk[3] - shrunk[2]
            if z >= least and min(by_document, weight) >= math.log(EFFECT):
                weights[token], strength[token] = weight, z
        return Model(weights, 1.0, strength=strength)


def _fold(doc_id: int) -> int:
    return zlib.crc32(b"fold %d" % doc_id) % FOLDS


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic and bands of each document: two min-hashes of its runs of three words each."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("bands", pa.list_(pa.int64()))])
    for b in slices(batches):
        s, out = Slice(b.column(2).to_pylist(), lower=True), []
        for i in range(b.num_rows):
            words = s.hashes[s.begins[i] : s.begins[i + 1]]
            runs_ = mixed(runs(words, min(3, len(words)), BASES[0])) if len(words) else np.zeros(1, np.uint64)
            least = [mixed(runs_ ^ mixed(np.full(1, k + 1, np.uint64))).min() for k in range(2 * BANDS)]
            out.append([int(mixed(np.array([x + np.uint64(k)]) ^ mixed(np.array([y])))[0].view(np.int64)) for k, (x, y) in enumerate(zip(least[::2], least[1::2], strict=True))])
        yield batch(schema, b.column(0), b.column(1), out)


def _apart(rows: DataFrame) -> frozenset[int]:
    """Ids of labelled documents (at most the sample), one of each class of those that are near copies."""
    found = rows.mapInArrow(_bands, "doc_id long, toxic int, bands array<long>").toPandas().sort_values("doc_id")
    sets, first = Sets(len(found)), {}
    for i, bands in enumerate(found["bands"]):
        for x in bands:
            sets.join(i, first.setdefault(x, i))
    chosen: dict[tuple[int, int], int] = {}
    for i, (doc_id, toxic) in enumerate(zip(found["doc_id"], found["toxic"], strict=True)):
        chosen.setdefault((sets.find(i), int(toxic == 1)), int(doc_id))
    return frozenset(chosen.values())


def _counted(rows: DataFrame, chosen: frozenset[int]) -> tuple[list[Counts], Counts]:
    """Counts of what isn't in each fold, and of everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.string()), ("part", pa.int32()), ("documents", pa.int64()), ("occurrences", pa.int64())])
        # all counts of a task, which has its share of the sample: no more than that
        documents, words = ([Counter() for _ in range(2 * FOLDS)] for _ in range(2))
        tokens_of = Table(tokens, entries=300_000, longest=32)
        keep_only(tokens_of)
        for b in slices(batches):
            for doc_id, toxic, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if doc_id in chosen:
                    part, found = 2 * _fold(doc_id) + (toxic == 1), _WORD.findall(text.lower())
                    words[part].update(found)
                    documents[part].update({""}.union(*map(tokens_of.__getitem__, set(found))))
        for part in range(2 * FOLDS):
            occurrences = Counter({"": words[part].total()})
            for w, k in words[part].items():
                for t in tokens_of[w]:
                    occurrences[t] += k
            held = documents[part]
            yield batch(schema, list(held), np.full(len(held), part, np.int32), list(held.values()), [occurrences[t] for t in held])

    sums = [F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for c in ("documents", "occurrences") for k in range(2 * FOLDS)]
    counted = written(rows.mapInArrow(run, "token string, part int, documents long, occurrences long").groupBy("token").agg(*sums), "tokens")
    toxic, clean = (sum((F.col(f"documents_{2 * k + c}") for k in range(FOLDS)), F.lit(0)) for c in (1, 0))
    whole = counted.where("token = ''").first()
    if whole is None:
        none = Counts({}, np.zeros(2), np.zeros(2), 0)
        return [none] * FOLDS, none
    table_of = lambda r: np.array(r[1:], float).reshape(2, FOLDS, 2)  # noqa: E731  what, fold, class
    totals = table_of(whole)
    tried = counted.where(toxic + clean >= LEAST_SEEN).count()
    # only tokens that are commoner in toxic documents can be kept
    ratio = float(totals[0, :, 1].sum() / max(totals[0, :, 0].sum(), 1.0))
    held = {r["token"]: table_of(r) for r in counted.where((F.col("token") != "") & (toxic >= 3) & (toxic > clean * ratio)).collect()}
    remove(rows.sparkSession, counted)

    def pick(folds: list[int]) -> Counts:
        sums = {t: (x[0, folds].sum(axis=0), x[1, folds].sum(axis=0)) for t, x in held.items()}
        return Counts(sums, totals[0, folds].sum(axis=0), totals[1, folds].sum(axis=0), tried)

    return [pick([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)], pick(list(range(FOLDS)))


def _passed(rows: DataFrame, chosen: frozenset[int], models: list[Model], scan: bool) -> tuple[np.ndarray, ...]:
    """Of each chosen document, by the model of the other folds: class, words, different kept words, their weights, and, if it is to be scanned, its best segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(*(m.known() for m in models))
        schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("hits", pa.int64()), ("gain", pa.float64()), ("best", pa.float64())])
        for b in slices(batches):
            out = []
            for doc_id, toxic, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if doc_id in chosen:
                    model = models[_fold(doc_id)]
                    if scan:
                        segments, n = model.segments(text)
                        out.append((int(toxic == 1), n, 0, 0.0, max((s for s, _, _ in segments), default=0.0)))
                    else:
                        words = _WORD.findall(text.lower())
                        gains = [x for w in set(words) if (x := model.known()[w]) is not None]
                        out.append((int(toxic == 1), len(words), len(gains), sum(gains), 0.0))
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * 5))

    seen = rows.mapInArrow(run, "toxic int, n long, hits long, gain double, best double").toPandas()  # at most the sample
    return tuple(seen[c].to_numpy() for c in ("toxic", "n", "hits", "gain", "best"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
    one = labelled.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(one.repartition(PARTS), "labelled")
    apart = _apart(rows)
    others, every = _counted(rows, apart)
    model, folds = every.model(), [c.model() for c in others]
    if not model.weights:
        return Model({}, 1.0)
    toxic, n, hits, gain, _ = _passed(rows, apart, folds, False)
    share = [(hits[toxic == c].sum() + 0.5) / (n[toxic == c].sum() + 1.0) for c in (0, 1)]
    drift = gain[toxic == 0].sum() / max(1.0, n[toxic == 0].sum())
    for m in (model, *folds):
        m.step = float(max(2 * drift, math.log1p(-min(share[0], 0.5)) - math.log1p(-min(share[1], 0.5)), 1e-3))
    toxic, n, _, _, top = _passed(rows, apart, folds, True)
    remove(docs.sparkSession, rows)
    clean = (toxic != 1) & (n > 0)
    # method of moments for the law's rate over the clean documents that have a segment, and its volume by their share
    have = top[clean & (top > 0)]
    model.rate = math.pi / (math.sqrt(6) * float(have.std())) if len(have) > 20 and have.std() > 1e-9 else 1.0
    part = min(0.999, max(1e-4, (len(have) + 0.5) / (clean.sum() + 1.0)))
    model.volume = -math.log1p(-part) * math.exp(model.rate * (float(have.min()) if len(have) else 0.0)) / max(1.0, float(np.mean(n[clean])) if clean.any() else 1.0)
    x = np.array([model.tail(s, k) for s, k in zip(top, n, strict=True)])
    model.slope, model.offset = _logistic(x, (toxic == 1).astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little shrinkage."""
    scale = max(1e-9, float(x.std()))
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def held_out(id_col: str = "doc_id"):
    """Whether a row's label is never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score, predicted, and its significant passages (first word, end word, score)."""
    kept = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())])
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(passage))])
        keep_only(kept.known())
        for b in slices(batches):
            found = [kept.score(t or "") for t in b.column(1).to_pylist()]
            yield batch(schema, b.column(0), [p for p, _ in found], [int(p >= threshold) for p, _ in found], [[{"first_word": a, "end_word": e, "score": s} for s, a, e in x] for _, x in found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<first_word:long,end_word:long,score:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(model.known())
        for b in slices(batches):
            yield b.filter(pa.array([model.score(t or "")[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, run)


def train(spark: SparkSession, sf_dir: str) -> Model:
    """The model of a corpus: fitted on the labels that aren't held out."""
    return fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), train(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")
