"""Personal data in text: fixed patterns, and what a character-level BiLSTM-CRF adds to them.

The patterns' matches always stay.  The tagger, trained here on labelled spans, reads every region within
MARGIN characters of a digit, an at sign, or an "at" or "dot" in brackets or by itself before a "dot", without which
nothing counts as a span; text farther away is not read by it.  A region is cut into overlapping windows; where they
overlap, their scores are averaged, and one Viterbi pass decodes the whole region, however long.  A decoded span that
overlaps no other is added if the model's own posterior of it is SURE or more, and if the digits, whose values
the model doesn't see, can be of its kind: four numbers up to 255 for an ip, 13 to 19 digits for a card, 8 to 15 for
a phone; an email has a sign for at and one for dot.  So spans of all four kinds are added: spelled-out or spaced forms, phones without a country code, card
numbers in dots or with a wrong check digit.

Defined results: a null text is empty and holds nothing; positions count code points; a pattern's match
that fails its further test is dropped and nothing within it tried again; rows of equal id are judged one
by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm.common import batch, documents, mapped, slices, table
from tidewheel.llm.pieces import keep_only
from tidewheel.llm.tagger import KINDS, Tagger, classes, spans, trained

MARGIN, SURE = 40, 0.9
Span = tuple[str, int, int]
_TRIGGER = re.compile(r"[0-9@]+|[\[(](?:at|dot)[\])]|\bat [\w.-]{1,40} dot\b", re.IGNORECASE)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: what fails there fails all along it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_AT, _DOT = re.compile(r"@|\bat\b", re.IGNORECASE), re.compile(r"\.|\bdot\b", re.IGNORECASE)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds, from each at sign outward, so a long run of letters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by kind as listed, then start."""
    if not _TRIGGER.search(text):
        return []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", a, b) for a, b in _emails(text)]
    # of a part that can't be up to 255 only the length of what stands after its zeros matters
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _possible(kind: str, piece: str) -> bool:
    """Whether the digits, which are all one character to the model, can be of the kind; an address has its two signs."""
    if kind == "email":
        return bool(_AT.search(piece) and _DOT.search(piece))
    numbers = re.findall("[0-9]+", piece)
    n = sum(map(len, numbers))
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    return {"card": 13 <= n <= 19, "phone": 8 <= n <= 15}[kind]


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Of each text its base spans, and all spans, both by kind and start."""
    base = [base_spans(t) for t in texts]
    where = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    emissions = tagger.stitched([classes(texts[i][a:b]) for i, a, b in where])
    maybe: list[tuple[int, int, int, object]] = []
    kinds: list[str] = []
    for k, ((i, a, _), tags) in enumerate(zip(where, tagger.decode(emissions), strict=True)):
        for kind, x, y in spans(tags):
            alone = (not a + x or not texts[i][a + x - 1].isalnum()) and (a + y >= len(texts[i]) or not texts[i][a + y].isalnum())
            if alone and not any(p < a + y and a + x < q for _, p, q in base[i]) and _possible(kind, texts[i][a + x : a + y]):
                maybe.append((k, x, y, tags[x:y]))
                kinds.append(kind)
    added: list[list[Span]] = [[] for _ in texts]
    for (k, x, y, _), kind, p in zip(maybe, kinds, tagger.sureness(emissions, maybe), strict=True):
        i, a, _ = where[k]
        if p >= SURE:
            added[i].append((kind, a + x, a + y))
    return [(b, sorted(b + x, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))) for b, x in zip(base, added, strict=True)]


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with the kind of each span in its place; of spans that overlap the first, then longest."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@functools.cache
def tagger() -> Tagger:
    """The tagger trained on invented labelled spans, once a process."""
    return trained()


def detect(df: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, numbers of base spans by kind, digest of the base spans, all spans, and how many were added."""
    model = model or tagger()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for b in slices(batches):
            found = find(b.column(1).to_pylist(), model)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
            yield batch(schema, b.column(0), *counts, [hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in found], [joined(x) for _, x in found], [len(x) - len(y) for y, x in found])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(df: DataFrame, text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """The rows with every span of text_col replaced by its kind; null texts stay null, other columns as they are."""
    model = model or tagger()
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            new = [t if t is None else redacted(t, x) for t, (_, x) in zip(texts, find([t or "" for t in texts], model), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return mapped(df, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
