"""Token operators against the libraries themselves."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_corpus import ODD
from tokenizers import Tokenizer

from tidewheel.llm import op2_records, op7_bpe, op9_counts, op10_pack
from tidewheel.llm.common import new_path

BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
IDS = [7, 3, None, -5, 11, 2, 1 << 40, 9, 4, 5, 6, 100, 101][: len(ODD)]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_round_trip(spark, documents):
    path = new_path(spark, "records")
    op2_records.write_records(documents(ODD, IDS), path)
    got = {r["doc_id"]: r for r in op2_records.starts(spark, path).collect()}
    start = 0
    for doc_id, text in sorted(zip(IDS, ODD, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*ids_of(BYTES, text), 2]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    shuffled = op2_records.read_shuffled(spark, path, 3).collect()
    files = {r["path"].rpartition("/")[2]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{path}/data").collect()}
    for r in shuffled:
        doc_id, ids = op2_records.read_at(files[r["shard"]], r["offset"])
        assert doc_id == r["doc_id"] and ids.tolist() == [*ids_of(BYTES, dict(zip(IDS, ODD, strict=True))[doc_id]), 2]


def test_damaged_records_are_noticed():
    data = op2_records.frame(5, np.array([1, 2, 10], "<u2").tobytes(), 2) + b"\n"
    assert op2_records.unframe(data)[0] == 5 and op2_records.unframe(data)[1].tolist() == [1, 2, 10]
    for i in range(len(data)):
        with pytest.raises(op2_records.BadRecord):
            op2_records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
        with pytest.raises(op2_records.BadRecord):
            op2_records.unframe(data[:i])


def test_records_of_shared_ids(spark, documents):
    """Rows of one id or none keep one record each, and the same starts in every run."""
    texts, ids = [f"text {k}" for k in range(30)] + [None, "twice", "twice"], [None, 5, 7] * 10 + [5, None, None]
    runs = []
    for parts in ("2", "5"):
        path = new_path(spark, "records")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            op2_records.write_records(documents(texts, ids), path)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        runs.append(sorted(map(str, op2_records.starts(spark, path).collect())))
    assert runs[0] == runs[1] and len(runs[0]) == 33


def test_shards_are_in_the_order_of_their_numbers(spark):
    names = [f"part-{k:05d}-x-c000.txt" for k in (100000, 99999, 10001, 2)]
    rows = spark.createDataFrame([(n,) for n in names], "shard string").select(op2_records.shard_number("shard")).collect()
    assert [r[0] for r in rows] == [100000, 99999, 10001, 2]


def test_no_records(spark, documents):
    path = new_path(spark, "records")
    op2_records.write_records(documents([]), path)
    assert op2_records.starts(spark, path).count() == 0


def test_replay_is_tiktoken(spark, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = documents(ODD, range(len(ODD)))
    got = {r["doc_id"]: r for r in op7_bpe.digests(df).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in op7_bpe.decode(op7_bpe.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_every_prefix_count(spark, documents):
    texts = [t[:200] if t else t for t in ODD] + ["we'll don't  a \n\n 's 'll!'ve", "x \n y", "\n\nfoo  bar   'rest", "a<|endoftext|> b<|endof"]
    got = {r["doc_id"]: r["counts"] for r in op9_counts.prefix_counts(documents(texts, range(len(texts)))).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        assert got[i] == [len(ids_of(BYTES, text[:k])) for k in range(len(text) + 1)]


def test_token_counts(spark, documents):
    got = {r["doc_id"]: r for r in op9_counts.token_counts(documents(ODD, range(len(ODD)))).collect()}
    for i, text in enumerate(ODD):
        n = len(ids_of(BYTES, text))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_truncation():
    c = op9_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "A stranger's  words, unhurriedly spoken 12345"
    for budget in range(12):
        k = c.truncate(text, budget)
        assert c.count(text[:k]) <= budget and all(c.count(text[:j]) > budget for j in range(k + 1, len(text) + 1))


#: What random texts are made of: special strings, marks, odd spaces, emoji, contractions, letters that fold case unlike.
BITS = ["<|endoftext|>", "<|startoftext|>", "<|end", "e\u0301", "\u200d", "\ufeff", "\ud7ff", "\ue000", "😀", "👩\u200d🚀", "'ll", "'S", "'", "don't", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\u3000", "\u2003", "\x85", "\x1c", "\x00", "ſ", "ß", "İ", "ı", "K", "ﬁ", "中", "文字", "한", "ก็", "١٢", "²", "½", "a", "Word", "word", "123", "4", "--", "...", "_", "é", "ñandú", "ÀÉ"]


def random_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) + (" " if r.random() < 0.3 else "") for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_random_texts_are_encoded_as_the_libraries_do():
    texts = random_texts(5, 3000)
    lib, words = op2_records.library(public_tokenizers.path("byte_bpe_50k.json"), width=4), op10_pack.library(public_tokenizers.path("word_bpe_49k.json"), True)
    counter = op9_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    replay = op7_bpe.replayer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for i in range(0, len(texts), 100):
        some = texts[i : i + 100]
        for text, ids in zip(some, replay.encode(some), strict=True):
            assert ids == plain.encode_ordinary(text), text
            want = ids_of(BYTES, text)
            assert np.frombuffer(lib.encode(text), "<u4").tolist() == want and counter.count(text) == len(want), text
            assert np.frombuffer(words.encode(text), "<u4").tolist() == ids_of(WORDS, text), text


def test_truncation_of_random_texts():
    """The last of all prefixes that is within the budget, by the library itself."""
    c, r = op9_counts.counter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    for text in random_texts(7, 150):
        counts = [len(ids_of(BYTES, text[:k])) for k in range(len(text) + 1)]
        for budget in {0, 1, r.randint(0, max(counts)), max(counts) - 1, max(counts)}:
            if budget >= 0:
                assert c.truncate(text, budget) == max(k for k, n in enumerate(counts) if n <= budget), (text, budget)


@pytest.mark.parametrize("operator", ["digests", "token_counts", "pack"])
def test_tokens_of_repeated_rows_and_empty_tables(spark, documents, operator):
    run = {"digests": op7_bpe.digests, "token_counts": op9_counts.token_counts, "pack": op10_pack.pack}[operator]
    assert run(documents([])).count() == 0
    rows = [tuple(r)[:3] for r in run(documents(["a b", "a b", None, "a b c"], [1, 1, None, 1])).collect()]
    assert len(rows) == 4 and sorted(str(r[0]) for r in rows) == ["1", "1", "1", "None"]


def check_plan(lengths, capacity):
    plan = op10_pack.Plan(Counter(lengths), capacity)
    held = defaultdict(list)
    for length, a, b, first, per, offset in plan.runs:
        for k in range(b - a):
            held[first + k // per].append((offset + k % per * length, length))
    assert sorted(x for v in held.values() for _, x in v) == sorted(lengths)
    for v in held.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == plan.sequences
    return plan


def fewest(lengths, capacity):
    """The least number of sequences, by search."""
    best = [len(lengths)]

    def place(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= rest[0]:
                place(rest[1:], [*bins[:i], bins[i] - rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, capacity - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best[0]


def test_plans():
    for seed in range(150):
        r = random.Random(seed)
        capacity = r.choice([5, 10, 30, 100])
        check_plan([r.randint(1, capacity) for _ in range(r.randint(0, 60))], capacity)


def test_reduction_loses_nothing():
    for seed in range(120):
        r = random.Random(seed)
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        plan = check_plan(lengths, 20)
        rest = Counter(lengths)
        for length, a, b, first, *_ in plan.runs:
            if first < plan.fixed:
                rest[length] -= b - a
        left = fewest(list(rest.elements()), 20)
        assert plan.fixed + left == fewest(lengths, 20)
    with pytest.raises(ValueError):
        op10_pack.Plan({21: 1}, 20)


def test_packing(spark, documents):
    df = documents(ODD, IDS)
    rows = op10_pack.pack(df, capacity=16).collect()
    held, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for v in held.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 16
    for doc_id, text in zip(IDS, ODD, strict=True):
        ids = [*ids_of(WORDS, text), 1]
        for i, r in enumerate(sorted(docs[doc_id], key=lambda r: r["piece"])):
            part = ids[16 * i : 16 * i + 16]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (i, 16 * i, len(part), crc(part))
        assert sum(r["length"] for r in docs[doc_id]) == len(ids)
    assert op10_pack.pack(documents([])).count() == 0
