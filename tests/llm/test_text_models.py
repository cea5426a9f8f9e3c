"""Personal data and toxicity: fixed patterns against plain expressions, models on what they haven't seen."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidewheel.llm import op1_pii, op8_toxicity, tagger


@pytest.fixture(scope="session")
def model():
    return op1_pii.tagger()


def plain(text):
    """The patterns as they are written down."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return out


PARTS = ["a.b@c.de", "@", "a@b", "@x.y", ".", "-", " ", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "9", "+", "+1 (988) 555-2485", "+12", "(", ")", "É", "\n", "x+y%z@h-1.co.uk.", "12345678901234567890"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_spans(text):
    assert op1_pii.base_spans(text) == plain(text)


def test_long_runs_are_walked_once():
    for text in ("a" * 200_000 + "@", "9" * 200_000, "1." * 100_000, "a@" * 100_000, "+" * 200_000 + "1"):
        op1_pii.base_spans(text)


def test_tagger_on_unseen_spans(model):
    unseen = tagger.examples(300, seed=1234)
    tags = model.decode(model.stitched([tagger.classes(t) for t, _ in unseen]))
    hit = found = there = 0
    for (_, want), got in zip(unseen, tags, strict=True):
        got = set(tagger.spans(got))
        hit, found, there = hit + len(got & set(want)), found + len(got), there + len(want)
    assert hit / found > 0.9 and hit / there > 0.9


def test_gradients_are_slopes():
    t = tagger.Tagger(hidden=3, seed=1)
    x, y = tagger.training_windows(tagger.examples(2))
    x, y = x[:, :9], y[:, :9]

    def loss():
        both = np.concatenate([t._forward(x, d, False)[0] for d in "fb"], axis=2)
        return t._crf((both @ t.p["out"] + t.p["bias"]).transpose(1, 0, 2), y)[0]

    runs = {d: t._forward(x, d, True) for d in "fb"}
    both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
    _, de, dt = t._crf((both @ t.p["out"] + t.p["bias"]).transpose(1, 0, 2), y)
    grads = {k: np.zeros_like(a) for k, a in t.p.items()}
    grads["trans"] = dt
    slope = de.transpose(1, 0, 2) @ t.p["out"].T
    for k, d in enumerate("fb"):
        t._backward(x, d, runs[d][1], slope[:, :, 3 * k : 3 * k + 3], grads)
    for name, at in (("hf", (1, 4)), ("hb", (0, 7)), ("xf", (int(x[0, 3]), 2)), ("xb", (int(x[1, 5]), 10)), ("trans", (0, 0))):
        eps, was = 1e-2, t.p[name][at]
        t.p[name][at] = was + eps
        up = loss()
        t.p[name][at] = was - eps
        down = loss()
        t.p[name][at] = was
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-3)


def test_windows_are_reconciled(model):
    """A span across the middle of windows is found whole wherever it stands."""
    r = random.Random(3)
    for shift in range(0, 64, 7):
        text = "".join(r.choice("etaoin ") for _ in range(100 + shift)) + " call 555-123-4567 today " + "".join(r.choice("etaoin ") for _ in range(100))
        (base, every), = op1_pii.find([text], model)
        assert base == [] and [text[a:b] for k, a, b in every if k == "phone"] == ["555-123-4567"]


def viterbi(e, trans):
    score, back = e[0].astype(np.float64), []
    for x in e[1:]:
        s = score[:, None] + trans
        back.append(s.argmax(axis=0))
        score = s.max(axis=0) + x
    tags = [int(score.argmax())]
    for b in back[::-1]:
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def test_decoding_in_chunks_is_one_viterbi_pass(model):
    texts = [t for t, _ in tagger.examples(40, seed=7)]
    emissions = model.stitched([tagger.classes(t) for t in [" ".join(texts), *texts[:5], "x", " ".join(texts[:7])]])
    for length, rows in ((16, 3), (100, 512), (256, 2)):
        for e, tags in zip(emissions, model.decode(emissions, length, rows), strict=True):
            assert tags.tolist() == viterbi(e, model.p["trans"].astype(np.float64))


def test_sureness_is_the_share_of_all_sequences(model):
    """Against all sequences of tags of a short region, one by one."""
    import itertools

    e = model.stitched([tagger.classes("7.7")])[0]
    trans = model.p["trans"].astype(np.float64)
    total = {}
    for tags in itertools.product(range(tagger.N_TAGS), repeat=3):
        total[tags] = math.exp(sum(float(e[i, t]) for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
    want = sum(v for t, v in total.items() if t[:2] == (3, 4) and t[2] != 4) / sum(total.values())
    assert model.sureness([e], [(0, 0, 2, np.array([3, 4]))])[0] == pytest.approx(want, rel=1e-4)


def planted(r, n):
    """Prose with spans that no pattern finds, of all four kinds, and traps."""
    make = {
        "email": lambda: f"{r.choice(['anna', 'j.doe', 'info42'])}{r.choice([' [at] ', '(at)', ' at '])}{r.choice(['mail', 'example', 'uni-x'])}{r.choice([' dot ', ' [dot] '])}{r.choice(['com', 'org'])}",
        "ip": lambda: r.choice([" . ", "[.]", "(dot)"]).join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: r.choice([".", "  ", ""]).join(str(r.randint(2000, 6999)) for _ in range(4)),
        "phone": lambda: f"{r.randint(200, 999)}{(s := r.choice(['-', '.']))}{r.randint(200, 999)}{s}{r.randint(1000, 9999)}",
    }
    traps = ["Licensed under CC BY-NC 4.0.", "Version 2.0.", "12 | 40 | 7", "in 1998", "page 12", "3,400,120", "look at this dot", '"9b0b3c6a43eb78aa99cbd7049c"', "2019-11-04"]
    out = []
    for _ in range(n):
        text, want = "", []
        for _ in range(r.randint(20, 60)):
            x = r.random()
            if x < 0.05:
                kind = r.choice(tagger.KINDS)
                piece = make[kind]()
                want.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = r.choice(traps) if x < 0.12 else "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))
            text += piece + " "
        out.append((text, want))
    return out


def test_planted_spans_are_added(model):
    rows = planted(random.Random(11), 300)
    found = op1_pii.find([t for t, _ in rows], model)
    want = {(i, *s) for i, (t, w) in enumerate(rows) for s in w if s not in found[i][0]}
    got = {(i, *s) for i, (b, every) in enumerate(found) for s in every if s not in b}
    for kind in tagger.KINDS:
        mine, there = {x for x in got if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(mine & there) > 0.75 * len(there) and len(mine & there) > 0.85 * len(mine), (kind, len(there), len(mine), len(mine & there))


def test_a_long_text_of_numbers(model):
    r = random.Random(5)
    text = " ".join(str(r.randrange(10 ** r.randint(1, 6))) for _ in range(30_000))
    (base, every), (small, _) = op1_pii.find([text, "a@b.cc"], model)
    assert set(base) <= set(every) and small == [("email", 0, 6)]


def test_added_spans_and_base_ones(model):
    texts = ["mail anna [at] mail.example.com or +1 (988) 555-2485", "", "In 2019 it was $12.50, see page 12.", "x" * 5000]
    found = op1_pii.find(texts, model)
    assert found[0][0] == [("phone", 35, 52)] and ("phone", 35, 52) in found[0][1]
    assert [x for _, x in found[1:]] == [[], [], []]
    assert op1_pii.redacted(texts[0], found[0][1]).endswith("or [PHONE]")


def test_detection_rows(spark, documents, model):
    rows = {r["doc_id"]: r for r in op1_pii.detect(documents(["a@b.cc and 1.2.3.4", None, ""]), model).collect()}
    assert rows[0]["spans"] == "email:0:6,ip:11:18" and rows[0]["n_email"] == 1 and rows[0]["n_ip"] == 1
    assert rows[1]["base_sha256"] == rows[2]["base_sha256"] and rows[1]["spans"] == ""
    assert op1_pii.detect(documents([]), model).count() == 0
    df = op1_pii.redact(documents(["a@b.cc x", None]), model=model)
    assert [r["text"] for r in df.orderBy("doc_id").collect()] == ["[EMAIL] x", None]


def segments_by_definition(scores):
    """All maximal segments: the best one, then those of what is left and right of it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-12 or (abs(total - top[0]) < 1e-12 and (i, -(j + 1)) < (top[1], -top[2]) and False)):
                    top = (total, i, j + 1)
        return top

    def grow(a, b):
        top = best(a, b)
        return [] if top is None else [*grow(a, top[1]), top, *grow(top[2], b)]

    return grow(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["bad", "worse", "ok", "meh"]), max_size=25))
def test_maximal_segments(words):
    weights = {"bad": 1.37, "worse": 2.91}
    m = op8_toxicity.Model(weights, 0.83, rate=1.3, volume=0.05, slope=0.7, offset=-3.0)
    got, n = m.segments(" ".join(words))
    scores = [weights.get(w, -0.83) if w not in words[:i] else -0.83 for i, w in enumerate(words)]
    want = segments_by_definition(scores)
    assert n == len(words)
    assert [(pytest.approx(s), a, b) for s, a, b in want] == got
    # the score by its definition: the posterior over the law's tail at the best segment
    best = max((sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1)), default=0.0)
    chance = 1 - math.exp(-0.05 * n * math.exp(-1.3 * best)) if best > 0 else 1.0
    assert m.score(" ".join(words))[0] == pytest.approx(1 / (1 + math.exp(3.0 - 0.7 * min(20.0, -math.log(chance)))))


def test_words_take_the_weight_of_their_strongest_token():
    m = op8_toxicity.Model({"vile": 1.0, "vile*": 2.0, "viler*": 3.0}, 1.0, strength={"vile": 9.0, "vile*": 5.0, "viler*": 1.0})
    assert [m.weight(w) for w in ("vile", "vilest", "vilerst", "vil", "evile")] == [1.0, 2.0, 2.0, None, None]


def test_near_copies_are_learnt_from_once(spark, documents):
    """A clean text that only happens to be copied often in the toxic class teaches nothing about its words."""
    texts, marks = toxic_corpus(400)
    copied = " ".join(f"special{i}" for i in range(80))
    texts += [f"{copied} v{i} vile awful" for i in range(60)]
    labels = spark.createDataFrame(marks + [(400 + i, 1) for i in range(60)], "doc_id long, toxic int")
    model = op8_toxicity.fit(documents(texts).select("doc_id", "text"), labels)
    assert not any(t.startswith("spec") for t in model.weights) and "vile" in model.weights


def test_labelled_ids_of_many_rows(spark, documents):
    texts, marks = toxic_corpus(200)
    docs = documents(texts + [f"more {i}" for i in range(50)], [*range(200), *[0] * 50])
    model = op8_toxicity.fit(docs.select("doc_id", "text"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert {"vile", "awful", "rotten"} <= set(model.weights)


def toxic_corpus(n=600, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vile", "awful", "rotten"]))
        docs.append(" ".join(words))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out(spark, documents):
    texts, marks = toxic_corpus()
    docs, labels = documents(texts), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = op8_toxicity.fit(docs.select("doc_id", "text"), labels.where(~op8_toxicity.held_out()))
    got = {r["doc_id"]: r for r in op8_toxicity.score(docs, model).collect()}
    toxic = {i for i in range(len(texts)) if i % 5 == 0}
    assert {i for i, r in got.items() if r["predicted"] == 1} == toxic
    assert all(0 <= r["score"] <= 1 for r in got.values()) and all(r["passages"] for i, r in got.items() if i in toxic)
    clean = op8_toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(texts) - len(toxic)


def test_toxicity_without_labels_and_odd_rows(spark, documents):
    docs = documents(["some words", None, ""], [1, None, 3])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = op8_toxicity.score(docs, op8_toxicity.fit(docs.select("doc_id", "text"), none)).collect()
    assert len(rows) == 3 and all(r["score"] < 0.01 and r["predicted"] == 0 for r in rows)
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (77, 0)], "doc_id long, toxic int")
    op8_toxicity.fit(docs.select("doc_id", "text"), labels)
    assert op8_toxicity.score(documents([]), op8_toxicity.Model({}, 1.0)).count() == 0


def test_held_out_rows(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"] for r in df.where(op8_toxicity.held_out()).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_whole_pipeline(spark, documents, tmp_path):
    texts, marks = toxic_corpus(200)
    texts += [texts[1], "mail a@b.cc please", None, ""]
    documents(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {i for i in range(200) if i % 5 == 0} and 200 not in ids and {201, 202, 203} <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids
