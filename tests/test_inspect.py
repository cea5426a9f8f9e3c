import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.functions import text as t
from tidewheel.operators import bloom, evaluate
from tidewheel.operators.inspect import GROUPS, RuleGroup, byte_windows, inspect, keyed_alerts, min_window, semi_join_alerts

BITS = {
    "FTP-5byte": [1, 2, 5, 8, 13, 14, 15, 22, 26, 27, 32, 39, 42, 52, 54, 57, 59, 60, 63],
    "FTP-6byte": [1, 3, 4, 8, 14, 17, 21, 25, 27, 28, 31, 38, 42, 44, 48, 51, 53, 55, 56, 61],
    "BruteForce-14byte": [4, 15, 26, 35, 37, 46, 57],
    "BruteForce-18byte": [6, 7, 19, 20, 32, 45, 58],
    "XSS-12byte": [2, 14, 15, 27, 28, 29, 30, 31, 32, 33, 34, 40, 53],
    "XSS-15byte": [2, 14, 21, 33, 40, 52, 59],
}


def reference(payload: bytes, groups=GROUPS):
    """alert, skipped, windows, candidates by the definition."""
    norm = bytes(b + 32 if 65 <= b <= 90 else b for b in payload)
    if len(norm) < min_window(groups):
        return False, True, 0, 0
    alert, windows, candidates = False, 0, 0
    for g in groups:
        for i in range(len(norm) - g.window_len + 1):
            w = norm[i : i + g.window_len]
            windows += 1
            candidates += g.bloom.might_contain(w)
            alert |= w in g.rules
    return alert, False, windows, candidates


def test_golden_bits():
    assert {g.name: sorted(g.bloom.bits) for g in GROUPS} == BITS
    h1, h2 = bloom.hash_pair(b"user ")
    assert (h1, h2 | 1) == (4767294888533081302, 210730549029)
    assert GROUPS[0].bloom.positions(b"user ") == [22, 59, 32, 5, 42, 15, 52]
    assert bloom.sizes(13) == (64, 3) and bloom.sizes(14) == (68, 3) and bloom.sizes(1) == (64, 7)


@pytest.mark.parametrize("n", [1, 3, 14, 40])
def test_probe_is_the_filter(n):
    rng = np.random.default_rng(n)
    b = bloom.Bloom.of([bytes(rng.integers(97, 123, 5).tolist()) for _ in range(n)])
    data = bytes(rng.integers(97, 123, 3000).tolist())
    assert b.probe(np.frombuffer(data, np.uint8), 5).tolist() == [b.might_contain(data[i : i + 5]) for i in range(len(data) - 4)]
    assert b.probe(np.frombuffer(data[:3], np.uint8), 5).tolist() == []


def test_inspection_by_definition(spark):
    token = st.sampled_from([b"USER ", b"pass ", b"document.cookie", b"POST /dv/login.php", b"x", b" ", b"\xff\x80", "É".encode()])

    @settings(max_examples=15, deadline=None)
    @given(st.lists(st.lists(token, max_size=6).map(b"".join), min_size=1, max_size=30))
    def check(payloads):
        df = spark.createDataFrame(list(enumerate(payloads)), "packet_id long, payload binary")
        got = {r["packet_id"]: tuple(r)[1:] for r in inspect(df, candidates=True).collect()}
        assert got == {i: reference(p) for i, p in enumerate(payloads)}

    check()


def test_text_and_null_payloads(spark):
    df = spark.createDataFrame([(1, "Éuser É"), (2, None), (3, "PASV")], "packet_id long, payload string")
    got = {r["packet_id"]: tuple(r)[1:] for r in inspect(df, candidates=True).collect()}
    assert got == {1: reference("Éuser É".encode()), 2: (False, True, 0, 0), 3: (False, True, 0, 0)}


def test_relational_forms_agree(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["USER a", "none here", "retr /x", "", "xx document.COOKIE"])], "packet_id long, payload string")
    want = [0, 2, 4]
    assert sorted(r[0] for r in inspect(df).where("alert").select("packet_id").collect()) == want
    assert sorted(r[0] for r in semi_join_alerts(df, GROUPS).collect()) == want
    assert sorted(r[0] for r in keyed_alerts(df, GROUPS, "k").collect()) == want
    assert byte_windows(df, 5).groupBy("packet_id").count().count() == 4


def test_probe_sql(spark):
    g = GROUPS[0]
    windows = [b"user ", b"pass ", b"abcde", b"zzzzz", b"stor "]
    df = spark.createDataFrame([(w,) for w in windows], "w binary")
    assert [r[0] for r in df.select(bloom.probe_sql(t.payload_bytes(F.col("w")), g.bloom)).collect()] == [g.bloom.might_contain(w) for w in windows]
    with pytest.raises(ValueError):
        bloom.probe_sql(F.col("w"), bloom.Bloom(68, 3))


def test_groups_are_checked():
    with pytest.raises(ValueError):
        RuleGroup("x", ("ab", "abc"))
    with pytest.raises(ValueError):
        RuleGroup("x", ())


def results(spark):
    rows = [(0, True, False, 10, 1, 2.0), (1, False, False, 10, 0, 4.0), (2, True, False, 5, 5, 6.0), (3, False, True, 0, 0, 100.0), (4, False, False, 8, 0, 8.0), (5, False, True, 0, 0, 100.0)]
    r = spark.createDataFrame(rows, "packet_id long, alert boolean, skipped boolean, windows long, candidates long, duration_ms double")
    labels = spark.createDataFrame([(0, "FTP"), (1, "FTP "), (2, " BENIGN"), (3, "XSS"), (5, "BENIGN")], "packet_id long, label string")
    return evaluate.with_labels(r, labels)


def test_metrics(spark):
    s = evaluate.summary(results(spark), "run").first().asDict()
    assert [s[k] for k in ("total", "skipped", "tp", "tn", "fp", "fn")] == [6, 2, 1, 2, 1, 2]
    assert s["total_windows"] == 33 and s["total_candidates"] == 6 and s["pruning_rate"] == pytest.approx(1 - 6 / 33)
    assert (s["avg_time_ms"], s["min_time_ms"], s["max_time_ms"]) == (5.0, 2.0, 8.0)
    assert s["precision"] == 0.5 and s["recall"] == pytest.approx(1 / 3) and s["f1"] == pytest.approx(0.4)
    assert s["mcc"] == pytest.approx((1 * 2 - 1 * 2) / np.sqrt(2 * 3 * 3 * 4))


def test_missing_label_differs_by_place(spark):
    rows = {r["packet_id"]: r for r in evaluate.packet_rows(results(spark)).collect()}
    assert rows[4]["label"] == "UNKNOWN" and rows[4]["fn"] == 1 and rows[4]["tn"] == 0
    assert rows[3]["pruning_pct"] == 100.0 and rows[2]["pruning_pct"] == 0.0


def test_empty_input_has_zero_metrics(spark):
    s = evaluate.summary(results(spark).limit(0)).first().asDict()
    assert s["total"] == 0 and s["f1"] == 0.0 and s["mcc"] == 0.0 and s["avg_time_ms"] == 0.0


def test_packet_report_of_documents(spark, tmp_path):
    from tidewheel.plans import queries

    texts = {1: "a TOKEN in plain text " * 40, 2: "ok", 3: "nothing of that kind here", 4: "the user of a license", 5: "track( me", 6: None}
    toxic = {1: 1, 3: 0, 4: 0, 2: 1}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()
    got = {r["packet_id"]: r for r in run("packet_csv_rows_documents")}
    assert set(got) == set(texts)
    pct = []
    for i, text in texts.items():
        alert, skipped, windows, candidates = reference((text or "").encode(), queries.TABLE_GROUPS)
        label = {1: "TOXIC", 0: "BENIGN", None: "UNKNOWN"}[toxic.get(i)]
        attack, hit, r = label != "BENIGN", alert and not skipped, got[i]
        assert (r["alert"], r["label"], r["windows"], r["candidates"]) == (alert, label, windows, candidates)
        assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (attack and hit, not attack and not hit, not attack and hit, attack and not hit)
        if windows:
            pct.append((windows, candidates))
    (rate,) = run("pruning_rate_documents")
    w, c = (sum(x) for x in zip(*pct, strict=True))
    assert (rate["total_windows"], rate["total_candidates"]) == (w, c) and rate["pruning_rate"] == pytest.approx(1 - c / w, abs=1e-6)
    each = [got[i]["pruning_pct"] for i in got if got[i]["windows"]]
    assert run("pruning_mean_documents")[0][0] == pytest.approx(sum(each) / len(each), abs=1e-6)
    assert sum(r["n"] for r in run("pruning_histogram_documents")) == len(pct)


def test_slugs_of_whole_documents(spark, tmp_path):
    import hashlib

    from tidewheel.plans import queries

    spark.createDataFrame([(1, "é" * 60 + " Late, words"), (2, "a " * 40 + "end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["digest"] for r in queries.queries()["slugify"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(x.encode()).hexdigest() for i, x in ((1, "Late-words"), (2, "a-" * 40 + "end"))}
