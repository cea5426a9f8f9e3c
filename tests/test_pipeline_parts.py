import random

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import dataset, flows, report, reservoir


def flow_rows(spark, rows):
    return flows.tcp_flows(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, ` Source IP` string, ` Source Port` int, `Destination IP` string, `Destination Port` int, `Protocol` string, ` Label` string"), "n")


def test_flow_lookup(spark):
    f = flow_rows(spark, [("a", 1, "b", 21, "6", " FTP-Patator"), ("a", 2, "b", 80, "6", "BENIGN"), ("a", 2, "b", 80, "6", "DoS Hulk"), ("c", 1, "d", 1, "17", "UDP"), ("c", 1, "d", 1, "x", "odd")])
    idx = flows.index(f)
    packets = spark.createDataFrame([("a", 1, "b", 21), ("b", 21, "a", 1), ("a", 2, "b", 80), ("c", 1, "d", 1)], "src_ip string, src_port int, dst_ip string, dst_port int")
    got = flows.lookup_checked(packets, idx)
    assert {(r["src_ip"], r["src_port"]): r["label"] for r in got.collect()} == {("a", 1): "FTP-Patator", ("b", 21): None, ("a", 2): "DoS Hulk", ("c", 1): None}
    assert flows.collisions(f).first()[0] == 1
    assert flows.match_stats(got).first().asDict() == {"lookups": 4, "hits": 2, "unmatched": 2, "hit_rate": 0.5}
    assert [r[0] for r in flows.distinct_labels(idx, lambda c: c != "BENIGN").collect()] == ["DoS Hulk", "FTP-Patator"]


def test_collisions_count_changes(spark):
    assert flows.collisions(flow_rows(spark, [("a", 1, "b", 1, "6", x) for x in "ABA"])).first()[0] == 2


def test_collisions_across_stretches(spark, monkeypatch):
    r = random.Random(9)
    labels = [("a" if r.random() < 0.8 else "c", 1, "b", 1, "6", r.choice("ABB")) for _ in range(200)]
    want, last = 0, {}
    for src, *_, label in labels:
        want += last.get(src, label) != label
        last[src] = label
    for run in (3, 50, 1 << 20):
        monkeypatch.setattr(flows, "RUN", run)
        assert flows.collisions(flow_rows(spark, labels)).first()[0] == want
    assert flows.collisions(flow_rows(spark, labels).limit(0)).first()[0] == 0


def test_missing_columns():
    with pytest.raises(ValueError, match="label"):
        flows.resolve_columns(["Src IP", "srcport", "DstIP", "dst port", "Protocol"])


def offer_all(rows, cap, ratio, min_len, stop):
    """The counters row by row."""
    s = dict.fromkeys(("candidates_seen", "rejected_not_printable", "rejected_too_short", "rejected_duplicate", "accepted"), 0)
    s["cap_hit"], held, lines = False, set(), []
    for p in rows:
        if stop and s["accepted"] >= cap:
            continue
        s["candidates_seen"] += 1
        if s["accepted"] >= cap:
            continue
        good = sum(32 <= b <= 126 or b in (9, 10, 13) for b in p)
        if not p or good / len(p) < ratio:
            s["rejected_not_printable"] += 1
            continue
        line = "".join(c for c in p.decode("utf-8", "replace").strip() if c >= " " or c == "\t").strip()
        if len(line) < min_len:
            s["rejected_too_short"] += 1
        elif line in held:
            s["rejected_duplicate"] += 1
        else:
            held.add(line)
            lines.append(line)
            s["accepted"] += 1
    s["cap_hit"] = s["accepted"] >= cap
    return s, lines


@pytest.mark.parametrize("stop", [False, True])
def test_reservoir_by_rows(spark, stop):
    r = random.Random(4)
    for cap in (1, 3, 1000):
        rows = {c: [r.choice([b"USER a%d", b"  x%d ", b"\x00\x01\x02\x03%d", b"abcd \x01%d", b"line %d"]) % r.randint(0, 6) for _ in range(40)] for c in "pq"}
        df = spark.createDataFrame([(c, i, p) for c, v in rows.items() for i, p in enumerate(v)], "category string, seq long, payload binary")
        stats = {x.pop("category"): x for x in (y.asDict() for y in reservoir.stats(df, cap, stop).collect())}
        lines = reservoir.admit(df, cap)
        for c, v in rows.items():
            want, kept = offer_all(v, cap, 0.3, 4, stop)
            assert stats[c] == want
            assert [x["line"] for x in lines.where(F.col("category") == c).orderBy("seq").collect()] == kept


def test_verification(spark):
    lines = spark.createDataFrame([("a", "good line"), ("a", "good line"), ("a", " odd"), ("b", "xyz")], "category string, line string")
    manifests = spark.createDataFrame([("a", 3, 0.9), ("b", 2, 0.2), ("c", 1, None)], "category string, accepted long, hit_rate double")
    got = {(r["category"], r["problem"]): r["n"] for r in reservoir.problems(lines, manifests).collect()}
    assert got == {("a", "duplicate"): 1, ("a", "not_clean"): 1, ("b", "count"): 1, ("b", "too_short"): 1, ("b", "hit_rate"): 1, ("c", "missing"): 1}
    with pytest.raises(ValueError, match="missing"):
        reservoir.verify(lines, manifests)


def test_balanced_dataset(spark):
    lines = spark.createDataFrame([(c, f"{c}{i}", f"line {i}") for c, n in (("x", 5), ("y", 9), ("BENIGN", 20)) for i in range(n)], "category string, id string, line string")
    built = dataset.balanced(lines, {"x": 5, "y": 3})
    assert {r["category"]: r["count"] for r in built.groupBy("category").count().collect()} == {"x": 5, "y": 3, "BENIGN": 8}
    assert [r["id"] for r in built.collect()] == [r["id"] for r in dataset.balanced(lines, {"x": 5, "y": 3}).collect()]
    assert {r["category"]: r["down_sampled"] for r in dataset.build_report(built, lines).collect()} == {"x": False, "y": True, "BENIGN": True}
    assert dataset.class_ratio(built).first()["ratio"] == 1.0
    with pytest.raises(ValueError, match="x: 6 wanted, 5 there"):
        dataset.balanced(lines, {"x": 6})


def test_synthetic_payloads(spark):
    rows = dataset.synthetic(spark, 50).collect()
    assert len(rows) == 100 and all(len(r["payload"]) == 40 for r in rows)
    assert all(any(x in r["payload"] for x in ("USER ", "PASS ", "STOR ")) == (r["label"] != "BENIGN") for r in rows)


def test_reports(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10, 10)], "v double")
    assert {r["bin"]: r["n"] for r in report.histogram(df, F.col("v"), 0.0, 10.0, 10).collect()} == {0: 1, 1: 1, 5: 1, 9: 2}
    assert {r["bin"]: r["n"] for r in report.auto_histogram(df, F.col("v"), 2).collect()} == {0: 2, 1: 3}
    assert report.auto_histogram(df.limit(0), F.col("v"), 2).count() == 0
    assert tuple(report.box_stats(df, F.col("v")).first()) == (1.0, 5.0, 10.0)


def test_whole_histogram_has_the_longest(spark):
    values = [0, 10, 19_999, 20_001, 128_657, None]
    df = spark.createDataFrame([("en", v) for v in values] + [("de", 5)], "lang string, n_chars long")
    got = {(r["lang"], r["bin"]): r["n"] for r in report.whole_histogram(df, F.col("n_chars"), 40, ("lang",)).collect()}
    assert got == {("en", 0): 2, ("en", 5): 2, ("en", 38): 1, ("de", 0): 1}
    assert report.whole_histogram(df.where("n_chars = 0"), F.col("n_chars"), 40).first()["n"] == 1
    assert report.whole_histogram(df.limit(0), F.col("n_chars"), 40).count() == 0
