import json
import struct

import pytest

from tidewheel.operators.evaluate import summary
from tidewheel.plans import jobs
from tidewheel.sources import pcap, sinks, tables, text
from tidewheel.streaming import inspect as streaming


def packet(src, sport, dst, dport, payload, pad=b""):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 24, 8192, 0, 0) + payload
    addresses = b"".join(bytes(map(int, a.split("."))) for a in (src, dst))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + addresses + tcp
    return b"\0" * 12 + b"\x08\x00" + ip + pad


def capture(packets, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate(packets):
        out += struct.pack(order + "IIII", 100 + i, 500, len(p), len(p)) + p
    return out


ATTACKER, SERVER = "192.168.10.51", "10.0.0.1"
PACKETS = [packet(ATTACKER, 5000, SERVER, 21, b"USER admin\r\n"), packet(ATTACKER, 5000, SERVER, 21, b"", b"\0" * 6), packet(SERVER, 21, ATTACKER, 5000, b"331 ok\r\n"), packet(ATTACKER, 5001, SERVER, 22, b"SSH-2.0 x\r\n")]


@pytest.mark.parametrize("order, magic", [("<", 0xA1B2C3D4), (">", 0xA1B23C4D)])
def test_pcap(spark, tmp_path, order, magic):
    (tmp_path / "a.pcap").write_bytes(capture(PACKETS, order, magic) + b"\x01\x02")
    rows = pcap.read(spark, str(tmp_path / "a.pcap")).orderBy("seq").collect()
    assert [(r["seq"], r["src_ip"], r["dst_port"], bytes(r["payload"])) for r in rows] == [(0, ATTACKER, 21, b"USER admin\r\n"), (2, SERVER, 5000, b"331 ok\r\n"), (3, ATTACKER, 22, b"SSH-2.0 x\r\n")]
    assert len(pcap.read_binary(spark, str(tmp_path / "a.pcap")).collect()) == 3


def test_a_capture_in_parts(spark, tmp_path, monkeypatch):
    """The same rows, whatever number of tasks reads a file, and however long its packets are."""
    rows = [packet(ATTACKER, 5000 + i, SERVER, 21, b"x" * (i * 37 % 400 + (i % 5 > 0))) for i in range(200)]
    for name, order in (("a.pcap", "<"), ("b.pcap", ">")):
        (tmp_path / name).write_bytes(capture(rows, order) + b"\x01\x02")
    reader = pcap._Reader({"path": f"file://{tmp_path}"})
    whole = [r for p in reader.partitions() for r in reader.read(p)]
    for split in (100, 1000, 30_000):
        monkeypatch.setattr(pcap, "SPLIT", split)
        parts = reader.partitions()
        assert len(parts) > 4 or split == 30_000
        assert [r for p in parts for r in reader.read(p)] == whole
    assert len(whole) == 2 * 199 == len(pcap.read(spark, str(tmp_path / "*.pcap")).collect())  # the first has no payload


def test_next_generation_capture(tmp_path, spark):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    data = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for p in PACKETS:
        data += block(6, struct.pack("<IIIII", 0, 0, 1_000_000, len(p), len(p)) + p + b"\0" * (-len(p) % 4))
    (tmp_path / "a.pcapng").write_bytes(data)
    rows = pcap.read(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and rows[0]["ts"] == 1.0


def test_other_packets_are_left_out():
    assert pcap.tcp(pcap.ETHERNET, b"") is None
    assert pcap.tcp(pcap.ETHERNET, b"\0" * 12 + b"\x86\xdd" + b"\0" * 60) is None
    vlan = PACKETS[0][:12] + b"\x81\x00\x00\x05" + PACKETS[0][12:]
    assert pcap.tcp(pcap.ETHERNET, vlan)[4] == b"USER admin\r\n"
    assert pcap.tcp(pcap.RAW, PACKETS[0][14:])[0] == ATTACKER


def test_extraction_from_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(PACKETS * 2))
    (tmp_path / "f.csv").write_text(f" Source IP, Source Port, Destination IP, Destination Port, Protocol, Label\n{ATTACKER},5000,{SERVER},21,6,FTP-Patator\n{ATTACKER},5001,{SERVER},22,6,SSH-Patator\n")
    ftp = jobs.extract_files(spark, str(tmp_path / "a.pcap"), "FTP-Patator", out=str(tmp_path / "out")).first().asDict()
    assert (ftp["accepted"], ftp["rejected_duplicate"], ftp["candidates_seen"]) == (1, 1, 2)
    ssh = jobs.extract_files(spark, str(tmp_path / "a.pcap"), "SSH-Patator", str(tmp_path / "f.csv")).first().asDict()
    assert ssh["accepted"] == 1
    dos = jobs.extract_files(spark, str(tmp_path / "a.pcap"), "DoS", str(tmp_path / "f.csv")).collect()
    assert {r["category"] for r in dos} == {"DoS_FTP-Patator", "DoS_SSH-Patator"}
    assert [r["line"] for r in jobs.extract_files(spark, str(tmp_path / "a.pcap"), "attack").collect()] == ["USER admin"]
    assert jobs.verify_files(spark, str(tmp_path / "out")).count() == 0
    (tmp_path / "out" / "x.manifest.json").write_text(sinks.manifest({"accepted": 3}, category="gone", min_len=4))
    assert [(r["category"], r["problem"]) for r in jobs.verify_files(spark, str(tmp_path / "out")).collect()] == [("gone", "missing")]


def test_manifests_have_counters_and_settings(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture([*PACKETS, packet(ATTACKER, 5000, SERVER, 21, b"PASS secret\r\n"), packet(ATTACKER, 5000, SERVER, 21, b"PASV\r\n"), PACKETS[3]]))
    (tmp_path / "f.csv").write_text(f"Source IP,Source Port,Destination IP,Destination Port,Protocol,Label\n{ATTACKER},5000,{SERVER},21,6,DoS Hulk\n{ATTACKER},5001,{SERVER},22,6,BENIGN\n{ATTACKER},5001,{SERVER},22,6,DoS slow\n9.9.9.9,1,{SERVER},2,6,Heartbleed\n")
    out = str(tmp_path / "ftp")
    jobs.extract_files(spark, str(tmp_path / "a.pcap"), "FTP-Patator", out=out, cap=2)
    m = json.loads((tmp_path / "ftp" / "reservoir_FTP-Patator.manifest.json").read_text())
    assert list(m) == sorted(m) and (m["accepted"], m["cap_hit"], m["candidates_seen"], m["cap"], m["min_len"]) == (2, True, 2, 2, 4)
    # USER, the reply, SSH, PASS, and the packet at which the run stops
    assert (m["packets_scanned"], m["stopped_early"], m["sublabel"]) == (5, True, None) and m["elapsed_seconds"] >= 0
    whole = jobs.extract_files(spark, str(tmp_path / "a.pcap"), "FTP-Patator", out=out, cap=2, stop_at_cap=False).first()
    assert (whole["packets_scanned"], whole["stopped_early"], whole["candidates_seen"], whole["accepted"]) == (6, False, 3, 2)
    out = str(tmp_path / "dos")
    jobs.extract_files(spark, str(tmp_path / "a.pcap"), "DoS", str(tmp_path / "f.csv"), out)
    found = {p.name: json.loads(p.read_text()) for p in (tmp_path / "dos").glob("*.json")}
    assert set(found) == {f"reservoir_DoS_{x}.manifest.json" for x in ("DoS-Hulk", "DoS-slow", "Heartbleed")}
    assert found["reservoir_DoS_Heartbleed.manifest.json"]["accepted"] == 0
    hulk = found["reservoir_DoS_DoS-Hulk.manifest.json"]
    assert (hulk["accepted"], hulk["raw_label"], hulk["sublabel"], hulk["run_packets_scanned"], hulk["packets_scanned"]) == (3, "DoS Hulk", "DoS-Hulk", 6, 0)
    assert hulk["flow_index_stats"] == {"collisions": 1, "hit_rate": 5 / 6, "hits": 5, "lookups": 6, "unmatched": 1}
    assert jobs.verify_files(spark, out).count() == 0 and not list(tmp_path.glob("*-scanned"))


def test_command_line(spark, tmp_path, capsys):
    from tidewheel.__main__ import main

    (tmp_path / "a.pcap").write_bytes(capture(PACKETS))
    assert main(["extract", "FTP-Patator", "--pcap", str(tmp_path / "a.pcap"), "--out-dir", str(tmp_path / "o")], spark) == 0
    assert main(["verify", str(tmp_path / "o")], spark) == 0
    (tmp_path / "o" / "y.manifest.json").write_text(sinks.manifest({"accepted": 1}, category="none"))
    assert main(["verify", str(tmp_path / "o")], spark) == 1 and "none: missing (1)" in capsys.readouterr().out
    for mode, want in (("attack", ["USER admin"]), ("benign-ftp", []), ("benign-http", [])):
        assert main(["--quiet", "extract", mode, "--pcap", str(tmp_path / "a.pcap"), "--out-dir", str(tmp_path / "o")], spark) == 0
        assert [r["value"] for r in spark.read.text(str(tmp_path / "o" / mode)).collect()] == want
    (tmp_path / "p.txt").write_text("USER x\nnothing here\n")
    (tmp_path / "l.txt").write_text("FTP-Patator\nBENIGN\n")
    assert main(["inspect", str(tmp_path / "p.txt"), str(tmp_path / "l.txt")], spark) == 0
    assert "True positives" in capsys.readouterr().out
    (tmp_path / "x.txt").write_text("a\nb\n")
    (tmp_path / "b.txt").write_text("c\nd\ne\n")
    assert main(["build", str(tmp_path / "d"), "--reservoir", f"x={tmp_path}/x.txt", "--reservoir", f"BENIGN={tmp_path}/b.txt", "--count", "x=1"], spark) == 0
    assert "BENIGN: 1 of 3" in capsys.readouterr().out


def test_other_categories(spark, tmp_path):
    """Ports, prefixes and credentials of the categories that no other test offers to."""
    web = "192.168.10.9"
    rows = [packet(web, 4000, SERVER, 80, b"GET / HTTP/1.1\r\n"), packet("172.16.0.1", 4000, SERVER, 80, b"GET /x\r\n"), packet("10.1.1.1", 7, SERVER, 21, b"user bob\r\n"), packet("10.1.1.1", 7, SERVER, 21, b"LIST all\r\n"), packet(ATTACKER, 7, SERVER, 21, b"LIST more\r\n")]
    (tmp_path / "a.pcap").write_bytes(capture(rows))
    (tmp_path / "f.csv").write_text(f"Source IP,Source Port,Destination IP,Destination Port,Protocol,Label\n{web},4000,{SERVER},80,6,Web Attack - XSS\n10.1.1.1,7,{SERVER},21,6,Infiltration\n172.16.0.1,4000,{SERVER},80,6,Web Attack Brute Force\n")
    lines = lambda c, **k: sorted(r["line"] for r in jobs.extract_files(spark, str(tmp_path / "a.pcap"), c, **k).collect())
    assert lines("benign-http") == ["GET / HTTP/1.1"] and lines("benign-ftp") == ["LIST all"] and lines("attack") == ["LIST more"]
    held = lambda c: {r["category"]: r["accepted"] for r in jobs.extract_files(spark, str(tmp_path / "a.pcap"), c, str(tmp_path / "f.csv")).collect()}
    assert held("BENIGN") == {"BENIGN": 1} and held("Infiltration") == {"Infiltration": 2}
    assert held("Web-Attack") == {"Web-Attack_XSS": 1, "Web-Attack_Brute-Force": 1}


def test_lines_and_numbers(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\nUSER a\r\n   \n one still-one \nlast", encoding="utf-8", newline="")
    assert [tuple(r) for r in text.payloads(spark, str(tmp_path / "p.txt")).orderBy("packet_id").collect()] == [(0, "USER a"), (1, "one still-one"), (2, "last")]
    (tmp_path / "r.txt").write_text("user \n\npass \n")
    g = text.rule_group(spark, "g", str(tmp_path / "r.txt"))
    assert g.rules == (b"user ", b"pass ")
    (tmp_path / "res.txt").write_text("\n\na\n\nb\n")
    assert [tuple(r) for r in text.reservoir(spark, str(tmp_path / "res.txt")).orderBy("seq").collect()] == [(0, "a"), (1, ""), (2, "b")]


def test_numbers_follow_files_over_many_tasks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = text.payloads(spark, str(tmp_path)).orderBy("packet_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in rows] == [(k * 2000 + i, f"{k}-{i}") for k in range(3) for i in range(2000)]


def test_inspection_job_and_sinks(spark, tmp_path):
    (tmp_path / "p.txt").write_text("USER x\nnothing here\nPASV\nSTOR file\n")
    (tmp_path / "l.txt").write_text("FTP-Patator\nBENIGN\nFTP-Patator\nBENIGN\n")
    row = jobs.run_inspection(spark, str(tmp_path / "p.txt"), str(tmp_path / "l.txt"), "run_1", out=str(tmp_path / "o"))
    assert [row[k] for k in ("tp", "tn", "fp", "fn", "skipped")] == [1, 1, 1, 1, 1]
    back = tables.packet_results(spark, str(tmp_path / "o" / "run_1_packets"))
    assert [r["outcome"] for r in back.orderBy("packet_id").collect()] == ["TP", "TN", "FN", "FP"]
    assert tables.summary_results(spark, str(tmp_path / "o" / "run_1_summary"))["tp"] == 1
    assert sinks.latex_row(row).startswith("run\\_1 & 1 & 1 & 1 & 1 & 50.00")
    tex = tmp_path / "t.tex"
    for _ in range(2):
        sinks.append_latex(str(tex), row)
    sinks.finish_latex(str(tex))
    sinks.finish_latex(str(tex))
    assert tex.read_text().count("\\end{table}") == 1 and tex.read_text() == sinks.latex_table([row, row])
    assert "True positives" in sinks.console_report(row)


def test_dataset_files(spark, tmp_path):
    for name, n in (("x", 4), ("BENIGN", 9)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(n)))
    report = jobs.build_dataset(spark, {n: str(tmp_path / f"{n}.txt") for n in ("x", "BENIGN")}, {"x": 4}, str(tmp_path / "d"))
    assert {r["category"]: r["used"] for r in report.collect()} == {"x": 4, "BENIGN": 4}
    payloads, labels = (next((tmp_path / "d" / k).glob("part-*")).read_text().split() for k in ("payloads", "labels"))
    assert payloads[::2] == labels and len(labels) == 8


def test_manifest_is_sorted():
    assert list(json.loads(sinks.manifest({"b": 1}, a=2))) == ["a", "b"]


def test_streaming_agrees_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["USER a", "x y z w", "abc", "STOR b"])], "packet_id long, payload string")
    rows.write.parquet(str(tmp_path / "in"))
    labels = spark.createDataFrame([(0, "FTP"), (1, "BENIGN"), (2, "FTP")], "packet_id long, label string")
    stream = streaming.inspected(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    streaming.start_metrics(stream, labels, str(tmp_path / "m"), str(tmp_path / "c")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "m")).orderBy("batch").collect()[-1]
    from tidewheel.operators.evaluate import with_labels
    from tidewheel.operators.inspect import inspect

    want = summary(with_labels(inspect(rows), labels)).first()
    assert [got[k] for k in ("total", "tp", "tn", "fp", "fn")] == [want[k] for k in ("total", "tp", "tn", "fp", "fn")]
