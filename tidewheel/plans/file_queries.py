"""Sources and sinks on the driver's tables: each query writes a table to files, reads them back, and has SQL on the table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import text as t
from tidewheel.operators import dataset, evaluate, reservoir
from tidewheel.plans import jobs, queries as q
from tidewheel.sources import pcap, sinks, tables
from tidewheel.sources import text as files
from tidewheel.sources.scratch import folder

_LABELLED = q._LABELLED
_LINE = "regexp_replace(text, '[\\n\\r]', ' ', 'g')"


def _lines(spark, d) -> DataFrame:
    """doc_id and text on one line."""
    return q.read(spark, d, "documents").select("doc_id", F.translate("text", "\n\r", "  ").alias("text"))


def _trimmed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{q._W}]+', ''), '[{q._W}]+$', '')"


@q.query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS packet_id, md5(p) AS digest FROM (SELECT doc_id, {_trimmed(_LINE)} AS p FROM documents) WHERE p <> ''")
def payload_file(spark, d):
    path = folder(spark, "payloads")
    _lines(spark, d).orderBy("doc_id").select("text").write.option("lineSep", "\n").text(path)
    return files.payloads(spark, path).select("packet_id", F.md5(F.col("payload").cast("binary")).alias("digest"))


@q.query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS packet_id, CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'BENIGN' END AS label FROM labels")
def label_file(spark, d):
    path = folder(spark, "labels")
    q.doc_labels(spark, d).orderBy("packet_id").select(F.concat(F.lit(" "), "label", F.lit("\t")).alias("label")).write.option("lineSep", "\n").text(path)
    return files.labels(spark, path)


#: Lines of a rule file: a space at the end counts, empty lines and a carriage return at the end don't.
_RULE_FILE = "user \n\npass \r\nstor \n"


@q.query("SELECT * FROM (VALUES (0, 'user ', 64, 7, 19), (1, 'pass ', 64, 7, 19), (2, 'stor ', 64, 7, 19)) v(place, rule, m, k, bits_set)")
def rule_file(spark, d):
    path = f"{folder(spark, 'rules')}/rules.txt"
    sinks.write_file(spark, path, _RULE_FILE)
    g = files.rule_group(spark, "FTP-5byte", path)
    return spark.createDataFrame([(i, r.decode(), *g.bloom.stats()) for i, r in enumerate(g.rules)], "place int, rule string, m int, k int, bits_set int")


_HIT = q._HIT


@q.query(f"""SELECT packet_id, alert, label, CAST(a AND {_HIT} AS INTEGER) AS tp, CAST(NOT a AND NOT {_HIT} AS INTEGER) AS tn, CAST(NOT a AND {_HIT} AS INTEGER) AS fp, CAST(a AND NOT {_HIT} AS INTEGER) AS fn,
  windows, windows AS candidates, CAST(CASE WHEN windows > 0 THEN 0 ELSE 100 END AS DOUBLE) AS pruning_pct, CAST(0 AS DOUBLE) AS duration_ms, label = 'TOXIC' AS is_attack,
  CASE WHEN label = 'TOXIC' AND alert THEN 'TP' WHEN label = 'TOXIC' THEN 'FN' WHEN alert THEN 'FP' ELSE 'TN' END AS outcome
  FROM (SELECT packet_id, alert, skipped, windows, coalesce(label, 'UNKNOWN') AS label, coalesce(label, 'UNKNOWN') <> 'BENIGN' AS a FROM {_LABELLED})""")
def packet_file(spark, d):
    path = folder(spark, "packets")
    sinks.write_packets(q.labelled_documents(spark, d).withColumn("candidates", F.col("windows")), path)
    return tables.packet_results(spark, path, "TOXIC")


@q.query(f"SELECT 'a_b' AS run, total, skipped, tp, tn, fp, fn, {q._sql_rounded('accuracy', 'precision', 'recall', 'f1', 'fpr', 'fnr', 'mcc', n=4)} FROM ({q._METRICS})")
def summary_file(spark, d):
    path = folder(spark, "summary")
    sinks.write_summary(evaluate.summary(q.labelled_documents(spark, d), "a_b"), path)
    return spark.createDataFrame([tables.summary_results(spark, path)], tables.SUMMARY_SCHEMA).select("run", "total", "skipped", "tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1", "fpr", "fnr", "mcc")


@q.query(f"SELECT category, k - 1 AS seq, md5(line) AS digest FROM {q._ADMITTED}")
def reservoir_files(spark, d):
    """Every reservoir's file, read back by place."""
    path = folder(spark, "reservoirs")
    held = reservoir.admit(q.offered(spark, d), q.CAP, **q._OPTIONS)
    sinks.write_reservoirs(held, path)
    names = [r["category"] for r in held.select("category").distinct().collect()]  # a handful of reservoirs
    each = [files.reservoir(spark, f"{path}/category={n}").select(F.lit(n).alias("category"), "seq", F.md5(F.col("line").cast("binary")).alias("digest")) for n in names]
    return dataset.union(each)


@q.query(f"SELECT id, category, md5({_LINE}) AS digest FROM (SELECT row_number() OVER (ORDER BY md5('{q.SEED}|' || CAST(b.id AS VARCHAR)), b.id) - 1 AS id, b.category, text FROM {q._BUILT} b JOIN documents ON doc_id = b.id)")
def dataset_files(spark, d):
    """Payloads and labels of a data set, aligned by line: both files are numbered and joined by place."""
    path = folder(spark, "dataset")
    lines = q.dataset_lines(spark, d).withColumn("line", F.translate("line", "\n\r", "  "))
    sinks.write_dataset(dataset.balanced(lines, q._MALICIOUS, q.SEED), path)
    payloads, labels = (files.nonempty_lines(spark, f"{path}/{k}") for k in ("payloads", "labels"))
    return payloads.join(labels.withColumnRenamed("line", "category"), "id").select("id", "category", F.md5(F.col("line").cast("binary")).alias("digest"))


@q.query(f"SELECT category, candidates_seen, rejected_not_printable, rejected_too_short, rejected_duplicate, accepted, cap_hit, 200 AS min_len, CAST(0.75 AS DOUBLE) AS hit_rate FROM ({q._stats_sql('count(*)')})")
def manifest_files(spark, d):
    path = folder(spark, "manifests")
    for r in reservoir.stats(q.offered(spark, d), q.CAP, **q._OPTIONS).collect():  # a handful of reservoirs
        sinks.write_file(spark, f"{path}/reservoir_{r['category']}.manifest.json", sinks.manifest(r.asDict(), min_len=200, flow_index_stats={"hit_rate": 0.75}))
    m = tables.manifests(spark, f"{path}/*.manifest.json")
    return m.select(F.col("reservoir").alias("category"), "candidates_seen", "rejected_not_printable", "rejected_too_short", "rejected_duplicate", "accepted", "cap_hit", F.col("min_len").cast("int").alias("min_len"), "hit_rate")


_IP = "CASE WHEN user_id % 7 = 0 THEN '192.168.10.51' WHEN user_id % 3 = 0 THEN '192.168.1.' || CAST(user_id % 250 AS VARCHAR(9)) ELSE '10.0.' || CAST(user_id % 199 AS VARCHAR(9)) || '.' || CAST(user_id % 250 AS VARCHAR(9)) END"
_PORT = "CAST(CASE event_id % 4 WHEN 0 THEN 21 WHEN 1 THEN 80 WHEN 2 THEN 22 ELSE 443 END AS INT)"
_PAYLOAD = "CASE WHEN event_id % 5 = 0 THEN 'USER ' || CAST(user_id AS VARCHAR(20)) WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || props END"
_PACKETS = f"SELECT {_IP} AS src_ip, CAST(1024 + event_id % 60000 AS INT) AS src_port, '10.1.0.1' AS dst_ip, {_PORT} AS dst_port, {_PAYLOAD} AS payload, event_id, value, user_id FROM events"


def packets(spark, d) -> DataFrame:
    """Events as TCP packets."""
    return q.read(spark, d, "events").selectExpr(*[x.strip() for x in (f"{_IP} AS src_ip", "CAST(1024 + event_id % 60000 AS INT) AS src_port", "'10.1.0.1' AS dst_ip", f"{_PORT} AS dst_port", f"{_PAYLOAD} AS payload", "event_id", "value", "user_id")])


@q.query(f"SELECT src_ip, src_port, dst_ip, dst_port, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS label, count(*) AS n FROM ({_PACKETS}) WHERE event_id % 3 <> 0 GROUP BY ALL")
def flow_csv_file(spark, d):
    """Labelled flows with the spaces and names that such files have; two thirds are TCP."""
    path = folder(spark, "flows")
    rows = packets(spark, d).select(
        F.col("src_ip").alias(" Source IP"), F.col("src_port").alias(" Source Port"), F.col("dst_ip").alias("Dst IP"), F.col("dst_port").alias(" Destination Port"), F.when(F.col("event_id") % 3 == 0, 17).otherwise(6).alias(" Protocol"), F.when(F.col("value") > 50, " HIGH").otherwise("LOW ").alias(" Label")
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.flow_labels(spark, path).groupBy("src_ip", "src_port", "dst_ip", "dst_port", "label").agg(F.count("*").alias("n"))


def _captured(spark, d) -> DataFrame:
    path = folder(spark, "captures")
    sinks.write_captures(packets(spark, d).select("src_ip", "src_port", "dst_ip", "dst_port", F.col("payload").cast("binary").alias("payload")), path)
    return pcap.read(spark, path)


@q.query(f"SELECT src_ip, src_port, dst_ip, dst_port, md5(payload) AS digest, count(*) AS n FROM ({_PACKETS}) WHERE payload <> '' GROUP BY ALL")
def capture_files(spark, d):
    """Captures with a packet for each event; those without payload aren't read."""
    return _captured(spark, d).groupBy("src_ip", "src_port", "dst_ip", "dst_port", F.md5("payload").alias("digest")).agg(F.count("*").alias("n"))


_KEPT = {
    "FTP-Patator": "src_ip = '192.168.10.51' AND dst_port = 21",
    "BENIGN": "dst_port = 80 AND starts_with(src_ip, '192.168.')",
    "attack": "src_ip = '192.168.10.51' AND dst_port = 21",
    "benign-ftp": "dst_port = 21 AND src_ip <> '192.168.10.51' AND NOT starts_with(upper(payload), 'USER') AND NOT starts_with(upper(payload), 'PASS')",
    "benign-http": "dst_port = 80 AND starts_with(src_ip, '192.168.')",
}
_LABELS = {"SSH-Patator": "label = 'SSH-Patator'", "Infiltration": "label = 'Infiltration'", "DoS": "label <> 'BENIGN'", "Web-Attack": "starts_with(label, 'Web Attack')"}
_LABEL = "CASE user_id % 5 WHEN 0 THEN 'SSH-Patator' WHEN 1 THEN 'Infiltration' WHEN 2 THEN 'DoS Hulk' WHEN 3 THEN 'Web Attack - XSS' ELSE 'BENIGN' END"


@q.query(" UNION ALL ".join(f"SELECT '{name}' AS category, count(*) AS n FROM ({_PACKETS}) WHERE payload <> '' AND {where}" for name, where in _KEPT.items()))
def capture_categories(spark, d):
    """What the categories that go by addresses and ports keep of the captures."""
    rows = _captured(spark, d)
    return dataset.union([rows.where(jobs.CATEGORIES[n].keep()).agg(F.count("*").alias("n")).select(F.lit(n).alias("category"), "n") for n in _KEPT])


@q.query(" UNION ALL ".join(f"SELECT '{name}' AS category, count(*) AS n FROM (SELECT {_LABEL} AS label FROM events) WHERE {where}" for name, where in _LABELS.items()))
def label_categories(spark, d):
    """What the categories that go by labels keep of labelled events."""
    rows = q.read(spark, d, "events").selectExpr(f"{_LABEL} AS label")
    return dataset.union([rows.where(jobs.CATEGORIES[n].keep()).agg(F.count("*").alias("n")).select(F.lit(n).alias("category"), "n") for n in _LABELS])


@q.query("SELECT doc_id, substr(sha256(text), 1, 32) AS digest FROM documents")
def payload_digests(spark, d):
    return q.read(spark, d, "documents").select("doc_id", t.payload_digest(F.col("text")).alias("digest"))


@q.query(f"""SELECT packet_id, position FROM (SELECT packet_id, unnest(list_filter(range(1, len(bs) - 3), lambda i: {q._tests(q.GROUPS[0])})) - 1 AS position
  FROM (SELECT packet_id, {q._BYTES} AS bs FROM (SELECT item_id AS packet_id, {q._norm('text')} AS n FROM benchmark)))""")
def candidate_places(spark, d):
    """Where windows begin that the first group's filter lets through."""
    from tidewheel.operators.bloom import candidate_positions
    from tidewheel.operators.inspect import normalised

    g = q.GROUPS[0]
    at = candidate_positions(g.bloom, g.window_len)
    return q.items(spark, d).select("packet_id", F.explode(at(normalised(F.col("payload")).cast("binary"))).alias("position"))


@q.query(f"SELECT packet_id, CASE WHEN windows > 0 THEN round(100.0 * (1 - CAST(candidates AS DOUBLE) / windows), 1) ELSE CAST(0 AS DOUBLE) END AS pruning_pct FROM ({q._candidates('benchmark', 'item_id', q.TABLE_GROUPS)})")
def pruning_console(spark, d):
    """Pruning as the console shows it: 0 where there are no windows."""
    found = q.inspect(q.items(spark, d), q.TABLE_GROUPS, candidates=True)
    return found.select("packet_id", F.round(evaluate.pruning_pct(F.col("windows"), F.col("candidates"), 0.0), 1).alias("pruning_pct"))


@q.query("SELECT id, category, CASE WHEN length(line) > 60 THEN substr(line, 1, 60) || '...' ELSE line END AS preview FROM (SELECT CASE WHEN lang = 'en' THEN 'BENIGN' ELSE lang END AS category, doc_id AS id, text AS line FROM documents) ORDER BY id LIMIT 8")
def dataset_preview(spark, d):
    return dataset.preview(q.dataset_lines(spark, d))
