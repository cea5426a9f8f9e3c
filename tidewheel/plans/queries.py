"""The operators on the driver's tables, each as a query, with SQL that gives the same rows.

Payloads are documents, pages and conversations; a document's label is TOXIC or BENIGN by the labels table,
which lacks many; categories are sources; every event is a flow, and a packet under the key of the next user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import text as t
from tidewheel.operators import bloom, dataset, evaluate, flows, report, reservoir
from tidewheel.operators.inspect import GROUPS, RuleGroup, byte_windows, circuit_gates, group_table, inspect, inspect_single, keyed_alerts, min_window, normalised, phase, semi_join_alerts

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}

#: The shipped groups, and groups with rules that occur in the tables.
TABLE_GROUPS = (*GROUPS, RuleGroup("License-7byte", ("license",)), RuleGroup("Token-5byte", ("token",)), RuleGroup("Page-6byte", ("script", "track(")))
CAP, DATASET_COUNT, SEED = 20, 10, 42


def query(sql: str | None):
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("packet_id"), F.col("text").alias("payload"))


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("packet_id"), F.when(F.col("toxic") == 1, "TOXIC").otherwise("BENIGN").alias("label"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("packet_id"), F.col("text").alias("payload"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("packet_id"), F.col("text").alias("payload"))


# Parts of the SQL


def _norm(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alert(c: str, groups) -> str:
    return "(" + " OR ".join(f"contains({c}, '{r.decode()}')" for g in groups for r in g.rules) + ")"


def _windows(size: str, groups) -> str:
    return " + ".join(f"greatest({size} - {g.window_len} + 1, 0)" for g in groups)


def _inspect(table: str, key: str, col: str, groups) -> str:
    least = min_window(groups)
    return f"""SELECT {key} AS packet_id, strlen(n) >= {least} AND {_alert("n", groups)} AS alert, strlen(n) < {least} AS skipped,
      CAST(CASE WHEN strlen(n) < {least} THEN 0 ELSE {_windows("strlen(n)", groups)} END AS BIGINT) AS windows
      FROM (SELECT {key}, {_norm(col)} AS n FROM {table})"""


def _tests(group: RuleGroup) -> str:
    """SQL for whether the window at i of the byte list bs passes the filter of a group, m being 64."""
    w, bits = group.window_len, sorted(group.bloom.bits)
    h1 = f"list_reduce(list_prepend({bloom.FNV_OFFSET % 64}, bs[i:i + {w - 1}]), lambda a, b: (xor(a, b) * {bloom.FNV_PRIME % 64}) % 64)"
    h2 = f"list_reduce(list_prepend({bloom.DJB2_INIT % 64}, bs[i:i + {w - 1}]), lambda a, b: (a * {bloom.DJB2_FACTOR} + b) % 64)"
    return " AND ".join(f"list_contains({bits}, ({h1} + {j} * ({h2} | 1)) % 64)" for j in range(group.bloom.k))


def _probe(group: RuleGroup) -> str:
    """SQL for the number of windows of the byte list bs that pass the filter of a group."""
    return f"len(list_filter(range(1, len(bs) - {group.window_len} + 2), lambda i: {_tests(group)}))"


#: The bytes of a text column as a list of numbers.
_BYTES = "list_transform(range(0, strlen(n)), lambda i: CAST(concat('0x', substr(hex(encode(n)), CAST(2 * i + 1 AS INTEGER), 2)) AS INTEGER))"


def _candidates(table: str, key: str, groups) -> str:
    least = min_window(groups)
    counts = " + ".join(_probe(g) for g in groups)
    return f"""SELECT packet_id, alert, skipped, windows, CAST(CASE WHEN skipped THEN 0 ELSE {counts} END AS BIGINT) AS candidates FROM (
      SELECT i.*, {_BYTES} AS bs FROM ({_inspect(table, key, "text", groups)}) i JOIN (SELECT {key} AS k, {_norm("text")} AS n FROM {table}) ON k = packet_id)"""


_LABELLED = f"""(SELECT r.*, l.label, coalesce(l.label <> 'BENIGN', false) AS is_attack FROM ({_inspect("documents", "doc_id", "text", TABLE_GROUPS)}) r
  LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'BENIGN' END AS label FROM labels) l ON l.doc_id = r.packet_id)"""
_HIT = "(alert AND NOT skipped)"
_COUNTS = f"""count(*) AS total, count(*) FILTER (skipped) AS skipped, count(*) FILTER (is_attack AND {_HIT}) AS tp, count(*) FILTER (NOT is_attack AND NOT {_HIT}) AS tn,
  count(*) FILTER (NOT is_attack AND {_HIT}) AS fp, count(*) FILTER (is_attack AND NOT {_HIT}) AS fn"""
_CONFUSION = f"SELECT {_COUNTS} FROM {_LABELLED}"


def _over(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST(({a}) AS DOUBLE) / ({b}) END"


_METRICS = f"""SELECT *, {_over("2 * precision * recall", "precision + recall")} AS f1 FROM (
  SELECT *, {_over("tp + tn", "total")} AS accuracy, {_over("tp", "tp + fp")} AS precision, {_over("tp", "tp + fn")} AS recall, {_over("fp", "fp + tn")} AS fpr, {_over("fn", "fn + tp")} AS fnr,
  {_over("CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn", "sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))")} AS mcc FROM ({_CONFUSION}))"""


def _rounded(*names: str, n: int = 6):
    return [F.round(x, n).alias(x) for x in names]


def _sql_rounded(*names: str, n: int = 6) -> str:
    return ", ".join(f"round({x}, {n}) AS {x}" for x in names)


# Inspection


@query(_inspect("documents", "doc_id", "text", TABLE_GROUPS))
def inspect_documents(spark, d):
    return inspect(docs(spark, d), TABLE_GROUPS)


@query(f"SELECT packet_id, alert FROM ({_inspect('documents', 'doc_id', 'text', GROUPS)})")
def inspect_alert(spark, d):
    return inspect(docs(spark, d)).select("packet_id", "alert")


@query(f"SELECT packet_id, windows FROM ({_inspect('documents', 'doc_id', 'text', GROUPS)})")
def inspect_windows(spark, d):
    return inspect(docs(spark, d)).select("packet_id", "windows")


@query(f"SELECT packet_id, skipped FROM ({_inspect('documents', 'doc_id', 'text', GROUPS)})")
def inspect_skipped(spark, d):
    return inspect(docs(spark, d)).select("packet_id", "skipped")


@query(_inspect("pages", "page_id", "html", TABLE_GROUPS))
def inspect_pages(spark, d):
    return inspect(read(spark, d, "pages"), TABLE_GROUPS, "page_id", "html")


@query(_inspect("conversations", "conv_id * 100000 + turn", "text", TABLE_GROUPS).replace("(SELECT conv_id * 100000 + turn,", "(SELECT conv_id, turn,"))
def inspect_conversations(spark, d):
    return inspect(turns(spark, d), TABLE_GROUPS)


@query(_inspect("documents", "doc_id", "text", TABLE_GROUPS[6:7]))
def inspect_single_group(spark, d):
    return inspect_single(docs(spark, d), TABLE_GROUPS[6])


@query(_candidates("benchmark", "item_id", TABLE_GROUPS))
def inspect_candidates(spark, d):
    return inspect(items(spark, d), TABLE_GROUPS, candidates=True)


@query(None)  # SQL takes minutes for the hashes of all windows of whole documents
def inspect_candidates_documents(spark, d):
    return inspect(docs(spark, d), TABLE_GROUPS, candidates=True)


_TURN_ALERTS = f"SELECT conv_id * 100000 + turn AS packet_id FROM (SELECT conv_id, turn, {_norm('text')} AS n FROM conversations) WHERE {_alert('n', TABLE_GROUPS)}"


@query(_TURN_ALERTS)
def window_semi_join(spark, d):
    return semi_join_alerts(turns(spark, d), TABLE_GROUPS)


@query(_TURN_ALERTS)
def keyed_token_alerts(spark, d):
    return keyed_alerts(turns(spark, d), TABLE_GROUPS, "a key of the caller")


@query(f"SELECT packet_id, CAST(i AS INTEGER) AS position, substr(hex(encode(n)), CAST(2 * i + 1 AS INTEGER), 10) AS w FROM (SELECT item_id AS packet_id, n, unnest(range(0, strlen(n) - 4)) AS i FROM (SELECT item_id, {_norm('text')} AS n FROM benchmark))")
def sliding_windows(spark, d):
    return byte_windows(items(spark, d), 5).select("packet_id", "position", F.hex("window").alias("w"))


@query("SELECT doc_id AS packet_id, CASE WHEN strlen(text) < 3000 THEN 'phase1' ELSE 'phase2' END AS phase FROM documents")
def phase_partition(spark, d):
    return docs(spark, d).select("packet_id", phase(F.octet_length("payload")).alias("phase"))


@query("SELECT n, m, CAST(least(7, greatest(1, floor(m / n * ln(2) + 0.5))) AS INTEGER) AS k FROM (SELECT n, CAST(greatest(64, ceil(-n * ln(0.1) / (ln(2) * ln(2)))) AS INTEGER) AS m FROM (SELECT unnest(range(1, 500)) AS n))")
def bloom_sizing(spark, d):
    return spark.createDataFrame([(n, *bloom.sizes(n)) for n in range(1, 500)], "n long, m int, k int")


def _rules_values() -> str:
    return ", ".join(f"('{g.name}', '{r.decode()}', {g.bloom.k})" for g in TABLE_GROUPS for r in g.rules)


@query(f"""SELECT name, CAST(bit AS INTEGER) AS bit FROM (SELECT DISTINCT name, unnest(list_transform(range(0, k), lambda i: (h1 + i * (h2 | 1)) % 64)) AS bit FROM (
  SELECT name, k, list_reduce(list_prepend({bloom.FNV_OFFSET % 64}, bs), lambda a, b: (xor(a, b) * {bloom.FNV_PRIME % 64}) % 64) AS h1, list_reduce(list_prepend({bloom.DJB2_INIT % 64}, bs), lambda a, b: (a * 33 + b) % 64) AS h2
  FROM (SELECT name, k, {_BYTES} AS bs FROM (VALUES {_rules_values()}) v(name, n, k))))""")
def bloom_bits(spark, d):
    return group_table(spark, TABLE_GROUPS).select(F.col("group").alias("name"), F.explode("bits").alias("bit"))


#: Bits set by each shipped group, as known.
_KNOWN_BITS = {"FTP-5byte": 19, "FTP-6byte": 20, "BruteForce-14byte": 7, "BruteForce-18byte": 7, "XSS-12byte": 13, "XSS-15byte": 7}


@query(f"SELECT name, 64 AS m, 7 AS k, bits_set FROM (VALUES {', '.join(map(str, _KNOWN_BITS.items()))}) v(name, bits_set)")
def bloom_stats(spark, d):
    return group_table(spark, GROUPS).select(F.col("group").alias("name"), "m", "k", "bits_set")


@query(f"SELECT packet_id, CAST({_probe(GROUPS[0])} AS BIGINT) AS candidates FROM (SELECT packet_id, {_BYTES} AS bs FROM (SELECT item_id AS packet_id, {_norm('text')} AS n FROM benchmark))")
def bloom_probe_sql(spark, d):
    g = GROUPS[0]
    raw = items(spark, d).select("packet_id", t.payload_bytes(normalised(F.col("payload"))).alias("bs"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("bs") - g.window_len + 1, F.lit(1)))
    hits = F.filter(starts, lambda i: (i + g.window_len - 1 <= F.size("bs")) & bloom.probe_sql(F.slice("bs", i, g.window_len), g.bloom))
    return raw.select("packet_id", F.size(hits).cast("long").alias("candidates"))


@query("SELECT doc_id AS packet_id, CAST(greatest(strlen(text) - 4, 0) * (3 * 17 * 5 + 2) AS BIGINT) AS gates FROM documents")
def circuit_gate_count(spark, d):
    g = GROUPS[0]
    windows = F.greatest(F.octet_length("payload") - g.window_len + 1, F.lit(0)).cast("long")
    return docs(spark, d).select("packet_id", circuit_gates(windows, len(g.rules), g.window_len).alias("gates"))


# Evaluation


def labelled_documents(spark, d):
    return evaluate.with_labels(inspect(docs(spark, d), TABLE_GROUPS), doc_labels(spark, d))


@query(f"SELECT packet_id, label, is_attack FROM {_LABELLED}")
def label_join(spark, d):
    return labelled_documents(spark, d).select("packet_id", "label", "is_attack")


@query(_CONFUSION)
def confusion_counts(spark, d):
    return evaluate.confusion(labelled_documents(spark, d))


@query(f"SELECT {_sql_rounded('accuracy', 'precision', 'recall', 'f1', 'fpr', 'fnr')} FROM ({_METRICS})")
def classification_metrics(spark, d):
    return evaluate.metrics(evaluate.confusion(labelled_documents(spark, d))).select(*_rounded("accuracy", "precision", "recall", "f1", "fpr", "fnr"))


@query(f"SELECT {_sql_rounded('mcc')} FROM ({_METRICS})")
def mcc(spark, d):
    return evaluate.metrics(evaluate.confusion(labelled_documents(spark, d))).select(*_rounded("mcc"))


_ITEM_LABELS = f"""(SELECT r.*, coalesce(l.label, 'UNKNOWN') AS label FROM ({_candidates("benchmark", "item_id", TABLE_GROUPS)}) r
  LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'BENIGN' END AS label FROM labels) l ON l.doc_id = packet_id)"""


@query(f"""SELECT packet_id, alert, label, CAST(a AND {_HIT} AS INTEGER) AS tp, CAST(NOT a AND NOT {_HIT} AS INTEGER) AS tn, CAST(NOT a AND {_HIT} AS INTEGER) AS fp, CAST(a AND NOT {_HIT} AS INTEGER) AS fn,
  windows, candidates, round(CASE WHEN windows > 0 THEN 100.0 * (1 - CAST(candidates AS DOUBLE) / windows) ELSE 100.0 END, 1) AS pruning_pct FROM (SELECT *, label <> 'BENIGN' AS a FROM {_ITEM_LABELS})""")
def packet_csv_rows(spark, d):
    labelled = evaluate.with_labels(inspect(items(spark, d), TABLE_GROUPS, candidates=True), doc_labels(spark, d))
    return evaluate.packet_rows(labelled).drop("duration_ms")


def inspected_documents(spark, d):
    return evaluate.with_labels(inspect(docs(spark, d), TABLE_GROUPS, candidates=True), doc_labels(spark, d))


@query(None)  # as inspect_candidates_documents
def packet_csv_rows_documents(spark, d):
    return evaluate.packet_rows(inspected_documents(spark, d)).drop("duration_ms")


@query(f"SELECT 'documents' AS run, total, skipped, tp, tn, fp, fn, {_sql_rounded('accuracy', 'precision', 'recall', 'f1', 'fpr', 'fnr', 'mcc', n=4)}, w AS total_windows FROM ({_METRICS}), (SELECT CAST(sum(windows) AS BIGINT) AS w FROM {_LABELLED} WHERE NOT skipped)")
def summary_row(spark, d):
    s = evaluate.summary(labelled_documents(spark, d), "documents")
    return s.select("run", "total", "skipped", "tp", "tn", "fp", "fn", *_rounded("accuracy", "precision", "recall", "f1", "fpr", "fnr", "mcc", n=4), "total_windows")


@query(f"SELECT CAST(sum(windows) AS BIGINT) AS total_windows, CAST(sum(candidates) AS BIGINT) AS total_candidates, round(1 - CAST(sum(candidates) AS DOUBLE) / sum(windows), 6) AS pruning_rate FROM ({_candidates('benchmark', 'item_id', TABLE_GROUPS)}) WHERE NOT skipped")
def pruning_rate(spark, d):
    labelled = evaluate.with_labels(inspect(items(spark, d), TABLE_GROUPS, candidates=True), doc_labels(spark, d))
    return evaluate.summary(labelled).select("total_windows", "total_candidates", *_rounded("pruning_rate"))


@query(None)  # as inspect_candidates_documents
def pruning_rate_documents(spark, d):
    return evaluate.summary(inspected_documents(spark, d)).select("total_windows", "total_candidates", *_rounded("pruning_rate"))


@query("SELECT round(avg(n_chars), 4) AS avg_time_ms, CAST(min(n_chars) AS DOUBLE) AS min_time_ms, CAST(max(n_chars) AS DOUBLE) AS max_time_ms FROM documents WHERE strlen(text) >= 5")
def timing_summary(spark, d):
    timed = read(spark, d, "documents").select(F.col("doc_id").alias("packet_id"), F.col("n_chars").cast("double").alias("duration_ms"))
    labelled = labelled_documents(spark, d).join(timed, "packet_id")
    return evaluate.summary(labelled).select(F.round("avg_time_ms", 4).alias("avg_time_ms"), "min_time_ms", "max_time_ms")


@query(f"SELECT packet_id, CASE WHEN is_attack AND alert THEN 'TP' WHEN is_attack THEN 'FN' WHEN alert THEN 'FP' ELSE 'TN' END AS outcome FROM {_LABELLED}")
def outcome_names(spark, d):
    return labelled_documents(spark, d).select("packet_id", evaluate.outcome_name(F.col("is_attack"), F.col("alert")).alias("outcome"))


# Text functions

_PRINTABLE = "CASE WHEN strlen(text) = 0 THEN 0.0 ELSE CAST(length(regexp_replace(text, '[^\\x09\\x0A\\x0D\\x20-\\x7E]', '', 'g')) AS DOUBLE) / strlen(text) END"
_W = "\\t\\n\\x0b\\x0c\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_S = _W + "\\x1c-\\x1f"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_S}]+', ''), '[{_S}]+$', '')"


def _clean(c: str) -> str:
    return _strip(f"regexp_replace({_strip(c)}, '[\\x00-\\x08\\x0A-\\x1F]', '', 'g')")


@query(f"SELECT doc_id, round({_PRINTABLE}, 6) AS ratio FROM documents")
def printable_ratio(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(t.printable_ratio(F.col("text")), 6).alias("ratio"))


@query(f"SELECT doc_id FROM documents WHERE {_PRINTABLE} >= 0.85")
def printable_gate(spark, d):
    return read(spark, d, "documents").where(t.is_printable_enough(F.col("text"), 0.85)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE strlen(text) > 0 AND {_PRINTABLE} >= 0.3")
def printable_gate_legacy(spark, d):
    return read(spark, d, "documents").where(t.is_printable(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN length(c) >= 4 THEN c END AS line FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)")
def clean_line(spark, d):
    return read(spark, d, "documents").select("doc_id", t.clean_line(F.col("text")).alias("line"))


@query(f"SELECT doc_id, CASE WHEN p >= 0.95 AND length(c) >= 4 THEN c END AS line FROM (SELECT doc_id, {_PRINTABLE} AS p, {_clean('text')} AS c FROM documents)")
def bytes_to_line(spark, d):
    return read(spark, d, "documents").select("doc_id", t.bytes_to_line(F.col("text"), threshold=0.95).alias("line"))


@query(f"SELECT doc_id FROM documents WHERE length({_clean('text')}) >= 200")
def min_len_gate(spark, d):
    return read(spark, d, "documents").where(F.length(t.clean_text(F.col("text"))) >= 200).select("doc_id")


@query(f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def ascii_lower(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(t.ascii_lower(F.col("text")).cast("binary")).alias("digest"))


def _slug(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"


@query(f"SELECT doc_id, md5({_slug('text')}) AS digest FROM documents")
def slugify(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(t.slugify(F.col("text")).cast("binary")).alias("digest"))


_WEB = "CASE doc_id % 5 WHEN 0 THEN 'Web Attack ~ Brute Force' WHEN 1 THEN 'Web Attack - XSS' WHEN 2 THEN 'Web Attack Sql Injection' WHEN 3 THEN concat(source, ' / ', lang) ELSE '' END"


@query(f"SELECT doc_id, CASE WHEN contains(lower(l), 'brute force') THEN 'Brute-Force' WHEN contains(lower(l), 'xss') THEN 'XSS' WHEN contains(lower(l), 'sql injection') THEN 'SQL-Injection' ELSE {_slug('l')} END AS slug FROM (SELECT doc_id, {_WEB} AS l FROM documents)")
def subtype_slug(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(_WEB).alias("l")).select("doc_id", t.subtype_slug(F.col("l")).alias("slug"))


@query("SELECT doc_id, replace(concat_ws('_', source, nullif(lang, 'en')), ' ', '_') AS name FROM documents")
def reservoir_names(spark, d):
    return read(spark, d, "documents").select("doc_id", t.reservoir_name(F.col("source"), F.nullif(F.col("lang"), F.lit("en"))).alias("name"))


@query("SELECT doc_id FROM documents WHERE NOT (starts_with(upper(substr(text, 1, 2)), 'TH') OR starts_with(upper(substr(text, 1, 2)), 'DE'))")
def credential_exclusion(spark, d):
    return read(spark, d, "documents").where(~t.starts_with_credential(F.col("text"), ("TH", "DE"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE starts_with(source, 'src1') AND lang = 'en'")
def prefix_filter(spark, d):
    return read(spark, d, "documents").where(F.col("source").startswith("src1") & (F.col("lang") == "en")).select("doc_id")


@query("SELECT doc_id FROM labels WHERE toxic <> 1")
def label_inequality(spark, d):
    return doc_labels(spark, d).where(F.col("label") != "TOXIC").select(F.col("packet_id").alias("doc_id"))


@query("""SELECT item_id, md5(list_aggregate(list_transform(range(0, 8 * strlen(text)), lambda i: CAST(((CAST(concat('0x', substr(h, CAST(2 * (i // 8) + 1 AS INTEGER), 2)) AS INTEGER) >> CAST(i % 8 AS INTEGER)) & 1) AS VARCHAR)), 'string_agg', '')) AS digest
  FROM (SELECT item_id, text, hex(encode(text)) AS h FROM benchmark) WHERE strlen(text) > 0""")
def byte_bits(spark, d):
    m = read(spark, d, "benchmark").where(F.octet_length("text") > 0).select("item_id", t.bit_matrix(F.col("text")).alias("m"))
    bits = F.array_join(F.transform(F.flatten("m"), lambda b: b.cast("int").cast("string")), "")
    return m.select("item_id", F.md5(bits.cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(rpad(hex(encode(text)), CAST(greatest(4096, 2 * strlen(text)) AS INTEGER), '0')) AS digest FROM documents")
def zero_padded(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.hex(t.zero_padded(F.col("text"), 2048)).cast("binary")).alias("digest"))


#: Bytes of a text that its ASCII lower case changes are those from A to Z.
@query("SELECT item_id, CAST(strlen(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_equal, CAST(strlen(text) AS BIGINT) AS n FROM benchmark")
def byte_equality_circuit(spark, d):
    bits = read(spark, d, "benchmark").select("item_id", t.bit_matrix(F.col("text")).alias("a"), t.bit_matrix(t.ascii_lower(F.col("text"))).alias("b"))
    same = F.filter(F.zip_with("a", "b", t.byte_equal), lambda x: x)
    return bits.select("item_id", F.size(same).cast("long").alias("n_equal"), F.size("a").cast("long").alias("n"))


@query("SELECT source, bool_or(n_chars > 20000) AS any_long FROM documents GROUP BY source")
def bool_reduce_or(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.bool_or(F.col("n_chars") > 20000).alias("any_long"))


@query("SELECT source, bool_and(n_chars > 30) AS all_long FROM documents GROUP BY source")
def bool_reduce_and(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.bool_and(F.col("n_chars") > 30).alias("all_long"))


@query("SELECT doc_id, replace(concat(source, '_', lang), '_', '\\_') AS cell, rpad(source, CAST(greatest(8, length(source)) AS INTEGER), ' ') AS name FROM documents")
def table_cells(spark, d):
    return read(spark, d, "documents").select("doc_id", t.escaped_cell(F.concat_ws("_", "source", "lang")).alias("cell"), t.padded(F.col("source"), 8).alias("name"))


# Flows

_KEY = ("user_id", "event_type")
_FLOWS = "(SELECT user_id, event_type, CASE WHEN value > 50 THEN 'HIGH' WHEN value > 20 THEN 'MID' ELSE 'BENIGN' END AS label, event_id FROM events)"
_INDEX = f"(SELECT user_id, event_type, arg_max(label, event_id) AS label FROM {_FLOWS} GROUP BY 1, 2)"


def flow_rows(spark, d):
    label = F.when(F.col("value") > 50, "HIGH").when(F.col("value") > 20, "MID").otherwise("BENIGN")
    return read(spark, d, "events").select(*_KEY, label.alias("label"), F.col("event_id").alias("row_seq"))


def flow_packets(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("user_id") + 1).alias("user_id"), "event_type")


@query(f"SELECT * FROM {_INDEX}")
def flow_index_last_wins(spark, d):
    return flows.index(flow_rows(spark, d), _KEY)


@query(f"SELECT count(*) FILTER (before <> label) AS collisions FROM (SELECT label, lag(label) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM {_FLOWS})")
def flow_collisions(spark, d):
    return flows.collisions(flow_rows(spark, d), _KEY)


@query(f"SELECT e.event_id, e.user_id + 1 AS user_id, e.event_type, i.label FROM events e LEFT JOIN {_INDEX} i ON i.user_id = e.user_id + 1 AND i.event_type = e.event_type")
def flow_lookup_forward(spark, d):
    return flows.lookup(flow_packets(spark, d), flows.index(flow_rows(spark, d), _KEY), _KEY)


@query(f"SELECT count(*) AS lookups, count(i.label) AS hits, count(*) - count(i.label) AS unmatched, round(count(i.label) / count(*), 6) AS hit_rate FROM events e LEFT JOIN {_INDEX} i ON i.user_id = e.user_id + 1 AND i.event_type = e.event_type")
def flow_stats(spark, d):
    s = flows.match_stats(flows.lookup(flow_packets(spark, d), flows.index(flow_rows(spark, d), _KEY), _KEY))
    return s.withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"SELECT label, count(*) AS n FROM {_FLOWS} GROUP BY label")
def label_distribution(spark, d):
    return flows.label_counts(flow_rows(spark, d))


@query(f"SELECT DISTINCT label FROM {_INDEX} WHERE label <> 'BENIGN'")
def distinct_labels(spark, d):
    return flows.distinct_labels(flows.index(flow_rows(spark, d), _KEY), lambda c: c != "BENIGN")


@query(f"SELECT label, count(*) AS n FROM {_INDEX} i JOIN events e ON i.user_id = e.user_id + 1 AND i.event_type = e.event_type WHERE label <> 'BENIGN' GROUP BY label")
def label_dispatch(spark, d):
    found = flows.lookup(flow_packets(spark, d), flows.index(flow_rows(spark, d), _KEY), _KEY)
    return found.where(F.col("label") != "BENIGN").groupBy("label").agg(F.count("*").alias("n"))


# Reservoirs

_VERDICTS = f"""(SELECT source AS category, doc_id AS seq, CASE WHEN p >= 0.85 THEN c END AS line, CASE WHEN p < 0.85 THEN 'not_printable' WHEN length(c) < 200 THEN 'too_short' ELSE 'ok' END AS gate
  FROM (SELECT *, {_PRINTABLE} AS p, {_clean("text")} AS c FROM documents))"""
_FIRST = f"(SELECT category, line, min(seq) AS seq FROM {_VERDICTS} WHERE gate = 'ok' GROUP BY 1, 2)"
_ADMITTED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS k FROM {_FIRST}) WHERE k <= {CAP})"
_OPTIONS = {"min_ratio": 0.85, "min_len": 200}


def _stats_sql(seen: str) -> str:
    return f"""SELECT category, {seen} AS candidates_seen, count(*) FILTER (gate = 'not_printable' AND t) AS rejected_not_printable, count(*) FILTER (gate = 'too_short' AND t) AS rejected_too_short,
      count(*) FILTER (gate = 'ok' AND t) - coalesce(max(a), 0) AS rejected_duplicate, coalesce(max(a), 0) AS accepted, coalesce(max(a), 0) >= {CAP} AS cap_hit
      FROM (SELECT v.*, a, a IS NULL OR a < {CAP} OR seq <= l AS t FROM {_VERDICTS} v LEFT JOIN (SELECT category AS c, count(*) AS a, max(seq) AS l FROM {_ADMITTED} GROUP BY 1) ON c = category) GROUP BY category"""


def offered(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("category"), F.col("doc_id").alias("seq"), F.col("text").alias("payload"))


@query(f"SELECT category, seq, md5(line) AS digest FROM {_FIRST}")
def dedup_first_seen(spark, d):
    v = reservoir.first_seen(reservoir.verdicts(offered(spark, d), **_OPTIONS))
    return v.select("category", "seq", F.md5(F.col("line").cast("binary")).alias("digest"))


@query(f"SELECT source AS category, doc_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= {CAP}")
def cap_per_category(spark, d):
    return reservoir.first_k(offered(spark, d), CAP, ["category"], [F.col("seq")]).select("category", "seq")


@query(f"SELECT category, seq, line FROM {_ADMITTED}")
def reservoir_rows(spark, d):
    return reservoir.admit(offered(spark, d), CAP, **_OPTIONS)


@query(_stats_sql("count(*)"))
def reservoir_stats(spark, d):
    return reservoir.stats(offered(spark, d), CAP, **_OPTIONS)


@query(_stats_sql("count(*) FILTER (t)"))
def reservoir_stats_single(spark, d):
    return reservoir.stats(offered(spark, d), CAP, stop_when_full=True, **_OPTIONS)


@query(f"SELECT seq, line FROM (SELECT line, min(seq) AS seq FROM (SELECT doc_id AS seq, {_clean('text')} AS line FROM documents WHERE strlen(text) >= 4 AND {_PRINTABLE} >= 0.3) WHERE length(line) >= 4 GROUP BY line) ORDER BY seq LIMIT 500")
def unique_line_limit(spark, d):
    return reservoir.unique_lines(offered(spark, d), 500)


@query(f"SELECT doc_id FROM documents WHERE {_clean('text')} <> text")
def verify_idempotent(spark, d):
    return read(spark, d, "documents").where(t.clean_text(F.col("text")) != F.col("text")).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_clean('text')} AS c FROM documents) WHERE {_clean('c')} <> c")
def verify_clean_twice(spark, d):
    once = read(spark, d, "documents").select("doc_id", t.clean_text(F.col("text")).alias("c"))
    return once.where(t.clean_text(F.col("c")) != F.col("c")).select("doc_id")


@query("SELECT category, md5(line) AS digest, n FROM (SELECT source AS category, text AS line, count(*) AS n FROM documents GROUP BY 1, 2) WHERE n > 1")
def verify_duplicates(spark, d):
    lines = offered(spark, d).withColumnRenamed("payload", "line")
    return reservoir.residual_duplicates(lines).select("category", F.md5(F.col("line").cast("binary")).alias("digest"), "n")


@query(f"""WITH m AS (SELECT source AS category, CAST(count(*) + CASE WHEN source = 'src1' THEN 1 ELSE 0 END AS BIGINT) AS accepted, CASE WHEN source = 'src2' THEN 0.3 ELSE 0.9 END AS hit_rate FROM documents GROUP BY source),
  l AS (SELECT source AS category, text AS line FROM documents)
  SELECT category, 'count' AS problem, n FROM (SELECT category, count(*) AS n FROM l GROUP BY 1) JOIN m USING (category) WHERE n <> accepted
  UNION ALL SELECT category, 'hit_rate', 1 FROM m WHERE hit_rate < 0.5
  UNION ALL SELECT category, 'duplicate', CAST(sum(n - 1) AS BIGINT) FROM (SELECT category, count(*) AS n FROM l GROUP BY category, line HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT category, 'not_clean', count(*) FROM l WHERE {_clean("line")} <> line GROUP BY 1
  UNION ALL SELECT category, 'too_short', count(*) FROM l WHERE length(line) < 4 GROUP BY 1""")
def verify_problems(spark, d):
    lines = offered(spark, d).withColumnRenamed("payload", "line")
    more, rate = F.when(F.col("category") == "src1", 1).otherwise(0), F.when(F.col("category") == "src2", 0.3).otherwise(0.9)
    manifests = lines.groupBy("category").agg(F.count("*").alias("n")).select("category", (F.col("n") + more).alias("accepted"), rate.alias("hit_rate"))
    return reservoir.problems(lines, manifests)


# Data sets

_LINES = "(SELECT CASE WHEN lang = 'en' THEN 'BENIGN' ELSE lang END AS category, doc_id AS id, text AS line FROM documents)"


def _sample_sql(category: str, count: int) -> str:
    return f"(SELECT category, id FROM {_LINES} WHERE category = '{category}' ORDER BY md5('{SEED}|' || CAST(id AS VARCHAR)), id LIMIT {count})"


_MALICIOUS = {"fr": DATASET_COUNT, "de": DATASET_COUNT, "es": DATASET_COUNT}
_BUILT = "(" + " UNION ALL ".join(f"SELECT * FROM {_sample_sql(k, n)}" for k, n in {**_MALICIOUS, "BENIGN": 3 * DATASET_COUNT}.items()) + ")"


def dataset_lines(spark, d):
    return read(spark, d, "documents").select(F.when(F.col("lang") == "en", "BENIGN").otherwise(F.col("lang")).alias("category"), F.col("doc_id").alias("id"), F.col("text").alias("line"))


@query(f"SELECT * FROM {_BUILT}")
def sample_balanced(spark, d):
    return dataset.balanced(dataset_lines(spark, d), _MALICIOUS, SEED).select("category", "id")


@query(f"SELECT id, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(id AS VARCHAR)), id) AS place FROM {_BUILT}")
def shuffle_order(spark, d):
    from pyspark.sql import Window

    built = dataset.balanced(dataset_lines(spark, d), _MALICIOUS, SEED)  # a data set of bounded size
    place = F.row_number().over(Window.orderBy(dataset.order_key(SEED, F.col("id")), "id"))
    return built.select("id", place.cast("long").alias("place"))


@query("SELECT lang AS category, doc_id AS id FROM documents WHERE lang IN ('fr', 'de')")
def union_categories(spark, d):
    lines = dataset_lines(spark, d).select("category", "id")
    return dataset.union([lines.where(F.col("category") == c) for c in ("fr", "de")])


@query(f"SELECT category, used, available, used < available AS down_sampled FROM (SELECT category, count(*) AS used FROM {_BUILT} GROUP BY 1) JOIN (SELECT category, count(*) AS available FROM {_LINES} GROUP BY 1) USING (category)")
def build_report(spark, d):
    lines = dataset_lines(spark, d)
    return dataset.build_report(dataset.balanced(lines, _MALICIOUS, SEED), lines)


@query(f"SELECT count(*) FILTER (category <> 'BENIGN') AS malicious, count(*) FILTER (category = 'BENIGN') AS benign, CAST(count(*) FILTER (category <> 'BENIGN') AS DOUBLE) / count(*) FILTER (category = 'BENIGN') AS ratio FROM {_BUILT}")
def class_ratio(spark, d):
    return dataset.class_ratio(dataset.balanced(dataset_lines(spark, d), _MALICIOUS, SEED))


@query(f"SELECT count(*) AS n, count(*) FILTER (category <> 'BENIGN') AS attack, count(*) FILTER (category = 'BENIGN') AS benign, CAST(min(length(line)) AS INTEGER) AS min_len, CAST(max(length(line)) AS INTEGER) AS max_len, round(avg(length(line)), 4) AS avg_len FROM {_LINES}")
def dataset_summary(spark, d):
    return dataset.describe(dataset_lines(spark, d)).withColumn("avg_len", F.round("avg_len", 4))


@query(None)  # what is drawn depends on the engine's hash
def synthetic_payloads(spark, d):
    return dataset.synthetic(spark)


# Reports


@query("SELECT lang, CAST(least(floor(n_chars / (m * CAST(1.05 AS DOUBLE) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM documents, (SELECT CAST(max(n_chars) AS DOUBLE) AS m FROM documents) GROUP BY 1, 2")
def duration_histogram(spark, d):
    return report.whole_histogram(read(spark, d, "documents"), F.col("n_chars"), 40, ("lang",))


@query("SELECT lang, round(quantile_cont(n_chars, 0.25), 4) AS q1, round(quantile_cont(n_chars, 0.5), 4) AS q2, round(quantile_cont(n_chars, 0.75), 4) AS q3 FROM documents GROUP BY lang")
def length_quartiles(spark, d):
    return report.box_stats(read(spark, d, "documents"), F.col("n_chars"), ("lang",)).select("lang", *_rounded("q1", "q2", "q3", n=4))


_PCT = f"(SELECT windows, round(CASE WHEN windows > 0 THEN 100.0 * (1 - CAST(candidates AS DOUBLE) / windows) ELSE 100.0 END, 1) AS pruning_pct FROM ({_candidates('benchmark', 'item_id', TABLE_GROUPS)}))"


@query(f"SELECT CAST(least(floor(pruning_pct / 5.0), 19) AS INTEGER) AS bin, count(*) AS n FROM {_PCT} WHERE windows > 0 GROUP BY 1")
def pruning_histogram(spark, d):
    return report.pruning_profile(packet_csv_rows(spark, d))


@query(f"SELECT round(avg(pruning_pct), 6) AS mean_pruning_pct FROM {_PCT} WHERE windows > 0")
def pruning_mean(spark, d):
    return report.pruning_mean(packet_csv_rows(spark, d)).select(*_rounded("mean_pruning_pct"))


@query(None)  # as inspect_candidates_documents
def pruning_histogram_documents(spark, d):
    return report.pruning_profile(packet_csv_rows_documents(spark, d))


@query(None)  # as inspect_candidates_documents
def pruning_mean_documents(spark, d):
    return report.pruning_mean(packet_csv_rows_documents(spark, d)).select(*_rounded("mean_pruning_pct"))


@query(f"SELECT outcome, n, round(100.0 * n / total, 6) AS share_pct FROM (SELECT total, unnest(['TP', 'TN', 'FP', 'FN']) AS outcome, unnest([tp, tn, fp, fn]) AS n FROM ({_CONFUSION}))")
def outcome_shares(spark, d):
    return report.outcome_shares(evaluate.confusion(labelled_documents(spark, d))).withColumn("share_pct", F.round("share_pct", 6))


@query(f"SELECT r AS run, round(100 * accuracy, 4) AS accuracy_pct, round(100 * precision, 4) AS precision_pct, round(100 * recall, 4) AS recall_pct, round(100 * f1, 4) AS f1_pct, fp, fn FROM ({_METRICS}), (SELECT unnest(['first', 'second']) AS r)")
def run_progression(spark, d):
    labelled = labelled_documents(spark, d)
    table = report.run_table([evaluate.summary(labelled, "first"), evaluate.summary(labelled, "second")])
    return table.select("run", *_rounded("accuracy_pct", "precision_pct", "recall_pct", "f1_pct", n=4), "fp", "fn")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


from tidewheel.plans import file_queries  # noqa: E402, F401  its queries join those above
