"""Writing results: per-packet and summary files, LaTeX rows, console reports, reservoirs, data sets."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.dataset import shuffled
from tidewheel.operators.evaluate import packet_rows
from tidewheel.sources.tables import SUMMARY_SCHEMA

# Decimals of the summary file's columns, and the frame of the table of runs.
_DECIMALS = {**dict.fromkeys(("accuracy", "precision", "recall", "f1", "fpr", "fnr", "mcc", "pruning_rate"), 4), "wall_time_s": 1, "avg_time_ms": 1}
TABLE_HEAD = ["\\begin{table}[htbp]", "\\centering", "\\caption{Evaluation results}", "\\label{tab:results}", "\\begin{tabular}{lrrrrrrrr}", "\\toprule", "Run & TP & TN & FP & FN & Acc (\\%) & Prec (\\%) & Rec (\\%) & F1 (\\%) \\\\", "\\midrule"]
TABLE_FOOT = ["\\bottomrule", "\\end{tabular}", "\\end{table}"]


def _fixed(c, n: int):
    return F.format_string(f"%.{n}f", c.cast("double"))


def write_packets(labelled: DataFrame, path: str) -> None:
    """The per-packet rows as CSV with a header, in the order of packet_id."""
    rows = packet_rows(labelled).withColumns({"pruning_pct": _fixed(F.col("pruning_pct"), 1), "duration_ms": _fixed(F.coalesce("duration_ms", F.lit(0.0)), 3)})
    rows.orderBy("packet_id").write.mode("overwrite").option("header", True).csv(path)


def summary_columns(summary: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in SUMMARY_SCHEMA.split(", ")]
    return summary.select(*[_fixed(F.coalesce(c, F.lit(0.0)), _DECIMALS[c]).alias(c) if c in _DECIMALS else F.col(c) for c in names])


def write_summary(summary: DataFrame, path: str) -> None:
    """The one summary row as CSV with a header."""
    summary_columns(summary).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latex_row(row: dict) -> str:
    percent = " & ".join(f"{100 * row[m]:.2f}" for m in ("accuracy", "precision", "recall", "f1"))
    return f"{row['run'].replace('_', chr(92) + '_')} & {row['tp']} & {row['tn']} & {row['fp']} & {row['fn']} & {percent} \\\\"


def latex_table(rows: list[dict]) -> str:
    """A whole table: its frame stands once, however many runs it has."""
    return "\n".join([*TABLE_HEAD, *map(latex_row, rows), *TABLE_FOOT, ""])


def append_latex(path: str, row: dict) -> None:
    """Add a run to a table on the driver; a new file begins with the table's head."""
    fresh = not os.path.exists(path)
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n".join([*(TABLE_HEAD if fresh else []), latex_row(row), ""]))


def finish_latex(path: str) -> None:
    """End a table once; an ended one stays as it is."""
    with open(path, "r+", encoding="utf-8") as f:
        if TABLE_FOOT[-1] not in f.read():
            f.write("\n".join([*TABLE_FOOT, ""]))


def console_report(row: dict) -> str:
    """The report of a run, by sections."""
    percent = lambda k: f"{100 * row[k]:6.2f}%"
    sections = {
        "Dataset": {"Total packets": row["total"], "Skipped packets": row["skipped"]},
        "Confusion matrix": {"True positives": row["tp"], "True negatives": row["tn"], "False positives": row["fp"], "False negatives": row["fn"]},
        "Classification metrics": {**{k: percent(v) for k, v in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1 score", "f1"), ("FPR", "fpr"), ("FNR", "fnr"))}, "MCC": f"{row['mcc']:6.3f}"},
        "Performance": {"Wall time": f"{row['wall_time_s'] or 0.0:.1f}s", **{f"{k} packet time": f"{row[v]:.1f}ms" for k, v in (("Avg", "avg_time_ms"), ("Min", "min_time_ms"), ("Max", "max_time_ms"))}},
        "Bloom filter": {"Total windows": row["total_windows"], "Candidates": row["total_candidates"], "Pruning rate": percent("pruning_rate")},
    }
    out = [f"Evaluation report: {row['run']}"]
    for title, lines in sections.items():
        out += [title, *(f"  {k:<16}: {v:>8}" for k, v in lines.items())]
    return "\n".join(out)


def write_reservoirs(admitted: DataFrame, path: str) -> None:
    """Lines by category (and sublabel), in the order of seq within each file; a category may have several.  Others' files in path stay."""
    by = [c for c in ("category", "sublabel") if c in admitted.columns]
    admitted.repartitionByRange(*by, "seq").sortWithinPartitions(*by, "seq").select(*by, "line").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).option("lineSep", "\n").text(path)


def write_file(spark, path: str, text: str) -> None:
    """One small file, through the file system that Spark would write the path to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove_table(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def extraction_summary(title: str, rows: list[dict]) -> str:
    """A line for each reservoir, as a run of an extraction shows it."""
    out = [f"=== {title} ==="]
    for r in rows:
        counts = " ".join(f"{name}={r[k]:<7}" for name, k in (("accepted", "accepted"), ("candidates", "candidates_seen"), ("rejected_printable", "rejected_not_printable"), ("rejected_short", "rejected_too_short"), ("rejected_dup", "rejected_duplicate")))
        out.append(f"  {r.get('sublabel') or r['category']:<24} {counts} [{'CAP HIT' if r['cap_hit'] else 'exhausted source'}] {r['elapsed_seconds']}s")
    return "\n".join(out)


def manifest(stats: dict, **extra) -> str:
    """A reservoir's counters and settings as JSON with sorted keys."""
    return json.dumps({**stats, **extra}, indent=2, sort_keys=True)


def write_captures(packets: DataFrame, path: str) -> None:
    """TCP packets (src_ip, src_port, dst_ip, dst_port, payload) as captures under path, one file a task."""
    import pyarrow as pa
    from pyspark import TaskContext

    from tidewheel.sources.pcap import capture_header, capture_record, file_system

    def write(batches):
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        # a task that runs again writes the same file again
        n, name = 0, f"{base}/{TaskContext.get().partitionId():05d}.pcap"
        with system.open_output_stream(name) as f:
            f.write(capture_header())
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.write(capture_record(*row))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    packets.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_dataset(built: DataFrame, path: str, seed: int | None = None, text: str = "line", label: str = "category") -> None:
    """path/payloads and path/labels, aligned line by line: both are written from one sorted table."""
    rows = built if seed is None else shuffled(built, seed)
    table = f"{path}/rows"
    rows.select(F.col(text).alias("payload"), F.col(label).alias("label")).write.mode("overwrite").parquet(table)
    # one task keeps both files in the table's order; data sets are capped per class
    again = rows.sparkSession.read.parquet(table).coalesce(1)
    again.select("payload").write.mode("overwrite").option("lineSep", "\n").text(f"{path}/payloads")
    again.select("label").write.mode("overwrite").option("lineSep", "\n").text(f"{path}/labels")
