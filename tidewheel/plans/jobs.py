"""Whole jobs: inspection with evaluation, extraction of reservoirs by category, building data sets."""

from __future__ import annotations

import dataclasses
import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import text as t
from tidewheel.operators import dataset, evaluate, flows, reservoir
from tidewheel.operators.inspect import GROUPS, RuleGroup, inspect
from tidewheel.sources import pcap, sinks, tables
from tidewheel.sources import text as files

log = logging.getLogger(__name__)


def run_inspection(spark: SparkSession, payloads: str, labels: str, run: str = "run", groups: Sequence[RuleGroup] = GROUPS, out: str | None = None) -> dict:
    """Inspect a payload file, score it against a label file, write both result files; the summary row."""
    began = time.monotonic()
    labelled = evaluate.with_labels(inspect(files.payloads(spark, payloads), groups, candidates=True), files.labels(spark, labels))
    row = evaluate.summary(labelled, run).first().asDict()
    row["wall_time_s"] = time.monotonic() - began
    if out:
        sinks.write_packets(labelled, f"{out}/{run}_packets")
        sinks.write_summary(spark.createDataFrame([row], tables.SUMMARY_SCHEMA), f"{out}/{run}_summary")
    return row


@dataclasses.dataclass(frozen=True)
class Category:
    """What a reservoir holds.  keep: rows that are offered, by packet columns and, if labelled, label."""

    name: str
    keep: Callable[[], Column]
    labelled: bool = False
    sublabel: Callable[[Column], Column] | None = None
    description: str = ""
    legacy: bool = False


ATTACKER, FTP, HTTP, INTERNAL = "192.168.10.51", 21, 80, "192.168."
# The six extractors, then the three older modes.
CATEGORIES = {
    c.name: c
    for c in (
        Category("FTP-Patator", lambda: (F.col("src_ip") == ATTACKER) & (F.col("dst_port") == FTP), description=f"src IP == {ATTACKER} and dst port == {FTP}"),
        Category("BENIGN", lambda: (F.col("dst_port") == HTTP) & F.col("src_ip").startswith(INTERNAL), description=f"dst port == {HTTP} and src IP starts with {INTERNAL}"),
        Category("SSH-Patator", lambda: F.col("label") == "SSH-Patator", True, description='label == "SSH-Patator"'),
        Category("Infiltration", lambda: F.col("label") == "Infiltration", True, description='label == "Infiltration"'),
        Category("DoS", lambda: F.col("label") != evaluate.BENIGN, True, t.slugify, 'label != "BENIGN"'),
        Category("Web-Attack", lambda: F.col("label").startswith("Web Attack"), True, t.subtype_slug, 'label starts with "Web Attack"'),
        Category("attack", lambda: (F.col("src_ip") == ATTACKER) & (F.col("dst_port") == FTP), legacy=True),
        Category("benign-ftp", lambda: (F.col("dst_port") == FTP) & (F.col("src_ip") != ATTACKER) & ~t.starts_with_credential(F.decode("payload", "ISO-8859-1")), legacy=True),
        Category("benign-http", lambda: (F.col("dst_port") == HTTP) & F.col("src_ip").startswith(INTERNAL), legacy=True),
    )
}


def offered(packets: DataFrame, category: Category, index: DataFrame | None = None) -> DataFrame:
    """category (with its sublabel), seq, payload of what is offered.  packets: seq or (file, seq), addresses, ports, payload."""
    if category.labelled:
        if index is None:
            raise ValueError(f"{category.name} needs labelled flows")
        packets = flows.lookup_checked(packets, index)
    kept = packets.where(category.keep())
    name = F.lit(category.name)
    if category.sublabel:
        name = t.reservoir_name(name, category.sublabel(F.col("label")))
    place = F.struct("file", "seq") if "file" in packets.columns else F.col("seq")
    return kept.select(name.alias("category"), place.alias("seq"), "payload")


def extract(packets: DataFrame, category: Category, index: DataFrame | None = None, cap: int = reservoir.CAP, min_printable_ratio: float = t.MIN_PRINTABLE_RATIO, min_len: int = t.MIN_LEN) -> tuple[DataFrame, DataFrame]:
    """Admitted lines, and counters, of the reservoirs of a category.

    Categories with one reservoir stop offering when it is full; the others go on until all are.
    """
    rows = offered(packets, category, index)
    options = {"min_ratio": min_printable_ratio, "min_len": min_len}
    return reservoir.admit(rows, cap, **options), reservoir.stats(rows, cap, stop_when_full=category.sublabel is None, **options)


#: The counters of a reservoir to which nothing was offered.
_NOTHING = {"candidates_seen": 0, "rejected_not_printable": 0, "rejected_too_short": 0, "rejected_duplicate": 0, "accepted": 0, "cap_hit": False}


def _scanned(packets: DataFrame, category: Category, index: DataFrame | None, min_printable_ratio: float, min_len: int) -> DataFrame:
    """seq, label, category, line, gate of every packet; the last three are null where nothing is offered."""
    if category.labelled:
        if index is None:
            raise ValueError(f"{category.name} needs labelled flows")
        packets = flows.lookup_checked(packets, index)
    else:
        packets = packets.withColumn("label", F.lit(None).cast("string"))
    name = t.reservoir_name(F.lit(category.name), category.sublabel(F.col("label"))) if category.sublabel else F.lit(category.name)
    keep = F.coalesce(category.keep(), F.lit(False))
    rows = packets.select(F.struct("file", "seq").alias("seq"), "label", F.when(keep, name).alias("category"), F.when(keep, F.col("payload")).alias("payload"))
    judged = reservoir.verdicts(rows.withColumn("seq", F.struct("seq", "label")), min_printable_ratio, min_len)
    return judged.select("seq.seq", "seq.label", "category", F.when(F.col("category").isNotNull(), F.col("line")).alias("line"), F.when(F.col("category").isNotNull(), F.col("gate")).alias("gate"))


def _reservoirs(category: Category, index: DataFrame | None) -> dict[str, dict]:
    """The category's reservoirs by name, with sublabel and raw label: one, or one for each label that is kept (a handful)."""
    if not category.sublabel:
        return {category.name: {"sublabel": None}}
    labels = index.select("label").distinct().where(category.keep()).select("label", category.sublabel(F.col("label")).alias("slug")).orderBy("label").collect()
    return {f"{category.name}_{r['slug']}".replace(" ", "_"): {"sublabel": r["slug"], "raw_label": r["label"]} for r in reversed(labels)}


def extract_files(
    spark: SparkSession, captures: str, category: str, flow_csv: str | None = None, out: str | None = None, limit: int = 500, cap: int = reservoir.CAP, min_printable_ratio: float = t.MIN_PRINTABLE_RATIO, min_len: int = t.MIN_LEN, stop_at_cap: bool = True
) -> DataFrame:
    """Reservoirs from capture files; the counters of each.  Older modes give unique lines up to limit.

    The captures are read once, into a table beside out that goes afterwards.  Other categories' reservoirs in out stay.  With out, each reservoir's lines lie in
    out/category=..., its counters and settings in out/reservoir_....manifest.json, which verify_files reads.
    stop_at_cap: packets after the one that fills the last reservoir count as not scanned.
    """
    began, c, packets = time.monotonic(), CATEGORIES[category], pcap.read(spark, captures)
    if c.legacy:
        return reservoir.unique_lines(offered(packets, c), limit)
    rows = tables.flow_labels(spark, flow_csv) if flow_csv else None
    index = flows.index(rows) if flow_csv else None
    scanned = _scanned(packets, c, index, min_printable_ratio, min_len)
    if out:
        staged = f"{out.rstrip('/')}-{c.name}-scanned"
        scanned.write.mode("overwrite").parquet(staged)
        scanned = spark.read.parquet(staged)
    held = reservoir.admitted(scanned.where("category is not null"), cap)
    names = _reservoirs(c, index)
    if out:
        for name in names:
            sinks.remove_table(spark, f"{out}/category={name}")
        sinks.write_reservoirs(held, out)
    ends = {r["category"]: r for r in held.groupBy("category").agg(F.count("*").alias("n"), F.max("seq").alias("last")).collect()}  # a row for each reservoir
    full = stop_at_cap and bool(names) and all(n in ends and ends[n]["n"] >= cap for n in names)
    within = scanned
    if full:
        file, seq = max(tuple(r["last"]) for r in ends.values())
        within = scanned.where((F.col("seq.file") < file) | ((F.col("seq.file") == file) & (F.col("seq.seq") <= seq)))
    run = within.agg(F.count("*").alias("n"), F.count("label").alias("hits")).first()
    stopped = full and scanned.count() > run["n"]
    found = {r["category"]: r.asDict() for r in reservoir.counters(within.where("category is not null"), cap).collect()}
    extra = {"min_printable_ratio": min_printable_ratio, "min_len": min_len, "cap": cap, "source_pcap": captures, "source_csv": flow_csv, "filter_description": c.description, "stopped_early": stopped, "elapsed_seconds": round(time.monotonic() - began, 2)}
    total = run["n"] + stopped
    if c.labelled:
        lookups = {"lookups": run["n"], "hits": run["hits"], "unmatched": run["n"] - run["hits"], "hit_rate": run["hits"] / run["n"] if run["n"] else 0.0}
        extra["flow_index_stats"] = {**lookups, "collisions": flows.collisions(rows).first()[0]}
    out_rows = []
    for name, of in sorted(names.items()):
        counts = {**_NOTHING, **found.get(name, {}), "packets_scanned": 0 if c.sublabel else total, **({"run_packets_scanned": total} if c.sublabel else {})}
        out_rows.append({**counts, **extra, **of, "category": c.name, "payload_file": f"{out}/category={name}" if out else None})
        if out:
            sinks.write_file(spark, f"{out}/reservoir_{name}.manifest.json", sinks.manifest(out_rows[-1]))
    if out:
        sinks.remove_table(spark, staged)
    log.info("%s", sinks.extraction_summary(c.name, out_rows))
    columns = "category string, sublabel string, candidates_seen long, rejected_not_printable long, rejected_too_short long, rejected_duplicate long, accepted long, cap_hit boolean, packets_scanned long, stopped_early boolean, run_packets_scanned long, elapsed_seconds double"
    each = [(n, of["sublabel"], *(r[k] for k in _NOTHING), r["packets_scanned"], stopped, total, r["elapsed_seconds"]) for (n, of), r in zip(sorted(names.items()), out_rows, strict=True)]
    return spark.createDataFrame(each, columns)


def build_dataset(spark: SparkSession, reservoirs: dict[str, str], counts: dict[str, int], out: str, seed: int = dataset.SEED) -> DataFrame:
    """Balanced payload and label files from reservoir files by class; the build report."""
    lines = dataset.union([files.nonempty_lines(spark, path).select(F.lit(name).alias("category"), F.concat_ws(":", F.lit(name), "id").alias("id"), "line") for name, path in reservoirs.items()])
    built = dataset.balanced(lines, counts, seed)
    sinks.write_dataset(built, out)
    return dataset.build_report(built, lines)


def verify_files(spark: SparkSession, path: str) -> DataFrame:
    """Problems of reservoirs under path/category=... by their manifests in path/*.manifest.json."""
    lines = spark.read.option("lineSep", "\n").option("basePath", path).text(f"{path}/category=*").select("category", F.col("value").alias("line"))
    manifests = tables.manifests(spark, f"{path}/*.manifest.json")
    return reservoir.problems(lines, manifests.drop("category").withColumnRenamed("reservoir", "category"))
