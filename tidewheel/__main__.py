"""The jobs from a command line: python -m tidewheel extract|verify|inspect|build ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from tidewheel.operators import dataset, reservoir
from tidewheel.plans import jobs
from tidewheel.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewheel", description="Extraction of reservoirs, their verification, inspection and data sets")
    p.add_argument("--quiet", action="store_true", help="print nothing but errors")
    sub = p.add_subparsers(dest="job", required=True)
    e = sub.add_parser("extract", help="reservoirs of a category from captures")
    e.add_argument("category", choices=sorted(jobs.CATEGORIES))
    e.add_argument("--pcap", required=True, help="a capture, a folder of them, or a pattern")
    e.add_argument("--csv", help="labelled flows, for the categories that need them")
    e.add_argument("--out-dir", default="reservoirs")
    e.add_argument("--cap", type=int, default=reservoir.CAP, help="lines a reservoir")
    e.add_argument("--limit", type=int, default=500, help="lines of the older modes")
    e.add_argument("--min-printable-ratio", type=float, default=0.30)
    e.add_argument("--min-len", type=int, default=4, help="characters of a cleaned line")
    e.add_argument("--no-stop-at-cap", action="store_true", help="count all packets, though all reservoirs are full")
    v = sub.add_parser("verify", help="problems of reservoirs; the status is 1 if there are any")
    v.add_argument("out_dir")
    i = sub.add_parser("inspect", help="inspect payloads and score them against labels")
    i.add_argument("payloads")
    i.add_argument("labels")
    i.add_argument("--run", default="run")
    i.add_argument("--out-dir")
    b = sub.add_parser("build", help="a balanced data set")
    b.add_argument("out_dir")
    b.add_argument("--reservoir", action="append", required=True, metavar="CLASS=PATH")
    b.add_argument("--count", action="append", required=True, metavar="CLASS=N")
    b.add_argument("--seed", type=int, default=dataset.SEED)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if a.quiet else logging.INFO, format="%(message)s")
    spark = spark or SparkSession.builder.appName(f"tidewheel {a.job}").getOrCreate()
    say = (lambda *_: None) if a.quiet else print
    if a.job == "extract":
        stats = jobs.extract_files(spark, a.pcap, a.category, a.csv, a.out_dir, a.limit, a.cap, a.min_printable_ratio, a.min_len, not a.no_stop_at_cap)
        if jobs.CATEGORIES[a.category].legacy:
            stats.orderBy("seq").select("line").write.mode("overwrite").option("lineSep", "\n").text(f"{a.out_dir}/{a.category}")
    elif a.job == "verify":
        found = jobs.verify_files(spark, a.out_dir).orderBy("category", "problem").take(100)
        for r in found:
            say(f"{r['category']}: {r['problem']} ({r['n']})")
        return int(bool(found))
    elif a.job == "inspect":
        say(sinks.console_report(jobs.run_inspection(spark, a.payloads, a.labels, a.run, out=a.out_dir)))
    else:
        pairs = lambda rows: dict(x.rsplit("=", 1) for x in rows)
        report = jobs.build_dataset(spark, pairs(a.reservoir), {k: int(n) for k, n in pairs(a.count).items()}, a.out_dir, a.seed)
        for r in report.orderBy("category").collect():
            say(f"{r['category']}: {r['used']} of {r['available']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
