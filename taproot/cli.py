"""python -m taproot.cli analyze PATH... | rules [ID]

Exit status: 0, or 1 if a finding is an error (with --strict, if there is any), 64 for wrong usage, 78 for a bad
configuration.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from taproot.operators import policy
from taproot.operators.relations import split_by
from taproot.plans.analysis import RULES, Configuration, analyze
from taproot.sources import files, settings, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="taproot", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("--format", choices=("xcode", "json", "sarif"), default="xcode")
    a.add_argument("--config")
    a.add_argument("--strict", action="store_true")
    a.add_argument("--production", action="store_true", default=None)
    a.add_argument("--only", action="append")
    a.add_argument("--only-from")
    a.add_argument("--baseline")
    a.add_argument("--write-baseline")
    a.add_argument("--index", help="a folder with an index as tables")
    a.add_argument("--cache", help="a folder for snapshots of facts")
    a.add_argument("--relative-to", help="spell paths relative to this folder")
    a.add_argument("--output", help="a new folder for a report in parts, of any size, instead of one on standard output")
    a.add_argument("--similarity", choices=("off", "exact", "index"), default="off", help="note how unlike the nearest other findings each is")
    r = sub.add_parser("rules")
    r.add_argument("id", nargs="?")
    return p


def run(argv: list[str], spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 64 if e.code else 0
    if args.command == "rules":
        if args.id and args.id not in RULES:
            return 64
        print(settings.describe([args.id] if args.id else RULES), file=out)
        return 0
    try:
        config, exclude = settings.load(args.config, args.production) if args.config else (Configuration(production=bool(args.production)), [])
        known = sinks.read_baseline(open(args.baseline, encoding="utf-8").read()) if args.baseline else set()
    except (ValueError, OSError, KeyError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 78
    scope = list(args.only) if args.only is not None else None
    if args.only_from:
        scope = (scope or []) + settings.scope_list(sys.stdin.read() if args.only_from == "-" else open(args.only_from, encoding="utf-8").read())
    if scope is not None and args.write_baseline:
        print("a baseline needs the whole report, not a scope", file=sys.stderr)
        return 64
    try:
        paths = files.discover(args.paths, exclude)
    except FileNotFoundError as e:
        print(f"no such path: {e}", file=sys.stderr)
        return 64
    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    sources = files.read(spark, paths)
    below = os.path.commonpath([os.path.dirname(p) for p in paths]) if paths else os.getcwd()
    root = os.path.abspath(args.relative_to) if args.relative_to else settings.repository_root(below)
    report = analyze(spark, sources, replace(config, similarity=args.similarity), index=args.index, cache_at=args.cache, anchor=root)
    found = report.findings
    if scope is not None:  # an empty scope reports nothing; none at all reports everything
        keys = spark.createDataFrame([(os.path.normpath(os.path.abspath(s)),) for s in scope], "path string")
        found, _ = split_by(found, keys, ["path"])
    report.findings = found
    if args.relative_to:
        report = report.relative_to(root)
    if args.write_baseline:
        with open(args.write_baseline, "w", encoding="utf-8") as f:
            f.write(sinks.baseline(report.findings.select("fingerprint").distinct().collect()))
    if known:
        report.findings = report.findings.join(spark.createDataFrame([(f,) for f in known], "fingerprint string"), "fingerprint", "left_anti")
    n_degraded = report.degraded.count()
    if args.output:
        sinks.write(report.findings, args.output, args.format)
    else:
        rows, degraded = report.ordered(), report.degraded.orderBy("path").collect()
        print({"xcode": lambda: sinks.as_text(rows, degraded), "json": lambda: sinks.as_json(rows), "sarif": lambda: sinks.as_sarif(rows, RULES)}[args.format](), file=out)
    for note in report.notes:
        print(f"note: {note}", file=sys.stderr)
    s = policy.summary(report.findings, F.col("severity"), F.col("path")).first()
    parts = [f"{s.errors} errors", f"{s.warnings} warnings", f"{s.files} of {len(paths)} files", f"{report.suppressed.count()} suppressed", f"{n_degraded} degraded"]
    parts += [f"{n} {word} in the cache" for word, n in report.cached.items()]
    print(", ".join(parts), file=sys.stderr)
    return int(s.max_severity > (0 if args.strict else 1))


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
