"""Reports of ordered findings: text, JSON, SARIF, baselines and exit status.

Small reports are strings. `write` leaves a report of any size in a folder: executors write its parts, a finding per line, in the order
of the parts' names; the driver holds none of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot import __version__

TOOL = "taproot"


def as_text(rows: Iterable, degraded: Iterable = ()) -> str:
    lines = [f"{r.path}:{r.line}:{r.column}: {r.severity}: [{r.rule}] {r.message}" + (f" — {r.note}" if r.note else "") for r in rows]
    return "\n".join([*lines, *(f"{r.path}:1:1: warning: [{TOOL}] file skipped: {r.degraded}" for r in degraded)])


def as_json(rows: Iterable) -> str:
    names = ("rule", "severity", "path", "line", "column", "message", "note", "fingerprint")
    return json.dumps({"findings": [{n: r[n] for n in names if r[n] is not None} for r in rows]}, indent=2, sort_keys=True)


def as_sarif(rows: Iterable, rules: Iterable[str]) -> str:
    results = [
        {
            "ruleId": r.rule, "level": r.severity, "message": {"text": r.message + (f" — {r.note}" if r.note else "")}, "partialFingerprints": {f"{TOOL}/v1": r.fingerprint},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.path}, "region": {"startLine": r.line, "startColumn": r.column}}}],
        }
        for r in rows
    ]
    driver = {"name": TOOL, "version": __version__, "rules": [{"id": r} for r in rules]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, sort_keys=True)


def baseline(rows: Iterable) -> str:
    return json.dumps({"version": 1, "tool": TOOL, "fingerprints": sorted({r.fingerprint for r in rows})}, indent=2)


def read_baseline(content: str) -> set[str]:
    data = json.loads(content)
    if data.get("version") != 1:
        raise ValueError("a baseline of another version")
    return set(data["fingerprints"])


def relative(path: str, root: str) -> str:
    root = root.rstrip("/") + "/"
    return path[len(root) :] if path.startswith(root) else path


def exit_status(rows: Iterable, strict: bool = False) -> int:
    return int(any(strict or r.severity == "error" for r in rows))


ORDER = ("path", "line", "column", "rule", "message")
NAMES = ("rule", "severity", "path", "line", "column", "message", "note", "fingerprint")


def text_line() -> Column:
    c = F.col
    note = F.when(F.coalesce(c("note"), F.lit("")) != "", F.concat(F.lit(" — "), c("note"))).otherwise("")
    return F.concat(c("path"), F.lit(":"), c("line"), F.lit(":"), c("column"), F.lit(": "), c("severity"), F.lit(": ["), c("rule"), F.lit("] "), c("message"), note)


def json_line() -> Column:
    return F.to_json(F.struct(*NAMES))


def sarif_line() -> Column:
    """A result; the rules and the tool go around all of them."""
    c = F.col
    note = F.when(F.coalesce(c("note"), F.lit("")) != "", F.concat(F.lit(" — "), c("note"))).otherwise("")
    region = F.struct(c("line").alias("startLine"), c("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(c("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    message = F.struct(F.concat(c("message"), note).alias("text")).alias("message")
    prints = F.create_map(F.lit(f"{TOOL}/v1"), c("fingerprint")).alias("partialFingerprints")
    return F.to_json(F.struct(c("rule").alias("ruleId"), c("severity").alias("level"), message, prints, F.array(place).alias("locations")))


LINES = {"xcode": text_line, "json": json_line, "sarif": sarif_line}


def write(findings: DataFrame, folder: str, form: str) -> DataFrame:
    """Writes ordered findings to ``folder``/parts and (part, rows) to ``folder``/manifest, which comes back.

    A range partition by the order of a report gives each part its own stretch of it. Equal findings stay side by side.
    """
    ordered = findings.orderBy(*ORDER, "fingerprint")
    ordered.select(LINES[form]().alias("value")).write.option("lineSep", "\n").text(f"{folder}/parts")
    spark = findings.sparkSession
    part = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part")
    counted = spark.read.text(f"{folder}/parts").groupBy(part).agg(F.count("*").alias("rows"))
    counted.orderBy("part").write.json(f"{folder}/manifest")
    return spark.read.schema("part string, rows long").json(f"{folder}/manifest")


def write_baseline(findings: DataFrame, folder: str) -> None:
    """Distinct fingerprints in order, one per line, in parts."""
    findings.select("fingerprint").distinct().orderBy("fingerprint").write.text(folder)
