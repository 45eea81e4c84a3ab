"""Source files: discovery, bounded reading, and facts as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions.text import glob_regex

MOST_BYTES = 10 << 20
SKIPPED = frozenset({"DerivedData", "checkouts"})

DECLARATION = "struct<name: string, kind: string, line: int, column: int, first_line: int, last_line: int, access: string, modifiers: array<string>, attributes: array<string>, conformances: array<string>, scope: string, enclosing: array<int>, enclosing_type: string, enclosing_kind: string, local: boolean, ordinal: int>"
REFERENCE = "struct<identifier: string, qualifier: string, line: int, column: int, context: string>"
#: ``modified`` is in seconds; sources in memory have none.
SOURCES = "path string, source string, error string, modified double"
FLOW = "struct<fn: int, function: string, what: string, line: int, block: long, dst: long, side: string, target: string, op: string, left_var: string, left: string, right_var: string, right: string, loop: boolean>"
FACTS = f"path string, declarations array<{DECLARATION}>, references array<{REFERENCE}>, tokens array<string>, comments array<struct<line: int, text: string>>, flow array<{FLOW}>, degraded string"


def _excluded(path: str, entries: Iterable[str]) -> bool:
    import re

    return any(re.match(glob_regex(e), path) if set(e) & set("*?") else e in path for e in entries if e)


def discover(paths: Iterable[str], exclude: Iterable[str] = (), suffix: str = ".swift") -> list[str]:
    """Given files always, and the files of a suffix in given folders; dot entries and build folders are skipped."""
    found: dict[str, None] = {}
    for p in paths:
        if os.path.isfile(p):
            found[os.path.normpath(os.path.abspath(p))] = None
        elif not os.path.isdir(p):
            raise FileNotFoundError(p)
        for top, folders, names in os.walk(p):
            folders[:] = sorted(f for f in folders if f[0] != "." and f not in SKIPPED)
            for n in names:
                full = os.path.normpath(os.path.abspath(os.path.join(top, n)))
                if n[0] != "." and n.endswith(suffix) and not _excluded(full, exclude):
                    found[full] = None
    return sorted(found)


def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for p in f["path"]:
            try:
                if os.path.getsize(p) > MOST_BYTES:
                    raise OSError(f"larger than {MOST_BYTES} bytes")
                with open(p, "rb") as h:
                    source = h.read(MOST_BYTES + 1)
                if len(source) > MOST_BYTES:  # it has grown meanwhile
                    raise OSError(f"larger than {MOST_BYTES} bytes")
                rows.append((p, source.decode("utf-8", "replace"), None, os.path.getmtime(p)))
            except OSError as e:
                rows.append((p, None, str(e), None))
        yield pd.DataFrame(rows, columns=["path", "source", "error", "modified"]).astype({"modified": "float64"})


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, source, error, modified) of whole files; a file over the limit or that can't be read is a row with an error."""
    given = spark.createDataFrame([(p,) for p in paths], "path string")
    return given.repartition(max(1, min(len(paths), 256))).mapInPandas(load, SOURCES)


def in_memory(spark: SparkSession, sources: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(p, s, None, None) for p, s in dict(sources).items()], SOURCES)


def facts(sources: DataFrame) -> DataFrame:
    """One nested row of facts per file. The source text goes no further than this stage."""

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from taproot.frontend.facts import collect as of

        for f in frames:
            rows = []
            for path, source, error in zip(f["path"], f["source"], f["error"], strict=True):
                if source is None:
                    rows.append((path, [], [], [], [], [], error or "unreadable"))
                    continue
                x = of(path, source)
                rows.append((path, x.declarations, x.references, sorted(x.tokens), [{"line": n, "text": t} for n, t in x.comments], x.flow, x.degraded))
            yield pd.DataFrame(rows, columns=["path", "declarations", "references", "tokens", "comments", "flow", "degraded"])

    return sources.select("path", "source", "error").mapInPandas(collect, FACTS)


def declarations(facts_: DataFrame) -> DataFrame:
    """A row per declaration with its id, ``path#ordinal``."""
    own = facts_.select("path", F.explode("declarations").alias("d")).select("path", "d.*")
    return own.withColumn("decl", F.concat_ws("#", "path", F.col("ordinal").cast("string")))


def references(facts_: DataFrame) -> DataFrame:
    return facts_.select("path", F.explode("references").alias("r")).select("path", "r.*")


def string_tokens(facts_: DataFrame) -> DataFrame:
    return facts_.select(F.explode("tokens").alias("token")).distinct()
