"""Snapshots of facts by file, so that only changed files are parsed again.

A snapshot is a folder of its own below the cache, numbered upwards; Spark's success marker, written last, makes it count. A run
that dies before that leaves the last snapshot as it was, readers of an old one aren't disturbed, and no file is renamed. The two
latest whole snapshots stay.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot import __version__
from taproot.functions.hashing import content_fingerprint
from taproot.operators import relations
from taproot.sources.files import facts
from taproot.storage import stored

_NAME = re.compile(r"v(\d{12})-[0-9a-f]{32}")
KEPT = 2


def _folder(spark: SparkSession, path: str):
    """(file system, path) by Hadoop, so any store will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Whole snapshots, the latest first. As many names as there are runs between two clean-ups."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [n for n in names if _NAME.fullmatch(n) and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(whole, reverse=True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest snapshot of this version and form; anything else is no snapshot. Files that can't be read are left out."""
    for name in snapshots(spark, path)[:1]:
        try:
            held = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{path}/{name}")
        except Exception:  # no readable file: all is a miss
            return None
        if {"path", "version", "fingerprint", "facts"} <= set(held.columns) and held.schema["facts"].dataType == _form(spark):
            return held.where(F.col("version") == __version__).select("path", "fingerprint", "version", "facts")
    return None


def _nothing(spark: SparkSession) -> DataFrame:
    empty = facts(spark.createDataFrame([], "path string, source string, error string"))
    return empty.select("path", F.lit("").alias("fingerprint"), F.lit(__version__).alias("version"), F.struct("*").alias("facts"))


def _form(spark: SparkSession):
    return _nothing(spark).schema["facts"].dataType


def _next(spark: SparkSession, path: str) -> str:
    fs, at = _folder(spark, path)
    numbers = [int(m[1]) for s in (fs.listStatus(at) if fs.exists(at) else []) if (m := _NAME.fullmatch(s.getPath().getName()))]
    return f"{path}/v{max(numbers, default=0) + 1:012d}-{uuid.uuid4().hex}"


def save(snapshot: DataFrame, path: str) -> None:
    """Writes the next snapshot; older ones than the last but one go."""
    spark = snapshot.sparkSession
    snapshot.write.parquet(_next(spark, path))
    for name in snapshots(spark, path)[KEPT:]:
        fs, at = _folder(spark, f"{path}/{name}")
        fs.delete(at, True)


def facts_through(spark: SparkSession, sources: DataFrame, path: str, salt: str = "") -> tuple[DataFrame, dict[str, int]]:
    """(facts, counts of hit, miss and pruned): fresh facts of changed files, held ones of the others. The snapshot follows if anything changed."""
    now = sources.select("path", content_fingerprint(F.coalesce("source", F.lit("")), salt).alias("fingerprint"))
    old = load(spark, path)
    if old is None:
        old = _nothing(spark)
    plan = stored(relations.cache_plan(old, now))
    counts = {s: 0 for s in ("hit", "miss", "pruned")} | {r["state"]: r["n"] for r in plan.groupBy("state").agg(F.count("*").alias("n")).collect()}
    missing = sources.join(plan.where("state = 'miss'").select("path"), "path", "left_semi")
    fresh = facts(missing).select("path", F.struct("*").alias("facts")).join(now, "path").select("path", "fingerprint", F.lit(__version__).alias("version"), "facts")
    merged = stored(relations.merged(old, fresh, plan))
    if counts["miss"] or counts["pruned"]:
        save(merged, path)
    return merged.select("facts.*"), counts
