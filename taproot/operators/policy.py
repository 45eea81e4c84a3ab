"""Judgements about rows: the first reason that holds, needs from a catalogue, confidence, routing and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(reasons: list[tuple[Column, str]]) -> Column:
    """The name of the first test that holds, in order, or null; a null test doesn't hold."""
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), name) for test, name in reasons))


def known_needs(uses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(type, known, needs) of uses (type, base): known if the catalogue (base, needs) has each base of a type.

    The catalogue is a fixed list of ours, so it is broadcast.
    """
    listed = catalogue.withColumn("listed", F.lit(True))
    met = uses.select("type", "base").distinct().join(F.broadcast(listed), "base", "left")
    known = F.bool_and(F.coalesce("listed", F.lit(False)))
    return met.groupBy("type").agg(known.alias("known"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("needs")))).alias("needs"))


def demoted(level: Column, to_lowest: Column, by_one: Column) -> Column:
    """A confidence of 1 (low) or more: the lowest where the first test holds, one less (but 1) where the second does."""
    return F.when(to_lowest, F.lit(1)).when(by_one, F.greatest(level - 1, F.lit(1))).otherwise(level).cast("int")


def routed(rows: DataFrame, rules: list[tuple[str, bool, str]]) -> DataFrame:
    """Rows of enabled rules with their severity; rules are (rule, enabled, severity), other rows have no rule."""
    on = {rule: severity for rule, enabled, severity in rules if enabled}
    if not on:
        return rows.where(F.lit(False)).withColumn("severity", F.lit(None).cast("string"))
    severity = F.create_map(*(F.lit(x) for pair in on.items() for x in pair))
    return rows.where(F.col("rule").isin(*on)).withColumn("severity", severity[F.col("rule")])


def summary(rows: DataFrame, severity: Column, file: Column) -> DataFrame:
    """One row: errors, warnings, files with findings and the highest severity (2 error, 1 warning, 0 none)."""
    error, warning = severity == "error", severity == "warning"
    highest = F.max(F.when(error, 2).when(warning, 1).otherwise(0))
    return rows.agg(F.count_if(error).alias("errors"), F.count_if(warning).alias("warnings"), F.countDistinct(file).alias("files"), F.coalesce(highest, F.lit(0)).alias("max_severity"))
