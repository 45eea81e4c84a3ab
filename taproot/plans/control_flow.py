"""Dead branches and dead stores of function bodies, from the tables of their control flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.frontend import cfg
from taproot.operators import constants, dataflow
from taproot.storage import stored


def bodies(facts: DataFrame) -> DataFrame:
    """The rows of all bodies, stored; fn is the path and the body's number there."""
    own = facts.select("path", F.explode("flow").alias("f")).select("path", "f.*")
    return stored(own.withColumn("fn", F.concat_ws("#", "path", F.col("fn").cast("string"))))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("fn", "path", "function").distinct()


def dead_branches(rows: DataFrame) -> DataFrame:
    """(path, function, line, what) of sides that never run; an `if` without `else` has no other side to lose."""
    of = lambda what: rows.where(F.col("what") == what)
    tests = of("test").select("fn", "block", "path", "function", "line", F.col("target").alias("condition"), F.col("loop").alias("one_sided"))
    if not tests.limit(1).count():
        return tests.select("path", "function", "line", F.lit("").alias("what"))
    some = tests.select("fn").distinct()  # bodies without a condition have no dead side
    flow = of("flow").join(some, "fn", "left_semi").select("fn", F.col("block").alias("src"), "dst", "side")
    steps = of("step").join(some, "fn", "left_semi").select("fn", "block", "target", *constants.OPERANDS, "loop")
    dead = constants.dead_branches(flow, steps, constants.propagated(flow, steps))
    met = dead.join(tests, ["fn", "block"]).where("NOT (one_sided AND side = 'false')")
    word = F.when(F.col("side") == "true", "then of ").otherwise("else of ")
    return met.select("path", "function", "line", F.concat(word, "condition").alias("what"))


def dead_stores(rows: DataFrame) -> DataFrame:
    """(path, function, line, what) of stores that are overwritten on every way before any read."""
    of = lambda what: rows.where(F.col("what") == what)
    own = of("statement").select("fn", F.col("block").alias("pos"), F.col("target").alias("def"), F.col("left_var").alias("use"), "line", F.col("loop").alias("judged"))
    if not own.where("judged").limit(1).count():
        return own.select(F.lit("").alias("path"), F.lit("").alias("function"), "line", F.col("def").alias("what")).where(F.lit(False))
    statements = own.select("fn", "pos", "def", "use")
    flow = of("hop").select("fn", F.col("block").alias("src"), "dst")
    exits = statements.where(F.col("pos") == cfg.EXIT * cfg.PLACES).select("fn", "pos")
    live, reaching = dataflow.live_in(statements, flow), dataflow.reaching(statements, flow)
    dead = dataflow.overwritten_stores(statements, flow, exits, live, reaching)
    judged = own.where("judged").select("fn", "pos", F.col("def").alias("var"), "line").distinct()
    return dead.distinct().join(judged, ["fn", "pos", "var"]).join(_named(rows), "fn").select("path", "function", "line", F.col("var").alias("what"))
