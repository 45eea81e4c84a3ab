"""Dataflow over statements as relations.

A function's statements are (fn, pos, def, use); its flow is (fn, src, dst). Functions are solved one by one, in the tasks
that one shuffle deals them to; functions too large for that grow their facts by joins until nothing is new.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from taproot.storage import stored


def exposed_uses(statements: DataFrame) -> DataFrame:
    """(fn, use, first_use) of variables that a block uses before it defines them."""
    uses = statements.where("use IS NOT NULL").groupBy("fn", F.col("use").alias("var")).agg(F.min("pos").alias("first_use"))
    defs = statements.where("def IS NOT NULL").groupBy("fn", F.col("def").alias("var")).agg(F.min("pos").alias("first_def"))
    return uses.join(defs, ["fn", "var"], "left").where("first_def IS NULL OR first_use <= first_def").select("fn", "var", "first_use")


#: A function with at most so many statements and flow edges is solved in one task; larger ones by joins.
LARGE = 100_000
#: Rows per Arrow batch of the results.
BATCH = 1 << 16


def _schema(statements: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(c, statements.schema[c].dataType) for c in ("fn", "pos")] + list(more))


def solved(rows: DataFrame, schema: T.StructType, solve: Callable[[list[tuple]], Iterator[tuple]], by_joins: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (fn, ...) of all functions, solved function by function.

    Functions don't depend on each other: one shuffle brings a function's rows together, and ``solve`` gets them without fn and
    gives rows of ``schema`` without fn. Functions beyond `LARGE` rows are solved by ``by_joins``, all of them at once. Rows
    without a function are left out.
    """
    rows = stored(rows.where("fn IS NOT NULL"))
    large = stored(rows.groupBy("fn").count().where(F.col("count") > LARGE).select("fn"))
    target = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        found = ((fn, *row) for fn, own in groupby(flat(), key=itemgetter(0)) for row in solve([r[1:] for r in own]))
        while part := list(islice(found, BATCH)):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), target, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    some_large = large.limit(1).count() > 0
    small = rows.join(large, "fn", "left_anti") if some_large else rows
    out = small.select("fn", *(c for c in rows.columns if c != "fn")).repartition("fn").sortWithinPartitions("fn").mapInArrow(each, schema)
    if some_large:
        out = out.unionByName(by_joins(rows.join(large, "fn", "left_semi")))
    return stored(out)


def _by_function(statements: DataFrame, flow: DataFrame, schema: T.StructType, solve: Callable, by_joins: Callable) -> DataFrame:
    """`solved` for statements (fn, pos, def, use) and their flow."""
    steps = flow.select("fn", F.col("src").alias("pos"), "dst").where("pos IS NOT NULL AND dst IS NOT NULL")
    own = statements.select("fn", "pos", "def", "use").withColumn("is_flow", F.lit(False))
    rows = own.unionByName(steps.withColumn("is_flow", F.lit(True)), allowMissingColumns=True).select("fn", "pos", "def", "use", "dst", "is_flow")

    def each(own: list[tuple]) -> Iterator[tuple]:
        return solve([r[:3] for r in own if not r[4]], [(r[0], r[3]) for r in own if r[4]])

    def joined(rest: DataFrame) -> DataFrame:
        return by_joins(rest.where("NOT is_flow").select("fn", "pos", "def", "use"), rest.where("is_flow").select("fn", F.col("pos").alias("src"), "dst"))

    return solved(rows, schema, each, joined)


def _walk(starts: set, to: dict[object, set], stops: Callable[[object], bool]) -> set:
    """What ``starts`` reach, themselves included; nothing is entered that ``stops``."""
    seen, todo = set(starts), list(starts)
    while todo:
        for pos in to.get(todo.pop(), ()):
            if pos not in seen and not stops(pos):
                seen.add(pos)
                todo.append(pos)
    return seen


def _definitions(stmts: list[tuple]) -> dict[object, set]:
    defs = defaultdict(set)
    for pos, d, _ in stmts:
        defs[pos].add(d)
    return defs


def _live_in(stmts: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """(pos, var) one variable after the other: back from its uses, over statements that don't define it."""
    defs, back, uses = _definitions(stmts), defaultdict(set), defaultdict(set)
    for pos, dst in edges:
        if pos in defs:
            back[dst].add(pos)
    for pos, _, use in stmts:
        if use is not None:
            uses[use].add(pos)
    for var, starts in uses.items():
        for pos in _walk(starts, back, lambda p, only={var}: defs[p] == only):
            yield pos, var


def _reaching(stmts: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """(pos, var, at) one definition after the other: on from it, until a statement defines its variable again."""
    defs, on = _definitions(stmts), defaultdict(set)
    for pos, dst in edges:
        if pos in defs:
            on[pos].add(dst)
    for at, variables in defs.items():
        for var in variables - {None}:
            seen, todo = set(), list(on.get(at, ()))
            while todo:
                pos = todo.pop()
                if pos not in seen:
                    seen.add(pos)
                    if defs.get(pos) != {var}:
                        todo.extend(on.get(pos, ()))
            for pos in seen:
                yield pos, var, at


def _live_in_by_joins(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """`live_in` of any size, one shuffle a step."""
    stmts, back = stored(statements.select("fn", "pos", "def", "use")), stored(flow.select("fn", F.col("src").alias("pos"), F.col("dst").alias("next")))
    into = stored(back.join(stmts.select("fn", "pos", "def"), ["fn", "pos"]))
    found = frontier = stored(stmts.where("use IS NOT NULL").select("fn", "pos", F.col("use").alias("var")).distinct())
    while frontier.limit(1).count():
        up = frontier.withColumnRenamed("pos", "next").join(into, ["fn", "next"]).where("NOT (def <=> var)").select("fn", "pos", "var").distinct()
        frontier = stored(up.join(found, ["fn", "pos", "var"], "left_anti"))
        found = found.union(frontier)
    return found


def live_in(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(fn, pos, var): variables live before a statement: used there, or live after it and not defined there."""
    stmts = statements.select("fn", "pos", "def", "use")
    var = statements.schema["use"].dataType
    schema = _schema(statements, T.StructField("var", var))
    return _by_function(stmts, flow, schema, _live_in, _live_in_by_joins)


def dead_stores(statements: DataFrame, flow: DataFrame, live: DataFrame) -> DataFrame:
    """(fn, pos, var) of definitions that no later statement reads and their own statement doesn't use."""
    after = flow.select("fn", F.col("src").alias("pos"), F.col("dst").alias("next")).join(live.select("fn", F.col("pos").alias("next"), "var"), ["fn", "next"]).select("fn", "pos", "var").distinct()
    stores = statements.where("def IS NOT NULL AND NOT (def <=> use)").select("fn", "pos", F.col("def").alias("var"))
    return stores.join(after, ["fn", "pos", "var"], "left_anti")


def _reaching_by_joins(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """`reaching` of any size, one shuffle a step."""
    stmts = stored(statements.select("fn", "pos", "def"))
    edges = stored(flow.select("fn", F.col("src").alias("pos"), "dst").join(stmts, ["fn", "pos"]))
    found = frontier = stored(edges.where("def IS NOT NULL").select("fn", F.col("dst").alias("pos"), F.col("def").alias("var"), F.col("pos").alias("at")).distinct())
    while frontier.limit(1).count():
        on = frontier.join(edges, ["fn", "pos"]).where("NOT (def <=> var)").select("fn", F.col("dst").alias("pos"), "var", "at").distinct()
        frontier = stored(on.join(found, ["fn", "pos", "var", "at"], "left_anti"))
        found = found.union(frontier)
    return found


def reaching(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(fn, pos, var, at): the definition of var at ``at`` reaches the entry of the statement at pos."""
    stmts = statements.select("fn", "pos", "def", F.lit(None).alias("use"))
    schema = _schema(statements, T.StructField("var", statements.schema["def"].dataType), T.StructField("at", statements.schema["pos"].dataType))
    return _by_function(stmts, flow, schema, _reaching, _reaching_by_joins)


def _unassigned(stmts: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    """(pos, var) one variable after the other: on from the entries, where flow from null leads, over statements that don't define it."""
    defs, on, asked = _definitions(stmts), defaultdict(set), defaultdict(set)
    for pos, dst in edges:
        on[pos].add(dst)
    for pos, _, use in stmts:
        if use is not None:
            asked[use].add(pos)
    for var, uses in asked.items():
        seen, todo = set(on[None]), list(on[None])
        while todo:
            pos = todo.pop()
            if var not in defs.get(pos, ()):
                new = on.get(pos, set()) - seen
                seen |= new
                todo.extend(new)
        for pos in seen & uses:
            yield pos, var


def _unassigned_by_joins(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """`unassigned_uses` of any size, one shuffle a step."""
    stmts, edges = stored(statements), stored(flow.where("src IS NOT NULL").select("fn", F.col("src").alias("pos"), "dst"))
    uses = stored(stmts.where("use IS NOT NULL").select("fn", F.col("use").alias("var"), "pos").distinct())
    defs = stored(stmts.where("def IS NOT NULL").select("fn", F.col("def").alias("var"), "pos").distinct())
    entries = flow.where("src IS NULL").select("fn", F.col("dst").alias("pos"))
    found = frontier = stored(entries.join(uses.select("fn", "var").distinct(), "fn").distinct())
    while frontier.limit(1).count():
        on = frontier.join(defs, ["fn", "var", "pos"], "left_anti").join(edges, ["fn", "pos"]).select("fn", F.col("dst").alias("pos"), "var").distinct()
        frontier = stored(on.join(found, ["fn", "pos", "var"], "left_anti"))
        found = found.union(frontier)
    return found.join(uses, ["fn", "var", "pos"], "left_semi").select("fn", "pos", "var")


def unassigned_uses(statements: DataFrame, flow: DataFrame, entries: DataFrame) -> DataFrame:
    """(fn, pos, var) of uses that some way from an entry (fn, pos) comes to without a definition.

    A variable is surely assigned at a statement if it is at the end of every predecessor: a meet by intersection. Its complement,
    computed here, is what at least one way leaves open. A statement reads before it writes.
    """
    start = entries.select("fn", F.lit(None).cast(flow.schema["src"].dataType).alias("src"), F.col("pos").alias("dst"))
    steps = flow.select("fn", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").unionByName(start)
    rows = statements.select("fn", "pos", "def", "use").withColumn("is_flow", F.lit(False))
    rows = rows.unionByName(steps.select("fn", F.col("src").alias("pos"), "dst").withColumn("is_flow", F.lit(True)), allowMissingColumns=True)
    rows = rows.select("fn", "pos", "def", "use", "dst", "is_flow")

    def each(own: list[tuple]) -> Iterator[tuple]:
        return _unassigned([r[:3] for r in own if not r[4]], [(r[0], r[3]) for r in own if r[4]])

    def joined(rest: DataFrame) -> DataFrame:
        return _unassigned_by_joins(rest.where("NOT is_flow").select("fn", "pos", "def", "use"), rest.where("is_flow").select("fn", F.col("pos").alias("src"), "dst"))

    return solved(rows, _schema(statements, T.StructField("var", statements.schema["use"].dataType)), each, joined)


def uninitialised(statements: DataFrame, flow: DataFrame, entries: DataFrame, chains: DataFrame) -> DataFrame:
    """(fn, pos, var, never) of uses that may read an unassigned variable; never: no definition reaches the use at all."""
    fed = chains.select("fn", "pos", "var").distinct().withColumn("fed", F.lit(True))
    found = unassigned_uses(statements, flow, entries).join(fed, ["fn", "pos", "var"], "left")
    return found.select("fn", "pos", "var", F.col("fed").isNull().alias("never"))


def _chained(stmts: list[tuple], edges: list[tuple]) -> Iterator[tuple]:
    uses = defaultdict(set)
    for pos, _, use in stmts:
        uses[use].add(pos)
    for pos, var, at in _reaching(stmts, edges):
        if pos in uses[var]:
            yield pos, var, at


def _chained_by_joins(statements: DataFrame, flow: DataFrame) -> DataFrame:
    uses = statements.where("use IS NOT NULL").select("fn", "pos", F.col("use").alias("var")).distinct()
    return _reaching_by_joins(statements, flow).join(uses, ["fn", "pos", "var"], "left_semi").select("fn", "pos", "var", "at")


def def_use(statements: DataFrame, flow: DataFrame) -> DataFrame:
    """(fn, pos, var, at): the statement at pos uses var as the one at ``at`` has defined it. Only chains leave a task."""
    schema = _schema(statements, T.StructField("var", statements.schema["def"].dataType), T.StructField("at", statements.schema["pos"].dataType))
    return _by_function(statements, flow, schema, _chained, _chained_by_joins)


def survivors(statements: DataFrame, exits: DataFrame, reaching_: DataFrame) -> DataFrame:
    """(fn, var, at): definitions that leave the function over one of its exits (fn, pos).

    What leaves an exit statement is rebuilt from what comes to it: its own definitions, and those that reach it and that it
    doesn't replace.
    """
    last = exits.select("fn", "pos").distinct()
    own = statements.where("def IS NOT NULL").select("fn", "pos", F.col("def").alias("var")).distinct().join(last, ["fn", "pos"], "left_semi")
    through = reaching_.join(last, ["fn", "pos"], "left_semi").join(own, ["fn", "pos", "var"], "left_anti").select("fn", "var", "at")
    return through.unionByName(own.select("fn", "var", F.col("pos").alias("at"))).distinct()


def overwritten_stores(statements: DataFrame, flow: DataFrame, exits: DataFrame, live: DataFrame, reaching_: DataFrame) -> DataFrame:
    """(fn, pos, var) of dead stores that are overwritten on every way; what is left at an exit is a last value, no dead store."""
    kept = survivors(statements, exits, reaching_).withColumnRenamed("at", "pos")
    return dead_stores(statements, flow, live).join(kept, ["fn", "pos", "var"], "left_anti")


def unused_variables(statements: DataFrame) -> DataFrame:
    defs = statements.where("def IS NOT NULL").select("fn", F.col("def").alias("var")).distinct()
    return defs.join(statements.where("use IS NOT NULL").select("fn", F.col("use").alias("var")).distinct(), ["fn", "var"], "left_anti")


def meet(values: DataFrame, key: str, value: str) -> DataFrame:
    """The lattice meet per key: one value everywhere is that constant, else not a constant (null)."""
    return values.groupBy(key).agg(F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count("*")), F.min(value)).alias("constant"))


def in_order(rows: DataFrame, fn: str, columns: list[str]) -> DataFrame:
    """``rows`` with pos, their place from 1 within ``fn`` by all given columns."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(fn).orderBy(*columns)).cast("long"))
