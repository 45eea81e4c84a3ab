"""Constants, must-assignment, chains and dead stores over tables: planted cases, and functions solved alone against joins."""

import random

import pytest
from pyspark.sql import functions as F

from taproot.operators import constants, dataflow

FLOW = "fn long, src long, dst long, side string"
STEPS = "fn long, block long, target string, op string, left_var string, left string, right_var string, right string, loop boolean"


def step(block, target, op=None, left_var=None, left=None, right_var=None, right=None, loop=False, fn=1):
    return fn, block, target, op, left_var, left, right_var, right, loop


def tables(spark, flow, steps):
    return spark.createDataFrame([(1, *f) for f in flow], FLOW), spark.createDataFrame(steps, STEPS)


def solved(spark, flow, steps):
    flow, steps = tables(spark, flow, steps)
    found = constants.propagated(flow, steps)
    edges = {(r.src, r.dst) for r in constants.executable_edges(found).collect()}
    values = {r.name: r.value for r in constants.values(found).collect()}
    dead = {(r.block, r.side, r.value) for r in constants.dead_branches(flow, steps, found).collect()}
    return edges, values, dead, {r.block for r in constants.unreachable_blocks(flow, found).collect()}


@pytest.fixture(params=[100_000, 0], ids=["alone", "joins"])
def by_size(request, monkeypatch):
    monkeypatch.setattr(dataflow, "LARGE", request.param)


def test_a_dead_way_sets_nothing(spark, by_size):
    # x = 1; if x == 1 { y = 2 + 3 } else { x = 7; y = 0 }; if y > 4 {...}
    flow = [(None, 1, None), (1, 2, "true"), (1, 3, "false"), (2, 4, None), (3, 4, None), (4, 5, "true"), (4, 6, "false")]
    steps = [
        step(1, "x", left="1"), step(1, None, "==", left_var="x", right="1"), step(2, "y", "+", left="2", right="3"),
        step(3, "x", left="7"), step(3, "y", left="0"), step(4, None, ">", left_var="y", right="4"),
    ]
    edges, values, dead, unreachable = solved(spark, flow, steps)
    assert edges == {(1, 2), (2, 4), (4, 5)} and values == {"x": "1", "y": "5"}
    assert dead == {(1, "false", "true"), (4, "false", "true")} and unreachable == {3, 6}


def test_loops_and_parameters(spark, by_size):
    # i = 0; while i < 9 { i = i + 1 }; while true {}; if parameter {...} else {...}
    flow = [(None, 1, None), (1, 2, None), (2, 3, "true"), (2, 4, "false"), (3, 2, None), (4, 5, "true"), (4, 6, "false"), (5, 4, None)]
    flow += [(1, 7, None), (7, 8, "true"), (7, 9, "false")]
    steps = [
        step(1, "i", left="0"), step(2, None, "<", left_var="i", right="9", loop=True), step(3, "i", "+", left_var="i", right="1"),
        step(4, None, left="true", loop=True), step(7, None, left_var="parameter"), step(8, "copy", left_var="parameter"), step(9, "n", "call"),
    ]
    edges, values, dead, unreachable = solved(spark, flow, steps)
    assert edges == {(1, 2), (2, 3), (2, 4), (3, 2), (4, 5), (5, 4), (1, 7), (7, 8), (7, 9)}
    assert values == {"i": "?", "n": "?"} and dead == set() and unreachable == {6}


def test_two_unknown_conditions_open_together(spark, by_size):
    # Each condition's variable is set on the other's way only.
    flow = [(None, 1, None), (1, 2, None), (1, 3, None), (2, 4, "true"), (2, 5, "false"), (3, 6, "true"), (3, 7, "false")]
    steps = [step(2, None, left_var="a"), step(3, None, left_var="b"), step(4, "b", left="true"), step(6, "a", left="true")]
    edges, values, dead, _ = solved(spark, flow, steps)
    assert edges == {(1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7)} and values == {"a": "true", "b": "true"} and dead == set()


def test_folding(spark):
    operands = [None, "?", "0", "1", "-7", "2", "true", "false", "nil", "x", str(2**63 - 1), str(-(2**63)), "9" * 30]
    rows = [(o, a, b) for o in (None, "call", "^", *constants.OPERATORS) for a in operands for b in operands]
    df = spark.createDataFrame(rows, "op string, a string, b string")
    got = df.select("*", constants.folded_column(F.col("op"), F.col("a"), F.col("b")).alias("v")).collect()
    wrong = [(r.op, r.a, r.b, r.v, w) for r in got if r.v != (w := constants.folded(r.op, r.a, r.b))]
    assert wrong == []
    assert constants.folded("/", "-7", "2") == "-3" and constants.folded("%", "-7", "2") == "-1" and constants.folded("/", "1", "0") == "?"
    assert constants.folded("+", str(2**63 - 1), "1") == "?" and constants.folded("negate", str(-(2**63)), None) == "?"


def random_functions(n=30):
    rnd = random.Random(11)
    flow, steps = [], []
    for fn in range(n):
        blocks, names = rnd.randrange(2, 6), "abc"
        flow.append((fn, None, 0, None))
        for b in range(blocks):
            operand = lambda: (rnd.choice(names), None) if rnd.random() < 0.5 else (None, rnd.choice(["0", "1", "2", "true", "false"]))
            for _ in range(rnd.randrange(3)):
                (lv, left), (rv, right) = operand(), operand()
                op = rnd.choice([None, None, "call", "+", "<", "=="])
                steps.append((fn, b, rnd.choice(names), op, lv, left, *((rv, right) if op not in (None, "call") else (None, None)), False))
            if rnd.random() < 0.5:
                (lv, left), (rv, right) = operand(), operand()
                steps.append((fn, b, None, rnd.choice([None, "<", "=="]), lv, left, rv, right, rnd.random() < 0.2))
                flow += [(fn, b, rnd.randrange(blocks), "true"), (fn, b, rnd.randrange(blocks), "false")]
            else:
                flow.append((fn, b, rnd.randrange(blocks), None))
    return flow, steps


def test_constants_alone_equal_those_by_joins(spark, monkeypatch):
    flow, steps = random_functions()
    flow, steps = spark.createDataFrame(flow, FLOW), spark.createDataFrame(steps, STEPS)
    alone = {tuple(r) for r in constants.propagated(flow, steps).collect()}
    monkeypatch.setattr(dataflow, "LARGE", 12)  # some functions are larger
    assert {tuple(r) for r in constants.propagated(flow, steps).collect()} == alone
    assert {r[1] for r in alone} == {"edge", "value"}
    assert constants.propagated(flow.limit(0), steps.limit(0)).count() == 0


STATEMENTS = "fn long, pos long, def string, use string"


def body(spark, statements, flow):
    return spark.createDataFrame([(1, *s) for s in statements], STATEMENTS), spark.createDataFrame([(1, *f) for f in flow], "fn long, src long, dst long")


def test_uses_that_may_be_unassigned(spark, by_size):
    # 1: if c { 2: x = 1 }; 3: use x; 4: x = 2; 5: use x; 6: use y, never set
    statements, flow = body(spark, [(1, None, None), (2, "x", None), (3, None, "x"), (4, "x", None), (5, None, "x"), (6, None, "y")], [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6)])
    entries = spark.createDataFrame([(1, 1)], "fn long, pos long")
    chains = dataflow.def_use(statements, flow)
    assert {(r.pos, r["at"]) for r in chains.collect()} == {(3, 2), (5, 4)}
    got = {(r.pos, r["var"], r.never) for r in dataflow.uninitialised(statements, flow, entries, chains).collect()}
    assert got == {(3, "x", False), (6, "y", True)}


def test_a_last_value_is_no_dead_store(spark, by_size):
    # 1: x = 1 (overwritten); 2: x = 2 (left at the exit); 3: y = 3; 4: if c { 5: y = 4 }; 6: end
    statements, flow = body(spark, [(1, "x", None), (2, "x", None), (3, "y", None), (4, None, "c"), (5, "y", None), (6, None, None)], [(1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)])
    exits = spark.createDataFrame([(1, 6)], "fn long, pos long")
    live, reaching = dataflow.live_in(statements, flow), dataflow.reaching(statements, flow)
    plain = {(r.pos, r["var"]) for r in dataflow.dead_stores(statements, flow, live).collect()}
    assert plain == {(1, "x"), (2, "x"), (3, "y"), (5, "y")}
    assert {(r.pos, r["var"]) for r in dataflow.overwritten_stores(statements, flow, exits, live, reaching).collect()} == {(1, "x")}


def test_random_bodies_alone_equal_those_by_joins(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(fn, pos, rnd.choice(["a", "b", None]), rnd.choice(["a", "b", None])) for fn in range(40) for pos in range(1, rnd.randrange(3, 9))]
    last = {fn: pos for fn, pos, _, _ in rows}
    edges = [(fn, pos, rnd.randrange(1, last[fn] + 1)) for fn, pos, _, _ in rows for _ in range(2)]
    statements, flow = spark.createDataFrame(rows, STATEMENTS), spark.createDataFrame(edges, "fn long, src long, dst long").distinct()
    entries = spark.createDataFrame([(fn, 1) for fn in last], "fn long, pos long")
    results = []
    for large in (100_000, 9):
        monkeypatch.setattr(dataflow, "LARGE", large)
        chains = dataflow.def_use(statements, flow)
        results.append([{tuple(r) for r in df.collect()} for df in (chains, dataflow.uninitialised(statements, flow, entries, chains))])
    assert results[0] == results[1] and all(results[0])
