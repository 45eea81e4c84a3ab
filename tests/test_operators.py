import random

import pytest
from pyspark.sql import functions as F

from taproot.functions import hashing, text
from taproot.operators import dataflow, graph, relations, similarity


def closure_of(edges, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_reachable_equals_a_driver_side_search(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(50)]
    df = spark.createDataFrame(edges, "src long, dst long")
    roots = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "root_set string, node long")
    got = {(r[0], r[1]) for r in graph.reachable(df, roots).collect()}
    assert got == {("a", x) for x in closure_of(edges, [0, 1])} | {("b", x) for x in closure_of(edges, [2])}


def test_cycles_end(spark):
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")], "name string, parent string")
    got = {tuple(r) for r in graph.closure(pairs).collect()}
    assert got == {(x, y) for x in "ABC" for y in "ABC"} | {("D", y) for y in "ABC"}


def test_hash_of_any_string(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:x}"

    values = ["", "a", "foobar", "naïve – ünïcode 日本"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(hashing.fnv1a64_hex(F.col("s"))).collect()] == [fnv(v) for v in values]


def test_globs_and_patterns():
    import re

    assert re.match(text.glob_regex("**/Tests/*.swift"), "a/b/Tests/x.swift")
    assert re.match(text.glob_regex("**/Tests/*.swift"), "Tests/x.swift")
    assert not re.match(text.glob_regex("*.swift"), "a/x.swift")
    assert text.safe_pattern("(a+)+") is None and text.safe_pattern("x" * 600) is None and text.safe_pattern("(") is None
    assert text.safe_pattern("^a.*b$")


def test_directives(spark):
    rows = ["// @tr:accept dead-store -- on purpose", "/// @tr:accept", "// @tr:disable", "// @tr:accept nonsense", "// plain"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = [r[0] and (r[0].verb, r[0].rules, r[0].reason) for r in df.select(text.directive(F.col("c"), ["dead-store"])).collect()]
    assert got == [("accept", ["dead-store"], "on purpose"), None, ("disable", [], None), None, None]


def test_interval_join_at_bucket_edges(spark):
    decl = spark.createDataFrame([(1, "f", 60, 130), (2, "f", 64, 64)], "decl long, file string, first int, last int")
    refs = spark.createDataFrame([(i, "f", i) for i in (59, 60, 63, 64, 127, 128, 130, 131)], "ref long, file string, line int")
    got = {(r.decl, r.ref) for r in relations.references_in_range(decl, refs).collect()}
    assert got == {(1, x) for x in (60, 63, 64, 127, 128, 130)} | {(2, 64)}


def test_cache_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, fingerprint string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, fingerprint string")
    plan = relations.cache_plan(old, new)
    assert {tuple(r) for r in plan.collect()} == {("a", "hit"), ("b", "miss"), ("c", "pruned"), ("d", "miss")}
    assert {tuple(r) for r in relations.merged(old, new, plan).collect()} == {("a", "1"), ("b", "2"), ("d", "1")}


def test_liveness_of_a_small_loop(spark):
    # 1: x = . ; 2: y = x ; 3: x = y ; back to 2
    statements = spark.createDataFrame([(1, 1, "x", None), (1, 2, "y", "x"), (1, 3, "x", "y")], "fn int, pos int, def string, use string")
    flow = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 2)], "fn int, src int, dst int")
    live = dataflow.live_in(statements, flow)
    assert {(r.pos, r["var"]) for r in live.collect()} == {(2, "x"), (3, "y")}
    assert dataflow.dead_stores(statements, flow, live).count() == 0
    assert {(r.pos, r["var"], r["at"]) for r in dataflow.reaching(statements, flow).collect()} == {(2, "x", 1), (3, "x", 1), (2, "y", 2), (3, "y", 2), (2, "x", 3), (3, "x", 3)} - {(3, "x", 1)} | {(3, "x", 1)}


def test_dataflow_by_function_equals_that_by_joins(spark, monkeypatch):
    rnd = random.Random(5)
    var = lambda: rnd.choice(["x", "y", "z", None])
    stmts = [(fn, pos, var(), var()) for fn in range(12) for pos in range(8) for _ in range(rnd.choice([1, 1, 1, 2]))]
    edges = [(fn, rnd.randrange(9), rnd.randrange(9)) for fn in range(12) for _ in range(12)] + [(None, 1, 2), (1, None, 2), (1, 2, None)]
    statements = spark.createDataFrame(stmts + [(None, 1, "x", "y")], "fn int, pos int, def string, use string")
    flow = spark.createDataFrame(edges, "fn int, src int, dst int")
    for solve in (dataflow.live_in, dataflow.reaching):
        got = {}
        for large in (0, 25, 100_000):  # all by joins, some, none
            monkeypatch.setattr(dataflow, "LARGE", large)
            rows = [tuple(r) for r in solve(statements, flow).collect()]
            got[large] = set(rows)
            assert len(rows) == len(got[large])
        assert got[0] and got[0] == got[25] == got[100_000]
    empty = dataflow.live_in(statements.limit(0), flow.limit(0))
    assert empty.count() == 0 and empty.columns == ["fn", "pos", "var"]


def test_names_lead_through_one_node_each(spark):
    decls = spark.createDataFrame([(f"d{i}", n) for i, n in enumerate(["init"] * 3 + ["b", None])], "decl string, name string")
    uses = spark.createDataFrame([(f"u{i}", n) for i, n in enumerate(["init"] * 4 + ["b", "none", None])], "src string, name string")
    hops = relations.name_hops(decls, uses)
    assert hops.where("src IS NOT NULL AND dst IS NOT NULL").count() == 4 + 3 + 1 + 1
    roots = spark.createDataFrame([("a", "u0"), ("b", "u4"), ("c", "u6")], "root_set string, node string")
    got = {(r[0], r[1]) for r in graph.reachable(hops, roots).collect() if not r[1].startswith("\0")}
    pairs = graph.reachable(relations.name_edges(decls, uses), roots)
    assert got == {(r[0], r[1]) for r in pairs.collect()} == {("a", "u0"), ("a", "d0"), ("a", "d1"), ("a", "d2"), ("b", "u4"), ("b", "d3"), ("c", "u6")}


def test_outlier_scores_highest(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(4)] + [(9, [0.0, 0.0, 1.0]), (10, [0.0, 0.0, 0.0])]
    got = dict(map(tuple, similarity.anomaly(spark.createDataFrame(rows, "id long, v array<double>"), 2).collect()))
    assert got[9] == 1.0 and got[10] == 1.0 and max(got[i] for i in range(4)) < 0.01


def test_word_pieces():
    t = similarity.WordPiece({"[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "hello": 1, "wor": 2, "##ld": 3, ",": 4})
    assert t.encode("Héllo, world zz") == [101, 1, 4, 2, 3, 100, 102]
    assert t.encode(None) == [101, 102] and t.encode("x" * 101) == [101, 100, 102]


def test_ancestors_of_a_cycle_end(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "node string, parent string")
    got = {tuple(r) for r in graph.ancestors(tree).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "b", 2), ("c", "b", 1), ("c", "c", 2)}


def test_unreachable_of_each_root_set(spark):
    nodes, edges = spark.createDataFrame([(x,) for x in "abcd"], "node string"), spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("one", "a"), ("two", "a"), ("two", "c")], "root_set string, node string")
    assert {tuple(r) for r in graph.unreachable(nodes, edges, roots).collect()} == {("one", "c"), ("one", "d")}


def test_approximate_neighbours(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = similarity.neighbours(rows, cells=1).cache()
    near = {r.id: [x.other for x in r.near] for r in exact.collect()}
    assert all(len(v) == 5 and i not in v for i, v in near.items())
    mean = {r.id: 1 - sum(x.similarity for x in r.near) / 5 for r in exact.collect()}
    assert all(abs(max(0, mean[r.id]) - r.anomaly) < 1e-9 for r in similarity.anomaly(rows).collect())
    found = similarity.recall(similarity.neighbours(rows), exact)
    assert found >= 0.9, found
    monkeypatch.setattr(similarity, "BLOCK", 50)  # cells are cut
    assert similarity.recall(similarity.neighbours(rows, cells=3, probes=3), exact) == 1.0
    copies = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(120)] + [(500, [0.0, 1.0]), (None, [1.0, 1.0]), (501, None)], "id long, v array<double>")
    assert {r.id: [x.other for x in r.near] for r in similarity.neighbours(copies, k=2, cells=1).collect()}[7] == [0, 1]
    assert similarity.neighbours(copies.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_by_blocks_copy_no_row_per_pair(spark, monkeypatch, kind):
    """Blocks and parts of any size give what all pairs give; of equal neighbours the least id is kept."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "ASKING", 2)
    monkeypatch.setattr(similarity, "ASKED_BYTES", 1000)
    v = np.random.default_rng(5).integers(0, 4, (150, 6)).astype("float32")  # with ties and copies
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"id long, v array<{kind}>").repartition(3)
    norm = np.linalg.norm(v.astype(float), axis=1)
    sims = (v.astype(float) / np.where(norm, norm, 1)[:, None]) @ (v.astype(float) / np.where(norm, norm, 1)[:, None]).T
    best = [sorted((-round(float(sims[i, j]), 9), j) for j in range(150) if j != i)[:5] for i in range(150)]
    found = similarity.anomaly(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    got = dict(map(tuple, found.collect()))
    assert len(got) == 150 and all(abs(got[i] - max(0, 1 + sum(s for s, _ in best[i]) / 5)) < 1e-8 for i in got)
    near = {r.id: [(-round(x.similarity, 9), x.other) for x in r.near] for r in similarity.neighbours(rows, cells=3, probes=3).collect()}
    assert len(near) == 150 and all([s for s, _ in near[i]] == [s for s, _ in best[i]] for i in near)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    assert {r.id: round(r.anomaly, 4) for r in similarity.anomaly(odd, 1).collect()} == {1: 0.2929, 2: 1.0, 3: 0.2929, 4: 1.0}
    assert similarity.anomaly(rows.limit(0)).count() == 0


def test_pairs_of_witnesses_are_not_shuffled(spark):
    """Members of one type and name meet a requirement once; only those of several are made distinct after the join."""
    wanted = spark.createDataFrame([("r1", "P", "go"), ("r1", "Q", "go"), ("r1", "P", "go"), ("r2", "P", "stop"), ("r3", "Z", "go"), ("r4", "P", None)], "requirement string, protocol string, name string")
    conforms = spark.createDataFrame([("P", "A"), ("P", "A"), ("Q", "A"), ("P", "B"), ("Q", "B"), ("P", None)], "protocol string, type string")
    members = [("m1", "A", "go"), ("m1", "A", "go"), ("m2", "A", "go"), ("m2", "B", "go"), ("m2", "B", "stop"), ("m3", None, "go"), ("m4", "B", None), (None, "A", "go"), (None, "B", "go"), ("m5", "C", "go"), ("m5", "B", "stop")]
    have = spark.createDataFrame(members, "member string, type string, name string")
    found = relations.witnesses(wanted, have, conforms)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [("r1", "m1"), ("r1", "m2"), ("r2", "m2"), ("r1", None), ("r2", "m5")]))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    top = next(i for i, line in enumerate(plan) if line.startswith("Union"))
    assert not any("Aggregate" in line for line in plan[:top]) and "Aggregate" not in plan[top + 1]
