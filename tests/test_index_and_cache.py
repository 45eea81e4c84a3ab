import io
import json
import os

import pytest
from pyspark.sql import functions as F

from taproot import cli, storage
from taproot.operators import graph, index_oracle
from taproot.plans import analysis
from taproot.plans.analysis import Configuration, analyze
from taproot.sources import cache, files, sinks


def test_two_types_with_one_name(spark):
    """By name both `go` are used; by symbols only one is."""
    decls = spark.createDataFrame(
        [("d1", "a", "A", "struct", 1, None, None, False), ("d2", "a", "go", "method", 2, "A", "struct", False), ("d3", "a", "B", "struct", 5, None, None, False), ("d4", "a", "go", "method", 6, "B", "struct", False), ("d5", "a", "main", "function", 20, None, None, False), ("d6", "a", "lost", "function", 90, None, None, False)],
        "decl string, path string, name string, kind string, line int, enclosing_type string, enclosing_kind string, local boolean",
    )
    symbols = spark.createDataFrame([("uA", "A", "struct", "a", 1), ("uAgo", "go()", "method", "a", 2), ("uB", "B", "struct", "a", 5), ("uBgo", "go()", "method", "a", 6), ("um", "main()", "function", "a", 21)], "usr string, name string, kind string, path string, line int")
    occ = spark.createDataFrame(
        [("uAgo", "a", 22, "call", "containedBy", "um"), ("uA", "a", 22, "reference", "containedBy", "um"), ("uB", "a", 23, "reference", "containedBy", "um"), ("uAgo", "a", 2, "definition", "childOf", "uA"), ("uBgo", "a", 6, "definition", "childOf", "uB")],
        "usr string, path string, line int, role string, relation string, related string",
    )
    roots = decls.where("name = 'main'").select("decl")
    assert {r.decl for r in index_oracle.unreached(decls, roots, symbols, occ).collect()} == {"d4"}
    assert {(r.decl, r.usr) for r in index_oracle.mapped(decls, symbols).collect()} == {("d1", "uA"), ("d2", "uAgo"), ("d3", "uB"), ("d4", "uBgo"), ("d5", "um")}
    got = {r.usr: (r.n_references, r.self_only) for r in index_oracle.usage(symbols, occ).collect()}
    assert got["uAgo"] == (1, True) and got["uBgo"] == (0, True)


def test_protocol_members_reach_their_witnesses(spark):
    symbols = spark.createDataFrame([("p", "P", "protocol", "a", 1), ("pm", "f()", "method", "a", 2), ("t", "T", "class", "a", 5), ("tm", "f()", "method", "a", 6), ("x", "g()", "method", "a", 7)], "usr string, name string, kind string, path string, line int")
    occ = spark.createDataFrame([("pm", "a", 2, "definition", "childOf", "p"), ("tm", "a", 6, "definition", "childOf", "t"), ("x", "a", 7, "definition", "childOf", "t"), ("p", "a", 5, "reference", "baseOf", "t")], "usr string, path string, line int, role string, relation string, related string")
    assert [tuple(r) for r in index_oracle.protocol_witnesses(symbols, occ).collect()] == [("pm", "tm")]


def test_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    first = files.in_memory(spark, [("a", "func f() {}"), ("b", "func g() {}")])
    got, counts = cache.facts_through(spark, first, at)
    assert counts == {"hit": 0, "miss": 2, "pruned": 0} and got.count() == 2
    second = files.in_memory(spark, [("a", "func f() {}"), ("c", "func h() {}")])
    got, counts = cache.facts_through(spark, second, at)
    assert counts == {"hit": 1, "miss": 1, "pruned": 1}
    assert {r.name for r in files.declarations(got).collect()} == {"f", "h"}
    assert cache.facts_through(spark, second, at)[1] == {"hit": 2, "miss": 0, "pruned": 0}
    assert cache.facts_through(spark, second, at, salt="x")[1]["miss"] == 2
    assert cache.load(spark, str(tmp_path / "none")) is None


def part_files(folder):
    return [os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".parquet")]


def test_a_cache_outlives_a_killed_run_and_broken_files(spark, tmp_path):
    at = str(tmp_path / "cache")
    first = files.in_memory(spark, [("a", "func f() {}"), ("b", "func g() {}")])
    report = analyze(spark, first, cache_at=at)
    assert report.cached == {"hit": 0, "miss": 2, "pruned": 0}
    want = [(r.path, r.line, r.message) for r in report.ordered()]
    # A run that dies while it writes leaves a snapshot without its marker.
    half = cache._next(spark, at)
    cache.load(spark, at).limit(1).write.parquet(half)
    os.remove(os.path.join(half, "_SUCCESS"))
    assert len(cache.snapshots(spark, at)) == 1
    again = analyze(spark, first, cache_at=at)
    assert again.cached == {"hit": 2, "miss": 0, "pruned": 0} and [(r.path, r.line, r.message) for r in again.ordered()] == want
    # What can't be read is a miss.
    for p in part_files(os.path.join(at, cache.snapshots(spark, at)[0])):
        with open(p, "wb") as f:
            f.write(b"junk")
        if os.path.exists(crc := os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")):
            os.remove(crc)
    got, counts = cache.facts_through(spark, first, at)
    assert counts["miss"] == 2 and got.count() == 2
    for i in range(4):
        cache.facts_through(spark, files.in_memory(spark, [("a", f"func f{i}() {{}}")]), at)
    assert len(cache.snapshots(spark, at)) == cache.KEPT


SOURCE = """struct A { func go() {} }
struct B { func go() {} }
@main struct M {
  static func main() { A().go(); _ = B() }
}
"""
SYMBOLS = [("uA", "A", "struct", "a", 1), ("uAgo", "go()", "method", "a", 1), ("uB", "B", "struct", "a", 2), ("uBgo", "go()", "method", "a", 2), ("uM", "M", "struct", "a", 3), ("um", "main()", "function", "a", 4)]
OCCURRENCES = [(u, "a", 4, "call", "containedBy", "um") for u in ("uA", "uAgo", "uB")] + [("uAgo", "a", 1, "definition", "childOf", "uA"), ("uBgo", "a", 2, "definition", "childOf", "uB")]


def an_index(spark, symbols=SYMBOLS, occurrences=OCCURRENCES, units=None):
    tables = spark.createDataFrame(symbols, "usr string, name string, kind string, path string, line int"), spark.createDataFrame(occurrences, "usr string, path string, line int, role string, relation string, related string")
    return index_oracle.Index(*tables, units and spark.createDataFrame(units, "path string, indexed double"))


def found(report):
    return {(r.line, r.message.split("'")[1]) for r in report.ordered()}


def test_an_index_tells_apart_what_names_do_not(spark, tmp_path):
    source = files.in_memory(spark, [("a", SOURCE), ("b", "private func lost() {}")])
    assert found(analyze(spark, source)) == {(1, "lost")}
    report = analyze(spark, source, index=an_index(spark))
    assert found(report) == {(2, "go")} and report.notes == ["the index judges"]
    # Names judge what the index doesn't know, if asked to.
    assert found(analyze(spark, source, Configuration(unmapped="syntax"), an_index(spark))) == {(2, "go"), (1, "lost")}
    # No index, an index of other files, a folder without one: names judge, with a note.
    other = analyze(spark, source, index=an_index(spark, [(u, n, k, "elsewhere", line) for u, n, k, _, line in SYMBOLS]))
    assert found(other) == {(1, "lost")} and "covers none" in other.notes[0]
    gone = analyze(spark, source, index=str(tmp_path / "none"))
    assert found(gone) == {(1, "lost")} and "no index" in gone.notes[0]
    an_index(spark).symbols.write.parquet(str(tmp_path / "some" / "symbols.parquet"))
    an_index(spark).occurrences.drop("role").write.parquet(str(tmp_path / "some" / "occurrences.parquet"))
    assert index_oracle.opened(spark, str(tmp_path / "some"))[1].endswith("has no role")


def test_stale_files(spark):
    known = spark.createDataFrame([("old", 5.0), ("new", 50.0), ("never", 5.0), ("memory", None)], "path string, modified double")
    units = an_index(spark, units=[("old", 1.0), ("old", 9.0), ("new", 9.0)]).units
    assert {r.path for r in index_oracle.stale(known, units).collect()} == {"new", "never"}


def test_all_that_an_index_cannot_judge(spark):
    rows = [
        ("base", "Base", "class", None, None, False, []), ("sub", "Sub", "class", None, None, False, ["Base"]), ("p", "P", "protocol", None, None, False, []),
        ("need", "run", "method", "P", "protocol", False, []), ("ext", "helper", "method", "P", "extension", False, []), ("t", "T", "struct", None, None, False, []),
        ("text", "T", "extension", None, None, False, ["P & Q"]), ("met", "run", "method", "T", "struct", False, []), ("free", "walk", "method", "T", "struct", False, []), ("loc", "x", "variable", "T", "struct", True, []),
    ]
    decls = spark.createDataFrame(rows, "decl string, name string, kind string, enclosing_type string, enclosing_kind string, local boolean, conformances array<string>")
    assert {r.decl for r in index_oracle.forced(decls).collect()} == {"base", "p", "need", "ext", "met", "loc"}


def test_baselines_hold_under_another_root(spark, tmp_path):
    for root in ("one", "two/deep"):
        folder = tmp_path / root / "Sources"
        folder.mkdir(parents=True)
        (tmp_path / root / ".git").mkdir()
        (folder / "a.swift").write_text("private func dead() {}\n")
    baseline = str(tmp_path / "b.json")
    assert cli.run(["analyze", str(tmp_path / "one"), "--strict", "--write-baseline", baseline], spark, io.StringIO()) == 1
    out = io.StringIO()
    assert cli.run(["analyze", str(tmp_path / "two/deep"), "--strict", "--baseline", baseline, "--relative-to", str(tmp_path / "two/deep")], spark, out) == 0
    out = io.StringIO()
    assert cli.run(["analyze", str(tmp_path / "two/deep"), "--relative-to", str(tmp_path / "two/deep")], spark, out) == 0
    assert out.getvalue().startswith("Sources/a.swift:1:")


def test_paths_in_messages_and_degraded_rows_are_relative(spark):
    row = ("unused-function", "warning", "/r/x/a.swift", 1, 1, "see /r/x/b.swift", "/r/x/a.swift", "high", "f")
    names = "rule string, severity string, path string, line int, column int, message string, note string, confidence string, fingerprint string"
    df = spark.createDataFrame([row], names)
    degraded = spark.createDataFrame([("/r/x/c.swift", "can't read /r/x/c.swift"), ("/rx/d", "no")], "path string, degraded string")
    assert analysis.common_root(degraded.union(degraded.limit(0))) == "/" and analysis.common_root(df) == "/r/x"
    report = analysis.Report(df, df.limit(0), degraded).relative_to("/r/x")
    r = report.findings.first()
    assert (r.path, r.message, r.note) == ("a.swift", "see b.swift", "a.swift")
    assert r.fingerprint == analysis.Report(df, df, degraded).relative_to("/r/x/").findings.first().fingerprint != "f"
    assert [tuple(x) for x in report.degraded.collect()] == [("c.swift", "can't read c.swift"), ("/rx/d", "no")]
    assert sinks.as_text([r]).startswith("a.swift:1:1: warning:")


@pytest.mark.parametrize("share", [0, 1 << 40], ids=["push", "pull"])
def test_large_frontiers(spark, monkeypatch, share):
    import random

    monkeypatch.setattr(graph, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(graph, "SHARE", share)
    monkeypatch.setattr(graph, "LEVELS", 3)
    monkeypatch.setattr(graph, "ROOT_SETS", 1)
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(110)] + [(100 + i, 101 + i) for i in range(9)]
    roots = [("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 100)]
    df, start = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(roots, "root_set string, node long")

    def plain(name):
        seen, todo = set(), [n for s, n in roots if s == name]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x]
        return {(name, x) for x in seen}

    want = plain("a") | plain("b")
    assert {tuple(r) for r in graph.reachable(df, start).collect()} == want
    nodes = spark.createDataFrame([(n,) for n in range(60)], "node long")
    assert {tuple(r) for r in graph.unreachable(nodes, df, start).collect()} == {(s, n) for s in "ab" for n in range(60)} - want


def test_deep_trees(spark, monkeypatch):
    tree = spark.createDataFrame([(i, i + 1) for i in range(12)], "node long, parent long")
    want = {(i, j, j - i) for i in range(12) for j in range(i + 1, 13)}
    assert {tuple(r) for r in graph.ancestors(tree).collect()} == want
    monkeypatch.setattr(graph, "DEPTH", 4)
    assert {tuple(r) for r in graph.ancestors(tree).collect()} == want


def test_reports_in_parts_equal_whole_ones(spark, tmp_path):
    rows = [(r, "error" if i % 3 else "warning", f"/p/{i % 7}.swift", i, 1 + i % 2, f"say \"{i}\" — é", None if i % 4 == 0 else f"note {i}", "high", f"{i:016x}") for i in range(40) for r in ("unused-type", "dead-store")]
    names = "rule string, severity string, path string, line int, column int, message string, note string, confidence string, fingerprint string"
    df = spark.createDataFrame(rows, names).repartition(4)
    whole = analysis.Report(df, df.limit(0), df).ordered()
    lines = {}
    for form in sinks.LINES:
        folder = str(tmp_path / form)
        manifest = sinks.write(df, folder, form).collect()
        found = []
        for m in sorted(manifest):
            with open(os.path.join(folder, "parts", m.part), encoding="utf-8") as f:
                own = f.read().splitlines()
            assert len(own) == m.rows
            found += own
        lines[form] = found
    assert "\n".join(lines["xcode"]) == sinks.as_text(whole)
    assert [json.loads(x) for x in lines["json"]] == json.loads(sinks.as_json(whole))["findings"]
    assert [json.loads(x) for x in lines["sarif"]] == json.loads(sinks.as_sarif(whole, []))["runs"][0]["results"]
    sinks.write_baseline(df, str(tmp_path / "baseline"))
    assert [r.value for r in spark.read.text(str(tmp_path / "baseline")).orderBy("value").collect()] == sorted({r.fingerprint for r in whole})
    assert sinks.write(df.limit(0), str(tmp_path / "none"), "json").count() == 0


def test_command_line_writes_parts(spark, tmp_path):
    (tmp_path / "a.swift").write_text("private func dead() {}\n")
    out = io.StringIO()
    assert cli.run(["analyze", str(tmp_path), "--strict", "--output", str(tmp_path / "report")], spark, out) == 1
    assert out.getvalue() == "" and spark.read.text(str(tmp_path / "report" / "parts")).first().value.endswith("function 'dead' is never used — confidence high")


def test_large_stored_tables_are_not_broadcast(spark, monkeypatch):
    """Their files are far smaller than their rows, so Spark's own guess would send them through the driver."""
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 3)
    table = lambda n, name: storage.stored(spark.range(n).select(F.col("id").alias("k"), F.lit("src/p.swift").alias(name)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    large, other, few = table(9, "a"), table(7, "b"), table(3, "c")
    for met, rows in ((large.join(other, "k"), 7), (large.select("k").distinct().join(other.where("k > 2"), "k", "left_anti"), 5)):
        assert "BroadcastHashJoin" not in plan(met) and met.count() == rows
    met = other.join(F.broadcast(few), "k")  # proven small
    assert "BroadcastHashJoin" in plan(met) and met.count() == 3


def test_a_large_set_of_reached_nodes_is_not_broadcast(spark, monkeypatch):
    plans, keep = [], storage.stored
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(graph, "LEVELS", 99)
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    found = graph.reachable(edges, spark.createDataFrame([("r", 0)], "root_set string, node long"))
    assert sorted(r.node for r in found.collect()) == list(range(7))
    assert ["LeftAnti" in p and "SortMergeJoin" in p for p in plans[2:]] == [False] * 3 + [True] * (len(plans) - 5) and len(plans) > 6
