import json

import pytest

from taproot.operators import similarity
from taproot.plans.analysis import RULES, Configuration, analyze, with_similarity_notes
from taproot.sources import files, sinks

MAIN = """import Foundation

private func forgotten() {}
func helper() -> Greeter { Greeter() }
private func kept() {} // @tr:accept unused-function -- loaded by name
struct Greeter: Speaker {
    func speak() { print("hello \\(name)") }
    let name = "x"
    private var spare = 1
}
protocol Speaker { func speak() }
final class Orphan {
    func inner() { helperOfOrphan() }
}
enum Mode { case on, off }
func choose(_ m: Mode) -> Bool { m == .on }
@main struct Program {
    static func main() { helper().run(); _ = choose(.on) }
}
extension Greeter { func run() { let s: Speaker = self; s.speak() } }
"""
TESTS = """import XCTest
final class HelperTests: XCTestCase {
    func testIt() { onlyTested() }
}
"""
ONLY = "func onlyTested() {}\nfunc byString() {}\nlet names = [\"byString\"]\n"


def names(report):
    return {(r.rule, r.message.split("'")[1]) for r in report.ordered()}


def test_corpus(spark):
    sources = files.in_memory(spark, [("/p/main.swift", MAIN), ("/p/Tests/HelperTests.swift", TESTS), ("/p/only.swift", ONLY)])
    report = analyze(spark, sources)
    assert names(report) == {("unused-function", "forgotten"), ("unused-property", "spare"), ("unused-type", "Orphan"), ("unused-enum-case", "off"), ("unused-function", "byString"), ("unused-property", "names")}
    assert {r.message.split("'")[1] for r in report.suppressed.collect()} == {"kept"}
    notes = {r.message.split("'")[1]: r.note for r in report.ordered()}
    assert notes["forgotten"] == "confidence high" and notes["byString"].startswith("confidence low")
    production = names(analyze(spark, sources, Configuration(production=True)))
    assert ("only-tested", "onlyTested") in production and ("unused-function", "forgotten") in production


def test_single_file_and_reports(spark):
    sources = files.in_memory(spark, [("a.swift", "private func dead() {}\nfunc seen() {}\nprivate func used() {}\nfunc f() { used() }\n")])
    rows = analyze(spark, sources, Configuration(single_file=True)).ordered()
    assert sinks.as_text(rows) == "a.swift:1:14: warning: [unused-function] function 'dead' is never used in this file — confidence high"
    assert json.loads(sinks.as_json(rows))["findings"][0]["line"] == 1
    assert json.loads(sinks.as_sarif(rows, RULES))["runs"][0]["results"][0]["ruleId"] == "unused-function"
    assert sinks.read_baseline(sinks.baseline(rows)) == {rows[0].fingerprint}
    assert sinks.exit_status(rows) == 0 and sinks.exit_status(rows, strict=True) == 1


def test_flow_and_opt_in_rules(spark):
    source = "import Foundation\nimport Kit\n@main struct A {\n    var total = 0\n    static func main() {\n        if false { go() }\n        var x = 1\n        x = 2\n        print(x, Kit.self)\n        total = 3\n    }\n}\n"
    rows = files.in_memory(spark, [("a.swift", source)])
    assert {(r.rule, r.line) for r in analyze(spark, rows).ordered()} == {("dead-branch", 6)}
    on = Configuration(rules={r: {"enabled": True} for r in ("unused-import", "assign-only-property", "dead-store")})
    assert {(r.rule, r.line) for r in analyze(spark, rows, on).ordered()} == {("dead-branch", 6), ("dead-store", 7), ("unused-import", 1), ("assign-only-property", 4)}


def test_what_outside_code_calls(spark):
    source = """@main struct A { static func main() { _ = K(); _ = V(); _ = E.one } }
struct K: Hashable {
    func hash(into h: inout Hasher) {}
    func other() {}
}
class V: UnknownView {
    func layout() {}
    private func lost() {}
}
enum E: String, CaseIterable { case one }
extension K: CustomStringConvertible { var description: String { "" } }
"""
    got = names(analyze(spark, files.in_memory(spark, [("a.swift", source)])))
    assert got == {("unused-function", "lost"), ("unused-function", "other")}


def test_files(spark, tmp_path):
    (tmp_path / "a.swift").write_text("func f() {}\n")
    (tmp_path / ".build").mkdir()
    (tmp_path / ".build" / "b.swift").write_text("func g() {}\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "c.swift").write_text('let x = "open\n')
    found = files.discover([str(tmp_path)])
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.swift", "c.swift"] and files.discover([str(tmp_path)], ["**/skip/*"]) == found[:1]
    report = analyze(spark, files.read(spark, [*found, str(tmp_path / "gone.swift")]))
    assert {r.path.rsplit("/", 1)[1] for r in report.degraded.collect()} == {"c.swift", "gone.swift"}


ROOTS = """import Foundation
@main struct Program { static func main() { _ = Kept(); touch() } }
struct Kept: Codable { var stored = 1; private var hidden = 2; func unusedHelper() {} }
enum Raw: String { case first, second }
enum Plain { case lonely }
enum Later { case late }
extension Later: CaseIterable {}
@resultBuilder struct Builder { static func buildBlock(_ x: Int) -> Int { x } }
final class Screen { @State private var shown = false; @Environment(\\.locale) var locale; var lost = 1 }
func touch() { _ = Plain.self; _ = Raw.self; _ = Later.self; _ = Screen(); _ = Builder(); _ = Derived(); _ = Value() }
@objc class Exported: NSObject { }
class Base: NSObject { func quiet() {} }
final class Derived: Base { private func quieter() {}; @objc func loud() {} }
struct Value { private func silent() {} }
// @tr:disable unused-function
private func hushed() {}
// @tr:enable unused-function
private func heard() {}
"""


def test_members_used_from_outside_are_roots(spark):
    from taproot.plans.analysis import member_roots

    decls = files.declarations(files.facts(files.in_memory(spark, [("R.swift", ROOTS)])))
    got = {(r["name"], r.outer) for r in decls.join(member_roots(decls), "decl").select("name", "outer").collect()}
    assert {("stored", "coding"), ("hidden", "coding"), ("first", "constructed case"), ("second", "constructed case"), ("late", "constructed case"), ("buildBlock", "result builder")} <= got
    assert not {"lonely", "unusedHelper", "lost", "silent", "shown"} & {n for n, _ in got}
    assert ("quiet", "external witness") in got


def test_wrapped_properties_runtime_members_regions_and_the_floor(spark):
    sources = files.in_memory(spark, [("R.swift", ROOTS)])
    report = analyze(spark, sources)
    found = {r.message.split("'")[1]: r.confidence for r in report.findings.collect()}
    assert not {"shown", "locale", "hushed", "stored", "main"} & set(found)
    assert found["heard"] == "high" and found["lost"] == "medium"
    # Private members of a class that descends from NSObject lose one step; those of a plain type don't.
    assert found["quieter"] == "medium" and found["silent"] == "high"
    assert {r.message.split("'")[1] for r in report.suppressed.collect()} == {"hushed"}
    high = analyze(spark, sources, Configuration(minimum_confidence="high"))
    assert {r.confidence for r in high.findings.collect()} == {"high"}


PLATFORM = """
struct Ask: AppEntity { var title = 1 }
struct Find: EntityQuery {}
struct Plain: SomethingElse {}
struct Ages: AsyncSequence { func makeAsyncIterator() -> Int { 1 }; func other() {} }
struct Keys: EnvironmentKey { static let defaultValue = 1; static let spare = 2 }
@main struct M { static func main() { _ = Ages(); _ = Keys(); _ = Hidden(); _ = Known() } }
struct Hidden {}
public struct Known {}
extension Hidden { public func shown() {} }
extension Known { public func offered() {} }
"""


def test_what_the_platform_makes_and_what_extensions_show(spark):
    got = names(analyze(spark, files.in_memory(spark, [("/p/a.swift", PLATFORM)])))
    assert got == {("unused-type", "Plain"), ("unused-function", "other"), ("unused-property", "spare"), ("unused-function", "shown")}


SCOPED = """
class Base: XCTestCase {}

class Middle: Base { struct Inner { func deep() { onlyDeep() } } }

extension Middle { func more() { onlyMore() } }

@Suite struct S { func check() { onlySuite() } }
let gap = 1  // a declaration begins where the one before ends
@main struct M { static func main() { used() } }
"""


def test_test_scope_descends(spark):
    helpers = "".join(f"func {n}() {{}}\n" for n in ("onlyDeep", "onlyMore", "onlySuite", "used"))
    sources = files.in_memory(spark, [("/p/cases.swift", SCOPED), ("/p/helpers.swift", helpers)])
    got = names(analyze(spark, sources, Configuration(production=True)))
    assert {x for x in got if x[0] == "only-tested"} == {("only-tested", n) for n in ("onlyDeep", "onlyMore", "onlySuite")}


def _cosine_notes(snippets):
    """Percent by brute force: 1 - the mean cosine with the five nearest others, from counts of hashed n-grams."""
    import numpy as np

    def vector(s):
        v = np.zeros(128)
        for i in range(len(s) - 2):
            h = 14695981039346656037
            for b in s[i : i + 3].encode():
                h = (h ^ b) * 1099511628211 % 2**64
            v[h % 128] += 1
        return v / (np.linalg.norm(v) or 1)

    vs = [vector(s) for s in snippets]
    near = [sorted((float(v @ w) for j, w in enumerate(vs) if j != i), reverse=True)[:5] for i, v in enumerate(vs)]
    return [f"embedding-confidence: {int(max(0, min(1, 1 - sum(n) / len(n))) * 100 + 0.5)}% anomaly [experimental, character n-grams]" for n in near]


def test_similarity_notes(spark):
    long_ = "func long() {\n" + "".join(f"    print({i})\n" for i in range(60)) + "}"
    parts = ["func a() { print(1) }", "func b() { print(2) }", "func größe() { print(3) }", long_, "struct Odd { let z: [String: Int] = [:] }"]
    sources = files.in_memory(spark, [("/p/a.swift", "\n".join(parts) + "\n"), ("/p/b.swift", "@main struct M { static func main() {\nif false { go() }\n} }\n")])
    plain = analyze(spark, sources)
    report = analyze(spark, sources, Configuration(similarity="exact"))
    key = lambda r: (r.path, r.line, r.column, r.rule, r.severity, r.message, r.confidence, r.fingerprint)
    before, after = plain.ordered(), report.ordered()
    assert [key(r) for r in before] == [key(r) for r in after] and len(after) == 6
    cut = "\n".join(long_.split("\n")[:41])
    want = _cosine_notes([*parts[:3], cut, parts[4], "if false { go() }"])
    assert [r.note for r in after] == [f"{b.note}; {w}" if b.note else w for b, w in zip(before, want, strict=True)]
    assert "similarity noted on 6 findings by character n-grams" in report.notes


def test_similarity_needs_two_findings(spark):
    found = spark.createDataFrame([("a.swift", 1, 6, "unused-function", "m", None)], "path string, line int, column int, rule string, message string, note string")
    decls = spark.createDataFrame([("a.swift", 1, 6, 1)], "path string, line int, column int, last_line int")
    sources = files.in_memory(spark, [("a.swift", "func lone() {}\n")])
    for rows, how in ((found, "exact"), (found.limit(0), "index"), (found.union(found), "exact")):
        notes = []
        got = with_similarity_notes(rows, decls, sources, how, notes)
        assert got.columns == found.columns and got.collect() == rows.collect() and "more than one" in notes[0]
    # A finding outside its file's lines, of a file without a source, or of code shorter than an n-gram has no likeness to any.
    odd = found.union(spark.createDataFrame([("a.swift", 9, 1, "r", "m", "n"), ("gone.swift", 1, 1, "r", "m", "n")], found.schema))
    assert {(r.path, r.line, r.note) for r in with_similarity_notes(odd, decls, sources, "exact", []).collect()} == {
        (p, n, f"{more}embedding-confidence: 100% anomaly [experimental, character n-grams]") for p, n, more in (("a.swift", 1, ""), ("a.swift", 9, "n; "), ("gone.swift", 1, "n; "))
    }
    with pytest.raises(ValueError):
        with_similarity_notes(found, decls, sources, "both", [])


def test_similarity_notes_copy_no_vector_per_block(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 2)
    names = [f"func f{i}() {{ print({i * i}) }}" for i in range(7)]
    found = spark.createDataFrame([("a.swift", i + 1, 6, "unused-function", f"m{i}", None) for i in range(7)], "path string, line int, column int, rule string, message string, note string")
    decls = spark.createDataFrame([("a.swift", i + 1, 6, i + 1) for i in range(7)], "path string, line int, column int, last_line int")
    got = with_similarity_notes(found, decls, files.in_memory(spark, [("a.swift", "\n".join(names) + "\n")]), "exact", [])
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.note for r in got.orderBy("line").collect()] == _cosine_notes(names)
