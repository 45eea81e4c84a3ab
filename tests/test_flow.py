import io

from taproot import cli
from taproot.frontend import cfg
from taproot.plans import control_flow
from taproot.sources import files

BRANCHES = [
    ("if false { a() }", [(1, "then")]),
    ("if true { a() } else { b() }", [(1, "else")]),
    ("let debug = false\nif debug { a() }\nb()", [(2, "then")]),
    ("var on = false\non = true\nif on { a() }", []),
    ("var on = false\nrun { on = true }\nif on { a() }", []),
    ("var on = false\nset(&on)\nif on { a() }", []),
    ("while true { if x { break } }", []),
    ("while false { a() }", [(1, "then")]),
    ("repeat { a() } while false", [(1, "then")]),
    ("guard true else { return }\na()", [(1, "else")]),
    ("var ok = true\ndo { try a() } catch { ok = false }\nif ok { b() } else { c() }", []),
    ("if !false { a() } else { b() }", [(1, "else")]),
    ("let n = 2\nlet m = n * 3\nif m == 6 { a() } else { b() }", [(3, "else")]),
    ("var x = 1\nif false { x = 2 }\nif x == 1 { a() } else { b() }", [(2, "then"), (3, "else")]),
    ("var i = 0\nwhile i < 3 { i = i + 1 }\nif i == 0 { a() }", []),
    ("if given { a() } else { b() }", []),
    ("if let x = y { a() }", []),
]
STORES = [
    ("var x = 1\nx = 2\nuse(x)", [(1, "x")]),
    ("var x = 1\nif c { x = 2 }\nuse(x)", []),
    ("var x = 0\nwhile x < 3 { x += 1 }", []),
    ("let y = 1\nreturn", []),  # a last value is an unused variable, no dead store
    ("var x = 1\nlater { x = 2 }", []),
    ("var n = 1\nswitch k {\ncase 1:\n  n = 2\n  fallthrough\ncase 2:\n  use(n)\ndefault:\n  n = 3\n}\nn = 4\nuse(n)", [(9, "n")]),
    ("var a = 1\nif c { a = 2 } else { a = 3 }\nuse(a)", [(1, "a")]),
]


def bodies(spark, cases):
    rows = [(str(i), [{"fn": 1, "function": "f"} | r for r in cfg.rows(cfg.of_source(body))]) for i, (body, _) in enumerate(cases)]
    return control_flow.bodies(spark.createDataFrame(rows, f"path string, flow array<{files.FLOW}>"))


def test_dead_branches(spark):
    got = control_flow.dead_branches(bodies(spark, BRANCHES)).collect()
    for i, (body, want) in enumerate(BRANCHES):
        assert sorted((r.line, r.what.split()[0]) for r in got if r.path == str(i)) == want, body


def test_dead_stores(spark):
    got = control_flow.dead_stores(bodies(spark, STORES)).collect()
    for i, (body, want) in enumerate(STORES):
        assert sorted((r.line, r.what) for r in got if r.path == str(i)) == want, body


def test_a_file_that_grows_is_no_whole_file(spark, tmp_path, monkeypatch):
    (tmp_path / "a.swift").write_text("x" * 50)
    assert files.MOST_BYTES == 10 << 20
    import pandas as pd

    monkeypatch.setattr(files, "MOST_BYTES", 20)
    monkeypatch.setattr(files.os.path, "getsize", lambda p: 10)
    got = next(files.load(iter([pd.DataFrame({"path": [str(tmp_path / "a.swift")]})])))
    assert got.source[0] is None and "larger" in got.error[0]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.swift").write_text("private func dead() {}\n@main struct A { static func main() {} }\n")
    (tmp_path / "c.json").write_text('{"rules": {"unused-function": {"severity": "error"}}}')
    (tmp_path / "bad.json").write_text('{"rules": {"nonsense": {}}}')
    out = io.StringIO()
    assert cli.run(["analyze", str(tmp_path), "--config", str(tmp_path / "c.json"), "--write-baseline", str(tmp_path / "b.json")], spark, out) == 1
    assert "error: [unused-function] function 'dead'" in out.getvalue()
    assert cli.run(["analyze", str(tmp_path), "--strict", "--baseline", str(tmp_path / "b.json")], spark, io.StringIO()) == 0
    assert cli.run(["analyze", str(tmp_path), "--config", str(tmp_path / "bad.json")], spark, out) == 78
    assert cli.run(["analyze", str(tmp_path / "gone")], spark, out) == 64 and cli.run(["nonsense"], spark, out) == 64
    assert cli.run(["rules", "dead-store"], out=out) == 0
