from taproot.sources import files
from taproot.streaming.watch import watch


def test_new_files_are_read_once(spark, tmp_path):
    (tmp_path / "src").mkdir()
    run = lambda: watch(spark, str(tmp_path / "src"), str(tmp_path / "facts"), str(tmp_path / "state"), once=True).awaitTermination()
    (tmp_path / "src" / "a.swift").write_text("func f() {}\n")
    run()
    (tmp_path / "src" / "b.swift").write_text("func g() {}\nfunc h() {}\n")
    run()
    run()
    got = files.declarations(spark.read.parquet(str(tmp_path / "facts")))
    assert sorted(r.name for r in got.collect()) == ["f", "g", "h"]
