"""The pipeline's stages in a row on a small fixture."""

import corpus_pipeline
from tests.llm.conftest import prose


def test_stages(spark, tmp_path):
    item = prose(700, 40)
    near = prose(701, 80).split()
    rows = [(i, prose(2000 + i, 50) + (" scumbag moronic" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(300, " ".join(near)), (301, " ".join([*near[:79], "x"])), (302, item + " " + prose(5, 30)), (303, "write to ann.lee@mail.example.com " + prose(6, 30)), (304, None), (305, ""), (306, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in now.collect()})
    clean = {i for i, _ in rows if i >= 300 or i % 4}
    assert seen[0] == clean
    assert seen[1] == clean - {301, 305, 306}  # null and empty texts are copies
    assert seen[2] == seen[1] - {302} and seen[3] == seen[2]
    assert "ann.lee@" not in now.where("doc_id = 303").first().text
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3]
