"""The pipeline's stages one by one on hard inputs."""

import corpus_pipeline as pipeline


def test_stages(spark, docs, empty, tmp_path):
    columns, seen = docs.columns, {}
    for source, name in ((docs, "docs"), (empty, "empty")):
        df = source
        for stage, f in pipeline.STAGES:
            out = str(tmp_path / name / stage)
            f(spark, df, "").write.parquet(out)
            df = spark.read.parquet(out)
            if stage != "packing":
                assert df.columns == columns
            seen[name, stage] = df.collect()
    assert not any(seen["empty", s] for s, _ in pipeline.STAGES)
    assert {r["doc_id"] for r in seen["docs", "language"]}.isdisjoint({3, 4, 5})
    kept = [r["doc_id"] for r in seen["docs", "near_dedup"]]
    assert 0 in kept and 1 not in kept and kept.count(7) == 1
    assert all("abcdef0123456789" not in r["text"] for r in seen["docs", "secrets"])
    assert {r["doc_id"] for r in seen["docs", "packing"]} == {r["doc_id"] for r in seen["docs", "secrets"]}


def test_language_hands_each_text_to_python_once(spark, docs):
    found = pipeline.identify_language(spark, docs, "")
    assert found.schema == docs.schema
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "struct(" not in plan.split("MapInArrow")[1]
