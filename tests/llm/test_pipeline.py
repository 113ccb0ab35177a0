import corpus_pipeline as cp
from lintlake.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
    assert 4 <= len(cp.STAGES) <= 5


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF).collect()
    ids = [r["doc_id"] for r in out]
    assert 300 < len(ids) == len(set(ids)) < docs.count() and all(1 <= r["copies"] <= 2 for r in out)
    assert not any("AKIA" in r["text"] for r in out)
    texts = [r["text"] for r in out]
    assert len(texts) == len(set(texts))


def test_stages_on_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (None, "x y z", "en", "a", 5, 1), (3, "same text here and there", "en", "a", 24, 1),
            (3, "same text here and there", "en", "a", 24, 1), (4, "same text here and there", "en", None, 24, 1), (5, "key password=abcdefghijklmnop end", "en", "a", 3, 1),
            (6, " ".join(f"bench{i}" for i in range(30)) + " and more", "en", "a", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in cp.STAGES:
            before, now = now, stage(spark, now, str(tmp_path))
            assert name == "mixing" or now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), now.schema)
            if name == "near_dedup" and start is docs:
                # 1 and 2 are both empty; 3, its repeat and 4 are one text
                assert sorted(r["doc_id"] for r in now.collect() if r["doc_id"]) == [1, 3, 5, 6]
            if name == "decontamination" and start is docs:
                assert sorted(r["doc_id"] for r in now.collect() if r["doc_id"]) == [1, 3, 5]
            if name == "secrets" and start is docs:
                assert [r["text"] for r in now.collect() if r["doc_id"] == 5] == ["key [secret] end"]
