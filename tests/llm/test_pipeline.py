"""The stages against what their operators say, one by one, and on a table without rows."""

import corpus_pipeline
from kwforge.llm import minhash_dedup, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs, out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == start.columns
        docs = out
    before, after = seen["quality_rules"]
    ok = {r.doc_id for r in before.collect() if not quality_rules.base_rule(quality_rules.text_counts(t := quality_rules.Text(r.text))) and quality_rules.first_rejection(t, quality_rules.RULES) is None}
    assert {r.doc_id for r in after.collect()} == ok
    before, after = seen["minhash_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minhash_dedup.near_duplicates(before).filter("kept").collect()}
    before, after = seen["secret_scan"]
    assert before.count() == after.count() and after.filter("text rlike 'token = .[0-9a-f]{40}'").count() == 0
    packed = seen["best_fit_packing"][1]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in after.collect()}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if name != corpus_pipeline.STAGES[-1][0] else docs


def test_near_dedup_by_text(spark, tmp_path):
    """One row of each text stays: under other ids, repeated, without an id, beside other texts of an id; rows without a text stay."""
    copy, own, lost = "one two three four five six seven eight", "other words that no other row of this table has at all", "a text that rows without an id alone have"
    rows = [(1, copy), (1, copy), (1, copy), (2, copy), (3, copy), (3, own), (None, copy), (4, None), (4, None), (5, copy), (None, lost), (None, lost), (6, own)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = corpus_pipeline.near_dedup_stage(spark, df, SF)
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == df.columns and kept == sorted([(1, copy), (3, own), (None, lost), (4, None), (4, None)], key=str)
