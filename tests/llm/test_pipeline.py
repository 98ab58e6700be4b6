import corpus_pipeline
from trialspan.llm import _store, decontaminate, neardup, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name != "source_mixing":
            assert after.columns == columns
        ids = {r[0] for r in before.select("doc_id").collect()}
        kept = {r[0] for r in after.select("doc_id").collect()}
        assert kept <= ids and after.count() == len(kept)
        if name == "near_dedup":
            out = neardup.near_duplicates(before, percent=80)
            assert kept == {r.doc_id for r in out.where("kept").collect()}
        if name == "decontamination":
            found = decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert ids - kept == {r.doc_id for r in found.collect()}
        if name == "pii_masking":
            assert kept == ids and pii.extract(after).where("n_email + n_ip + n_card > 0").count() == 0
        before = after
    assert before.columns == [*columns, "mix_rate"]


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    before = _store.standing()
    out = corpus_pipeline.run(spark, SF)
    assert _store.standing() - before == {out._trialspan_path}  # what the stages wrote on the way is gone
    assert sorted(map(tuple, out.select("doc_id", "text", "mix_rate").collect())) == sorted(map(tuple, docs.select("doc_id", "text", "mix_rate").collect()))


def test_odd_rows(spark, odd, odd_rows, empty):
    for rows in (odd, empty):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
            docs.count()
        assert docs.columns == [*odd.columns, "mix_rate"]
