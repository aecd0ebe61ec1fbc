import pytest

import corpus_pipeline
from chronofold.llm import neardup, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_are_the_operators_applied_in_turn(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    raw = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r["doc_id"] for r in docs.collect()}
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        kept = {r["doc_id"] for r in after.collect()}
        if name == "quality classifier":
            want = {r["doc_id"] for r in quality_classifier.score_documents(docs, quality_classifier.train(raw, labels)).where("predicted = 1").collect()}
        elif name == "quality rules":
            want = {r["doc_id"] for r in quality_rules.judge_documents(docs, quality_rules.train(raw, labels)).where("kept").collect()}
        else:
            want = {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").collect()}
        assert kept == want < before, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    left = {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == left
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == left


@pytest.mark.parametrize("stage", range(4))
def test_empty_input(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with the names that stages use inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'en'").orderBy("doc_id")
    one = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    text = good.where(good.doc_id.isin(*sorted(one))).first()["text"]
    long = " ".join(f"{w}{i % 97}" if i % 9 == 0 else w for i, w in enumerate((text + " ") .split() * 200))
    rows = [(1, text), (1, text), (2, text), (2, text + " and then another end of it"), (None, text), (None, None), (3, None), (4, ""), (5, " \n "), (6, "few words"), (7, long)]
    clash = spark.createDataFrame([(d, t, "en", "s", len(t or ""), True, 0.5, 1, "r", 7, -1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, part int, region string, _row long, component_id int")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda d: -1 if d is None else d)
    got = clash
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, got, SF)
        assert out.columns == clash.columns, name
        got = spark.createDataFrame(out.collect(), out.schema)
        if name == "quality rules":
            assert not {3, 4, 5, 6} & set(ids(got)) and ids(got).count(1) == 2
    assert ids(got).count(1) == 1 and 2 not in ids(got) and ids(got).count(None) == 1
    packed = corpus_pipeline.STAGES[3][1](spark, got, SF)
    assert set(ids(packed)) == set(ids(got))
    whole = corpus_pipeline.STAGES[3][1](spark, clash, SF).collect()
    assert sum(r["length"] for r in whole if r["doc_id"] in (3, 4)) == 2
    apart = corpus_pipeline.STAGES[2][1](spark, clash, SF)
    assert ids(apart).count(None) == 2 and {3, 4, 5, 6, 7} <= set(ids(apart))
