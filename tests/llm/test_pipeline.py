import corpus_pipeline
from conftest_llm import rows_of
from pyspark.sql import functions as F

from oscilla.llm import decontam, minhash, mixing, ranker, secrets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secret_scan", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, benchmark = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet")
    before = docs
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, SF)
        assert before.columns == columns
        kept.append(before)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4]
    accepted = {k for k, v in rows_of(ranker.op10(docs, spark.read.parquet(f"{SF}/labels.parquet"))).items() if v[2]}
    assert ids[1] == accepted
    assert minhash.near_duplicates(kept[2]).filter("doc_id <> component_id").count() == 0
    assert decontam.op9(kept[3], benchmark).filter("contaminated").count() == 0
    assert secrets.scan(kept[4]).filter("spans <> ''").count() == 0
    same = {r.doc_id: r.text for r in kept[3].collect()}
    clean = [k for k, v in rows_of(secrets.scan(kept[3])).items() if not v[4]]
    after = {r.doc_id: r.text for r in kept[4].collect()}
    assert len(clean) > 100 and all(after[k] == same[k] for k in clean)


def test_run_is_the_mix_of_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    plan = mixing.mix_plan(docs).selectExpr("row.doc_id", "copies").filter("copies > 0")
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in plan.collect()}


def test_empty_and_clashing_tables(spark, docs):
    df = docs([(1, "some plain text of a few words"), (2, None), (None, "")])
    for rows in (df, df.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == df.columns
        mixed = corpus_pipeline.mix(spark, rows, SF)
        assert mixed.columns == [*df.columns, "copy_"]  # the table has a column copy of its own
        words = sum(len((r.text or "").split()) * r.n for r in mixed.groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect())
        assert words <= 2 * sum(len((r.text or "").split()) for r in rows.collect())


def test_mix_of_special_rows(spark, docs):
    """Null and empty texts, null and repeated ids, a source without words, a very long text."""
    df = docs([(1, "one two three four", "a"), (1, "one two three four", "a"), (None, "five six", "b"), (2, None, "c"), (3, "", None), (4, "word " * 100_000, "b")])
    mixed = corpus_pipeline.mix(spark, df, SF)
    taken = {(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert taken and all(n <= (4 if key == (1, "a") else 2) for key, n in taken.items()) and (4, "b") in taken
    assert {r.copy_ for r in mixed.select("copy_").distinct().collect()} <= {1, 2}
