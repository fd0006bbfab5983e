"""The registered queries and the pipeline at the smallest size."""

import pytest
from compare import assert_same, connect

import corpus_pipeline
from tallymill.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert_same(df, connect(SF), queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_held_out_languages(spark):
    out = queries.op10_language_mix(spark, SF)
    truth = queries.table(spark, SF, "documents").select("doc_id", "lang")
    held = out.where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0 < docs.count() <= seen, name
        seen = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    con = connect(SF)
    before.createOrReplaceTempView("mixed")
    con.register("mixed", before.toArrow())
    assert_same(docs, con, sql.mix_sql("mixed"))


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
