"""The pipeline's stages in turn on the smallest table."""

import corpus_pipeline


def test_stages_keep_columns_and_shrink(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = [r.doc_id for r in out.select("doc_id").collect()]
        assert rows and set(rows) <= ids and (name == "mix_sources" or len(rows) <= docs.count())
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = set(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == ids
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
