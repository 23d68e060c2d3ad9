import corpus_pipeline


def test_stages_keep_their_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name.replace(' ', '-')}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        n = docs.count()
        assert 0.5 * left < n <= left, name
        left = n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
