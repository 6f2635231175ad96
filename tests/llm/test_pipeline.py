from pyspark.sql import functions as F

import corpus_pipeline
from quillwork.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, columns = docs, docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]
    assert {"shard", "slot", "text"} <= set(docs.columns)
    assert docs.join(first, ["doc_id", "text"], "left_anti").count() == 0
    slots = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.m == r.n - 1 for r in slots)


def test_one_query_for_each_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in queries())
    assert names == list(range(1, 11)) and set(oracle_sql()) <= set(queries())
