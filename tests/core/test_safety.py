from quillwork import catalog


def test_collisions_of_parts_with_large_keys(spark, tmp_path):
    spark.createDataFrame([(1, "low"), (2000, "single"), (2001, "high"), (10**9, "highest")], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1), (1, 2), (2000, 1), (2000, 6), (2001, 3), (2001, 4), (10**9, 1), (10**9, 2)]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["tool_collisions"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("high", 2, "s3,s4"), ("highest", 2, "s1,s2"), ("low", 2, "s1,s2")]
