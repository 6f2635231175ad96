import numpy as np
from pyspark.sql import functions as F

from quillwork.llm import topk


def brute(rows, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % 3 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("x") for c in ("v", "shard", "dim", "rank", "asks", "query_id")})
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, **how).select("query_id", "rank", "vec_id", "score").collect()}


def test_many_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 40)
    assert run(spark, rows, rows_per_shard=60) == brute(rows, 10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (9, [0.0, 0.0]), (12, []), (13, []), (7, [3.0, 3.0])]
    assert run(spark, rows, k=2) == brute(rows, 2)


def test_empty(spark):
    assert run(spark, []) == set()


def test_tree_bounds_are_tight():
    rng = np.random.default_rng(2)
    v = rng.integers(-500, 500, (1000, 4))
    tree = topk.KDTree(np.arange(1000), v, leaf=16)
    q = rng.integers(-500, 500, (5, 4))
    bounds = tree.bounds(q)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert (bounds[:, node] >= (v[rows] @ q.T).max(0)).all() and (tree.lows[node] == v[rows].min(0)).all()
    assert sum(len(r) for r in tree.rows if r is not None) == 1000


def test_components_too_large_are_refused_and_repeated_ids_ask_once(spark):
    import pytest
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(1, [1.0, float(1 << 17)]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(big, F.lit(True))
    same = spark.createDataFrame([(1, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [0.5, 1.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(same, F.col("vec_id") == 1).collect()]
    assert sorted(got) == [(1, 1, 2, 3 << 20), (1, 2, 3, 1 << 19)]
