import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillwork.llm import sharding


def minimax(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)

    def need(cap):
        n, full = 1, 0
        for s in sizes:
            n, full = (n, full + s) if full + s <= cap else (n + 1, s)
        return n

    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= shards else (mid + 1, hi)
    return lo


def check(rows, documents, **how):
    got = sharding.shard(documents(rows), **how).collect()
    assert len(got) == len(rows)
    slots, of_text, load = {}, {}, {}
    for r in got:
        assert r.size == (0 if r.text is None else len(r.text.encode())) + 1
        assert r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode()))
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < how.get("shards", 16)
        slots.setdefault(r.shard, []).append(r.slot)
        of_text.setdefault(r.text, set()).add(r.shard)
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    return got, load


def test_odd_rows(documents, odd_texts):
    got, _ = check(odd_texts, documents)
    assert {"lang", "source", "n_chars"} <= set(got[0].asDict())


def groups_of(got):
    """Sizes of the groups of equal texts, in the order of their places."""
    sizes = {}
    for r in got:
        sizes[r.place] = sizes.get(r.place, 0) + r.size
    return [sizes[p] for p in sorted(sizes)]


def capacity_is_minimal(documents, rows, shards, cells):
    _, load = check(rows, documents, shards=shards, cells=cells, rows_per_bucket=7)
    docs = documents(rows)
    sized = docs.select(sharding.place_of(docs.text).alias("place"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    capacity, cuts = sharding.plan(sized.withColumnRenamed("size", "load"), shards, cells)
    want = minimax(groups_of(sized.collect()), shards)
    assert capacity == want and max(load.values()) <= want and len(cuts) < shards


@pytest.mark.parametrize(("shards", "cells"), [(5, 64), (16, 8), (3, 2), (16, 4096)])
def test_capacity_is_the_smallest_over_groups(documents, shards, cells):
    rng = random.Random(shards)
    rows = [(i, "x" * rng.randrange(2000) + str(rng.randrange(200)), "a") for i in range(300)]
    capacity_is_minimal(documents, rows, shards, cells)


def test_capacity_with_large_groups(documents):
    rng = random.Random(2)
    rows = [(i, f"{rng.randrange(12)} " * rng.randrange(1, 4) * 200, "a") for i in range(200)] + [(500 + i, "hot " * 90, "a") for i in range(150)]
    capacity_is_minimal(documents, rows + [(900 + i, f"text {i}", "a") for i in range(300)] + [(None, None, "a")] * 40, 7, 16)


def test_search_of_bounds_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 5, 30, 200]) * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))]
        shards = rng.randrange(1, 9)
        cells, i = [], 0
        while i < len(sizes):  # runs of groups as cells
            n = rng.randrange(1, 6)
            cells.append(sharding.Cell(i, sum(sizes[i : i + n]), n == 1 or i + 1 >= len(sizes)))
            i += n
        low, high = sharding.capacity_bounds(cells, shards, -(-sum(sizes) // shards), sum(sizes))
        assert low <= minimax(sizes, shards) <= high
        solid = [sharding.Cell(i, x, True) for i, x in enumerate(sizes)]
        assert sharding.capacity_bounds(solid, shards, -(-sum(sizes) // shards), sum(sizes)) == (minimax(sizes, shards),) * 2


def test_a_group_above_the_fair_share_leaves_no_shard_empty(documents):
    rows = [(i, "hot " * 50, "a") for i in range(200)] + [(1000 + i, f"text number {i} " * 5, "b") for i in range(300)]
    _, load = check(rows, documents, shards=4, rows_per_bucket=16)
    assert len(load) == 4


def test_empty_and_ids(documents):
    assert sharding.shard(documents([])).collect() == []
    only = sharding.shard(documents([(1, "a", "s")]), keep=False)
    assert only.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert only.collect()[0].slot == 0


def test_many_equal_rows_and_rows_equal_but_for_a_column(documents):
    rows = [(1, "the same text", "a")] * 50 + [(1, "the same text", "b")] * 30 + [(None, None, None)] * 20 + [(i, f"t{i}", "a") for i in range(100, 140)]
    got, _ = check(rows, documents, shards=3, rows_per_bucket=4)
    assert sorted((r.doc_id or -1, r.text or "", r.source or "") for r in got) == sorted((i or -1, t or "", s or "") for i, t, s in rows)
    ids = sharding.shard(documents(rows), shards=3, rows_per_bucket=4, keep=False).collect()
    assert sorted(r.doc_id or -1 for r in ids) == sorted(i or -1 for i, _, _ in rows)
