import pytest

from quillwork.operators import regions

S, E = 90, 91
CASES = {
    "around": ([[0, 1, S, 3, 4, E, 0, 2]], None, None, [("passthrough", [0, 1]), ("region", [3, 4]), ("passthrough", [0, 2])]),
    "split": ([[0, S, 3], [4, E, 1]], None, None, [("passthrough", [0]), ("region", [3, 4]), ("passthrough", [1])]),
    "several": ([[0, S, 3, E, 1, S, 4, E, 2]], None, None, [("passthrough", [0]), ("region", [3]), ("passthrough", [1]), ("region", [4]), ("passthrough", [2])]),
    "empty": ([[S, E]], None, None, [("region", [])]),
    "empty_split": ([[5, S], [E, 6]], None, None, [("passthrough", [5]), ("region", []), ("passthrough", [6])]),
    "stray_end": ([[1, E, 2]], None, None, [("passthrough", [1, E, 2])]),
    "nested": ([[S, 1, S, 2, E]], None, None, [("nested_start", [S]), ("region", [1, 2])]),
    "truncated": ([[1, S, 2], [3]], None, "length", [("passthrough", [1]), ("truncated", [2, 3])]),
    "truncated_empty": ([[S]], None, "stop", [("truncated", [])]),
    "clean_end": ([[1, 2]], None, "stop", [("passthrough", [1, 2])]),
    "overflow": ([[S, 1, 2, 3, 4, E, 5, S, 6, E]], 2, None, [("overflow", [1, 2]), ("passthrough", [5]), ("region", [6])]),
    "overflow_truncated": ([[S, 1, 2, 3], [4]], 2, "length", [("overflow", [1, 2]), ("truncated", [1, 2])]),
    "exact_cap": ([[S, 1, 2, E]], 2, None, [("region", [1, 2])]),
    "cut_runs": ([[1, 2], [3, S, 4, E, 5]], None, None, [("passthrough", [1, 2]), ("passthrough", [3]), ("region", [4]), ("passthrough", [5])]),
}


@pytest.mark.parametrize("cap", [None, 2])
def test_cases(spark, cap):
    """All cases with one cap are streams of one table."""
    mine = {k: c for k, c in enumerate(CASES.values()) if c[1] == cap}
    tokens, ends = [], []
    for k, (feeds, _, reason, _) in mine.items():
        pos = 0
        for f, feed in enumerate(feeds):
            for i in feed:
                tokens.append((k, f, pos, i))
                pos += 1
        if reason:
            ends.append((k, pos, reason))
    t = spark.createDataFrame(tokens, "stream_id bigint, frame_seq bigint, pos bigint, id bigint")
    e = spark.createDataFrame(ends, "stream_id bigint, length bigint, finish_reason string")
    got = {k: [] for k in mine}
    for r in sorted(regions.watch(t, S, E, cap or regions.CAP, e).collect(), key=lambda r: (r.stream_id, r.at)):
        got[r.stream_id].append((r.kind, list(r.ids)))
        assert r.kind != "truncated" or r.finish_reason == mine[r.stream_id][2]
    assert got == {k: c[3] for k, c in mine.items()}


def test_markers_are_resolved():
    assert regions.resolve({"<a>": 1, "</a>": 2}, "<a>", "</a>") == (1, 2)
    for specials in ({"<a>": 1}, {"<a>": 1, "</a>": 1}):
        with pytest.raises(ValueError):
            regions.resolve(specials, "<a>", "</a>")
