"""Top-k search against sorting all scores."""

import random


from orderloom.llm import topk


def best(queries, candidates, k):
    usable = lambda rows: [(i, v) for i, v, *_ in rows if i is not None and v is not None and None not in v]
    asked = {}
    for i, v in usable(queries):
        asked[i] = min(asked.get(i, v), v)
    out = []
    for q, weights in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(weights, v)), i) for i, v in usable(candidates) if i != q)
        out += [(q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, queries, candidates, k):
    kind = "id bigint, vector array<bigint>, score string"
    frames = [spark.createDataFrame(r, kind) for r in (queries, candidates)]
    return sorted(map(tuple, topk.top_k(*frames, k).select("query_id", "rank", "vec_id", "score").collect()))


def test_ties_copies_nulls_and_short_vectors(spark):
    chance = random.Random(3)
    rows = [(i, [chance.choice([0, 0, 1, -2, 3]) for _ in range(6)], "x") for i in range(400)]
    rows += [(1000 + i, [1, 0, 1, 0, 0, 0], "x") for i in range(200)]
    rows += [(7, [9] * 6, "x"), (7, [9] * 6, "x"), (None, [1] * 6, "x"), (8000, None, "x"), (8001, [1, None], "x"), (8002, [5], "x"), (8003, [], "x")]
    asked = rows[:40] + rows[-7:]
    assert found(spark, asked, rows, 5) == best(asked, rows, 5)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    chance = random.Random(4)
    rows = [(i, [chance.randint(-9, 9) for _ in range(5)], "x") for i in range(150)]
    assert found(spark, rows[:30], rows, 3) == best(rows[:30], rows, 3)


def test_few_candidates_empty_tables_and_large_numbers(spark):
    rows = [(1, [2**62, 3], "x"), (2, [2**62, -5], "x"), (3, [-(2**62), 1], "x")]
    assert found(spark, rows, rows, 5) == best(rows, rows, 5)
    assert found(spark, rows, [], 5) == [] and found(spark, [], rows, 5) == []


def test_whole_numbers(spark):
    rows = [([0.5, -0.001],), ([float("nan")],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)]
    frame = spark.createDataFrame(rows, "embedding array<float>")
    values = [r[0] for r in frame.select(topk.whole_numbers("embedding", 256)).collect()]
    assert values == [[128, -1], None, None, None, None, []]
