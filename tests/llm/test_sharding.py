"""Shards of equal size whose mixture is that of the whole."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderloom.llm import sharding

KINDS = "doc_id bigint, text string, source string, shard string, s string"


def check(rows, n, placed):
    sizes = Counter(r["shard"] for r in placed)
    counts = [sizes.get(i, 0) for i in range(n)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for i in range(n):
        assert sorted(r["slot"] for r in placed if r["shard"] == i) == list(range(counts[i]))
    expected = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for k, t, s, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["source"]) for r in placed) == expected


def test_hot_source_nulls_copies(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 7}", "x", "y") for i in range(700)]
    rows += [(None, None, None, "x", "y")] * 150 + [(5, "é🙂", "", "x", "y")] * 150
    placed = sharding.shard(spark.createDataFrame(rows, KINDS), 8).collect()
    check(rows, 8, placed)
    whole = Counter(r[2] for r in rows)
    for i in range(8):
        mixture = Counter(r["source"] for r in placed if r["shard"] == i)
        assert all(abs(mixture.get(s, 0) - n / 8) <= 2 for s, n in whole.items())


@pytest.mark.parametrize("n_rows", [0, 1, 5])
def test_few_rows(spark, n_rows):
    rows = [(i, "t", "a", "x", "y") for i in range(n_rows)]
    check(rows, 16, sharding.shard(spark.createDataFrame(rows, KINDS), 16).collect())


def test_seed_changes_the_order_and_partitions_do_not(spark):
    documents = spark.createDataFrame([(i, f"t{i}", "a", "x", "y") for i in range(200)], KINDS)
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(documents, 4).collect()}
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(documents.repartition(7), 4).collect()}
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(documents, 4, seed=3).collect()}
    assert first == again != other


def test_no_python_in_the_plan(spark):
    documents = spark.createDataFrame([(1, "t", "a", "x", "y")], KINDS).where(F.col("doc_id") > 0)
    plan = sharding.shard(documents, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        sharding.shard(documents, 0)


def test_sources_of_one_row_spread(spark):
    """A tenth of the rows have a source of their own: every shard gets some, as many as chance gives it."""
    rows = [(i, f"text {i}", f"own{i}" if i % 10 == 0 else f"s{i % 3}", "x", "y") for i in range(4_000)]
    placed = sharding.shard(spark.createDataFrame(rows, KINDS), 16).collect()
    check(rows, 16, placed)
    own = Counter(r["shard"] for r in placed if r["source"].startswith("own"))
    # 25 on average, with a standard deviation of 4.8.
    assert len(own) == 16 and all(8 <= n <= 45 for n in own.values())
    for source in ("s0", "s1", "s2"):
        counts = [sum(r["shard"] == i and r["source"] == source for r in placed) for i in range(16)]
        assert max(counts) - min(counts) <= 30
