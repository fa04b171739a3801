"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.llm import resampling
from orderloom.llm.queries import QUERIES

KINDS = "doc_id bigint, text string, rank string, score int, `a.b` string, part string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, order=1):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def expected(rows, target, order=1, percent=10, least=20):
    """Rows (key, n_features, weight, score) in drawn order, and the others."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    source = Counter(bucket(f) for _, text in rows for f in features_of(text, order))
    wanted = Counter(bucket(f) for text in target for f in features_of(text, order))
    all_s, all_t = sum(source.values()), sum(wanted.values())
    found = []
    for key, text in rows:
        own = [bucket(f) for f in features_of(text, order)]
        weight = sum(
            math.floor(1000 * math.log((wanted[b] + 1) * float(all_s + 10_000) / ((source[b] + 1) * float(all_t + 10_000)))) for b in own
        )
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append((len(words_of(text)) >= least, (key, len(own), weight, score)))
    able = sorted((f for long, f in found if long), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    n = percent * len(able) // 100
    return Counter([(*f, i + 1) for i, f in enumerate(able[:n])] + [(*f, None) for f in able[n:]] + [(*f, None) for long, f in found if not long])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 é-\n🙂\x00", max_size=90), max_size=30), st.integers(1, 5))
def test_crcs_of_runs(parts, order):
    text = "x".join(parts * 3)
    found, n_words = resampling.Features(order).crcs(text)
    words = words_of(text)
    assert n_words == len(words)
    for n, crcs in enumerate(found, 1):
        assert crcs.tolist() == [zlib.crc32(" ".join(words[i : i + n]).encode()) for i in range(len(words) - n + 1)]


def test_crcs_of_long_words():
    words = ["a" * n for n in (1, 63, 64, 65, 127, 128, 5_000, 300_000)]
    found, _ = resampling.Features(3).crcs(" ".join(words))
    assert found[2].tolist() == [zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(6)]


LONG = " ".join(f"Word{i % 37} é{i % 11}" for i in range(40))


@pytest.mark.parametrize("order", [1, 2])
def test_against_python(spark, order):
    rows = [(i, f"{LONG} own{i % 13} " * (1 + i % 3)) for i in range(150)]
    rows += [(None, None), (7, ""), (500, "two words"), (501, "--- ..."), (None, LONG), (None, LONG + " more"), (3, LONG)]
    rows += [(900, LONG)] * 120 + [(None, LONG)] * 60  # one key and one text hold a third each
    target = ["own1 own2 own3 " * 20, None, "", "é3 é4 Word5"]
    table = spark.createDataFrame([(k, t, "r", 1, "x", "p") for k, t in rows], KINDS)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    found = resampling.resample(table, wanted, order=order).collect()
    assert Counter(tuple(r) for r in found) == expected(rows, target, order)


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, LONG, "r", 1, "x", "p")] * 20, KINDS)
    none = table.limit(0)
    assert resampling.resample(none, table).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(table, none).collect()) == expected([(1, LONG)] * 20, [])


def test_ranks_are_whole(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("k"), F.lit(1).alias("n_features"), F.lit(1).alias("weight"), (F.col("id") % 7).alias("score"), F.lit(0).alias("part")
    )
    found = resampling.ranked(rows, ["k", "n_features", "weight", "score", "part"]).toPandas().sort_values("rank")
    assert found["rank"].tolist() == list(range(1, 20_001))
    keys = list(zip(-found["score"], found["k"]))
    assert keys == sorted(keys)


def test_gains_of_counts():
    source, target = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    source[5], target[5], target[6] = 10**12, 3, 10**9
    found = resampling.gains(source, target)
    assert found[5] == math.floor(1000 * math.log(4.0 * (10**12 + 10_000) / ((10**12 + 1.0) * (10**9 + 10_003))))


def test_drawn_share(spark):
    found = QUERIES["op11_resampling"](spark, "/root/testdata/sf0.001").toPandas()
    drawn = found[found["rank"].notna()]
    assert sorted(drawn["rank"]) == list(range(1, (found["n_features"] >= 20).sum() * 10 // 100 + 1))
