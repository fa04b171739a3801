"""The classifier on texts whose quality is known."""

import random
import zlib

import numpy as np
import pytest

from orderloom.llm import quality


def documents(n=600):
    chance = random.Random(3)
    words = ["river", "town", "market", "slow", "green", "the", "of", "and", "stone", "bridge"]
    rows = []
    for i in range(n):
        good = chance.random() < 0.8
        text = " ".join(chance.choice(words) for _ in range(chance.randint(3, 120)))
        rows.append((i, text if good else " ".join(w + chance.choice(["$$$", "!!", "###"]) for w in text.split()), int(good)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = documents()
    texts = [(i, t, "clash", -1.0) for i, t, _ in rows] + [(None, None, "clash", -1.0), (9000, "", "clash", -1.0), (5, rows[5][1], "clash", -1.0)]
    labels = [(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (7000, 1, 0), (1, None, 0), (2, 7, 0)]
    return (
        spark.createDataFrame(texts, "doc_id bigint, text string, quality string, score double"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_held_out_rows_are_told_apart(tables):
    found = quality.score(tables[0], quality.fit(*tables)).collect()
    assert len(found) == 603 and all(0 <= r["score"] <= 1 and r["quality"] == "clash" for r in found)
    truth = {i: y for i, _, y in documents()}
    held = [r for r in found if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_held_out_labels_teach_nothing(spark, tables):
    documents_, labels = tables
    turned = labels.selectExpr(
        "doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic"
    )
    one, other = quality.fit(documents_, labels), quality.fit(documents_, turned)
    assert np.array_equal(one.weights, other.weights) and one.slope == other.slope


def test_one_class_no_labels_no_rows(spark, tables):
    documents_, labels = tables
    for few in (labels.where("quality = 1"), labels.limit(0)):
        model = quality.fit(documents_, few)
        scores = {r["score"] for r in quality.score(documents_, model).collect()}
        assert len(scores) == 1 and 0.4 < scores.pop() < 1
    assert quality.score(documents_.limit(0), quality.fit(documents_.limit(0), labels)).count() == 0


def test_descent_finds_the_least_hinge_loss():
    """The dual's solution is optimal: no coordinate can still move."""
    chance = np.random.default_rng(0)
    data = [np.unique(chance.integers(0, 30, 6)).astype(np.int32) for _ in range(40)]
    truth = np.where(chance.random(40) < 0.5, 1, -1)
    ratios = chance.normal(size=quality.SLOTS)
    quality_passes, quality.PASSES = quality.PASSES, 3000
    try:
        weights, bias = quality.descend(data, truth, ratios, np.arange(40), chance)
    finally:
        quality.PASSES = quality_passes

    def loss(w, b):
        margins = np.array([truth[i] * (float(w[s] @ (ratios[s] / quality.size(s))) + b) for i, s in enumerate(data)])
        limits = np.where(truth > 0, 40 / (2 * (truth > 0).sum()), 40 / (2 * (truth < 0).sum()))
        return 0.5 * (w @ w + b * b) + float(limits @ np.maximum(0, 1 - margins))

    best = loss(weights, bias)
    for _ in range(200):
        step = np.zeros(quality.SLOTS)
        step[:30] = chance.normal(size=30) * 1e-3
        assert loss(weights + step, bias + chance.normal() * 1e-3) >= best - 1e-6


def test_repeated_words_have_slots():
    grams = quality.Grams()
    assert set(range(1, 5)) <= set(grams("to to to to to go").tolist())
    assert 2 not in grams("to to go go")
    assert len(grams("")) == 0
