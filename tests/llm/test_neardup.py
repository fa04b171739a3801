"""Near-duplicate classes against comparing all texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from orderloom.llm import neardup

KINDS = "doc_id bigint, text string, n bigint, bands string"


def multiset(text):
    words = [w for w in re.split(r"[\x00-\x20]+", text or "") if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    if a == b:
        return True
    a, b = multiset(a), multiset(b)
    shared = sum((a & b).values())
    return shared > 0 and shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared)


def brute(rows):
    """Class of each row position: rows that links connect."""
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if top(i) != top(j) and alike(rows[i][1] or "", rows[j][1] or ""):
                parent[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values())


def documents():
    chance = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [chance.choice(words) for _ in range(n)]
    base, passage = draw(150), draw(60)
    texts = [" ".join(base)]
    for _ in range(90):  # near copies of one text, from one word changed to many
        copy = list(base)
        for _ in range(chance.choice([1, 1, 1, 2, 2, 3, 5, 9])):
            place = chance.randrange(len(copy))
            kind = chance.random()
            copy[place : place + (kind < 0.7)] = draw(1) if kind < 0.85 else []
        texts.append(" ".join(copy))
    texts += [" ".join(draw(20) + passage + draw(chance.randint(5, 30))) for _ in range(40)]  # one passage in many
    texts += ["same text twice"] * 30 + ["the same words " * 80, "the same words " * 90, "the same words " * 300]
    texts += [None, "", " ", "\n", "one two", "one  two", "one two three", " ".join(draw(9000))]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[0], 0, "x"), (None, "nobody else", 0, "x"), (3, texts[3], 0, "x"), (4, "another text of document four", 0, "x")]
    chance.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(documents(), KINDS)


def test_classes_equal_those_of_all_comparisons(table):
    rows = documents()
    expected = Counter()
    for group in brute(rows):
        keys = [rows[i][0] for i in group if rows[i][0] is not None]
        expected.update((rows[i][0], min(keys, default=None)) for i in group)
    found = neardup.classes(table).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in found) == expected


def test_one_of_each_class_stays(table):
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns
    kept = kept.collect()
    rows = documents()
    groups = brute(rows)
    assert len(kept) == len(groups)
    smallest = {min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in groups}
    assert {r["doc_id"] for r in kept} == smallest


def test_signatures_are_unbiased():
    chance = np.random.default_rng(0)
    errors, spread = [], []
    for _ in range(120):
        n = chance.integers(1, 60)
        a, b = chance.integers(0, 9, n), chance.integers(0, 9, n)
        b = np.where(chance.random(n) < 0.7, a, b)
        if not a.any() or not b.any():
            continue
        elements = chance.integers(1, 2**62, n).astype(np.uint64)
        one, other = (neardup.signature(elements[w > 0], w[w > 0]) for w in (a, b))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((one == other).mean() - true)
        spread.append(true * (1 - true) / neardup.REGISTERS)
    assert abs(np.mean(errors)) < 4 * np.sqrt(np.mean(spread) / len(errors))
    assert 0.7 < np.mean(np.square(errors)) / np.mean(spread) < 1.4


def test_shingles_count_like_words():
    for text in ["a b c d e f", "a b c d", "", None, "  x\ty\n", "a a a a a a a", "é 🙂 b c d e"]:
        assert sorted(np.unique(neardup.shingles(text), return_counts=True)[1]) == sorted(multiset(text).values())


def test_possible_pairs_are_those_alike_and_few_others(spark):
    """Near copies of one text, each a class, in one bucket: hubs could rule out few of their pairs."""
    chance = random.Random(9)
    base = [f"w{i}" for i in range(120)]

    def changed(n):
        return " ".join(f"x{chance.random()}" if i in places else w for places in [set(chance.sample(range(120), n))] for i, w in enumerate(base))

    texts = [changed(chance.choice([0, 1, 2, 8, 10, 12])) for _ in range(60)] + [" ".join(base[:90] + base[:90])] * 1
    names = [bytes([i]) for i in range(len(texts))]
    classes = [names[0] if i < 4 else names[i] for i in range(len(texts))]
    buckets = [[7] if i == 10 else [5, i + 100] if i % 2 else [5] for i in range(len(texts))]
    still = spark.createDataFrame(list(zip(names, classes, buckets)), "d binary, c binary, buckets array<bigint>")
    bodies = spark.createDataFrame(list(zip(names, texts)), "d binary, t string")
    compared = spark.createDataFrame([(names[20], names[21])], "d binary, h binary")
    found = {(bytes(d)[0], bytes(h)[0]) for d, h in neardup._possible(still, bodies, compared, 0.8).collect()}
    inside = {
        (i, j) for i in range(len(texts)) for j in range(i) if classes[i] != classes[j] and 10 not in (i, j) and (i, j) != (21, 20)
    }
    wanted = {(i, j) for i, j in inside if alike(texts[i], texts[j])}
    assert wanted <= found <= inside and wanted
    assert len(found) < (len(inside) + len(wanted)) / 2


def test_empty_table(table):
    assert neardup.classes(table.limit(0)).count() == 0
    assert neardup.keep_one(table.limit(0)).count() == 0


def test_no_link_is_lost_on_the_documents(spark):
    """All pairs of different texts that share a run of words, against the classes of the whole table."""
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents).collect()}
    texts = {}
    for row in documents.collect():
        texts.setdefault(row["text"] or "", []).append(row["doc_id"])
    assert all(len({found[i] for i in same}) == 1 for same in texts.values())
    holders, pairs = {}, set()
    with np.errstate(over="ignore"):
        for number, text in enumerate(texts):
            for run in np.unique(neardup.shingles(text)).tolist():
                holders.setdefault(run, []).append(number)
        for group in holders.values():
            pairs |= {(a, b) for i, a in enumerate(group) for b in group[i + 1 :]}
        bodies = list(texts)
        near = [(a, b) for a, b in pairs if neardup.similarity(bodies[a], bodies[b]) >= neardup.SIMILARITY]
    assert near
    assert all(found[texts[bodies[a]][0]] == found[texts[bodies[b]][0]] for a, b in near)
    # And classes are no larger than the links make them.
    parent = list(range(len(bodies)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in near:
        parent[root(a)] = root(b)
    ids = {i: root(n) for n, body in enumerate(bodies) for i in texts[body]}
    assert len(set(ids.values())) == len(set(found.values()))
