"""Packing: every piece once, no gap, nearly as few sequences as possible."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orderloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def valid(rows, length):
    """Number of sequences; raises if one has a gap or is too long."""
    by_sequence = {}
    for row in rows:
        by_sequence.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_cells_rounds_and_copies(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 60)
    chance = random.Random(2)
    sizes = [chance.randint(1, 100) for _ in range(700)] + [37] * 300 + [100] * 20
    found = spark.createDataFrame([(None if i % 9 == 0 else i % 50, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, length bigint, at string")
    rows = packing.pack(found.drop("at"), 100).collect()
    assert Counter(r["length"] for r in rows) == Counter(sizes)
    # Best fit over all pieces at once, which no cell sees.
    rest = np.array([s for s in sizes if s < 100])
    whole = packing.best_fit(rest, np.full(len(rest), -1), np.argsort(-rest, kind="stable"), 100).max() + 1 + 20
    assert valid(rows, 100) <= whole * 1.02 + 1


def test_pieces_and_sequences(spark, tokenizer):
    rows = [(1, "word " * 300), (None, None), (2, ""), (1, "word " * 300), (3, "other <|endoftext|> text, é🙂"), (4, "x y z " * 2000)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as piece", "1 as k")
    packed = packing.pack(packing.pieces(documents, PATH, 64, with_ids=True), 64)
    pieces = packed.collect()
    valid(pieces, 64)
    tokenizer.encode_special_tokens = True
    expected = Counter(str(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in rows if k != 1)
    whole, parts = Counter(), {}
    for p in sorted(pieces, key=lambda p: p["piece"]):
        if p["piece"] == 0 and p["doc_id"] != 1:
            parts[p["doc_id"]] = []
        if p["doc_id"] != 1:
            parts[p["doc_id"]] += p["ids"]
    whole.update(str(ids) for ids in parts.values())
    assert whole == expected
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(p["length"] for p in pieces)
    assert all(r["starts"][0] == 0 and len(r["ids"]) <= 64 for r in joined)


def test_cut():
    assert packing.cut(b"\0" * 4 * 5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(b"\0" * 4 * 8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(b"\0" * 4 * 3, 4) == [(0, 3)]


def test_children_are_whole_packings():
    chance = random.Random(1)
    sizes = np.array([chance.randint(1, 60) for _ in range(80)])
    none = np.full(80, -1)
    parents = [packing.best_fit(sizes, none, np.array(chance.sample(range(80), 80)), 100) for _ in range(4)]
    for _ in range(50):
        child = packing.crossover(sizes, *chance.sample(parents, 2), 100, chance)
        child = packing.mutated(sizes, child, 100, chance)
        assert np.bincount(child, sizes).max() <= 100 and (np.bincount(child) > 0).all() and len(child) == 80
        parents[chance.randrange(4)] = child


def test_evolution_beats_best_fit():
    # Triples that fill a bin exactly; best fit in falling order does not find them all.
    chance = random.Random(0)
    sizes = []
    for _ in range(20):
        a = chance.randint(380, 490)
        b = chance.randint(250, 1000 - a - 250) if 1000 - a - 250 > 250 else 250
        sizes += [a, b, 1000 - a - b]
    sizes = np.array(sizes)
    fitted = packing.best_fit(sizes, np.full(60, -1), np.argsort(-sizes, kind="stable"), 1000)
    evolved = packing.evolve(sizes, [], 1000, chance)
    assert evolved.max() <= fitted.max()
    assert packing.fitness(sizes, evolved, 1000) >= packing.fitness(sizes, fitted, 1000)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0
