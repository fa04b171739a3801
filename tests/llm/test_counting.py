"""Counts that follow edits, against counting the edited text anew."""

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orderloom.llm import bpe, counting

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
MARKS = list("ab  \n\t'sé日🙂 ,12-") + ["'re", "  ", "the ", "tion", " \n", "\n\n\n", " word", "'ll"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ids, special_tokens={})


def drawn(chance, most):
    return "".join(chance.choice(MARKS) for _ in range(chance.randint(0, most)))


@pytest.mark.parametrize("seed", range(6))
def test_every_edit_equals_counting_anew(library, seed):
    chance = random.Random(seed)
    split, count = counting.counter(PATH, PATTERN)
    for _ in range(60):
        text = drawn(chance, 400)
        tree = counting.TokenTree(text, split, count)
        for _ in range(12):
            at, removed, inserted = chance.randint(0, len(text) + 2), chance.choice([0, 1, 3, 200]), drawn(chance, 6)
            tree.edit(at, removed, inserted)
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + removed :]
            assert tree.text() == text
            assert [p for leaf in tree.leaves for p in leaf] == split.findall(text)
            assert tree.n_chars == len(text)
            assert tree.n_tokens == len(library.encode_ordinary(text))


def test_an_edit_encodes_a_few_pre_tokens_only():
    split, count = counting.counter(PATH, PATTERN)
    tree = counting.TokenTree("some words in a row, " * 20_000, split, count)
    tree.edit(200_000, 3, "xyz")
    assert 0 < tree.recounted < 20


def test_long_insert_and_single_run(library):
    split, count = counting.counter(PATH, PATTERN)
    tree = counting.TokenTree("a" * 3000, split, count)
    tree.edit(1500, 0, " " + "b c " * 2000)
    assert tree.n_tokens == len(library.encode_ordinary(tree.text()))


def test_table(spark, library):
    rows = [(1, "a few words"), (1, "a few words"), (None, None), (2, ""), (3, "x" * 50 + " end. " * 500)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k", F.lit("clash"))
    result = counting.recount(documents.withColumn("edits", counting.drawn_edits()), PATH, PATTERN).collect()
    assert len(result) == 5
    counts = sorted((len(t or ""), len(library.encode_ordinary(t or ""))) for _, t in rows)
    assert sorted((r["n_chars"], r["n_tokens"]) for r in result) == counts
    edits = spark.sql(f"select cast(array(struct(6L, null, 'old '), null, struct(null, 2L, null)) as {counting.EDITS}) e").first()["e"]
    one = spark.createDataFrame([(7, "some text", edits)], f"doc_id bigint, text string, edits {counting.EDITS}")
    row = counting.recount(one, PATH, PATTERN).first()
    assert row["edited_tokens"] == len(library.encode_ordinary("me told ext")) and row["edited_chars"] == 11
    assert counting.recount(one.limit(0), PATH, PATTERN).count() == 0
