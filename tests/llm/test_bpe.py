"""Prefix tables against the tokenizer's own library."""

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
VOCABULARY = bpe.vocabulary(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ids, special_tokens={})
TEXTS = st.text(st.sampled_from(list("abcdethinrsT  \n\t\r'é日🙂\x1c\x85\xa0　.,12²ⅷ_-")), max_size=60) | st.text(max_size=30)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_equal_those_of_the_library(text):
    assert bpe.text_encoder(PATH, PATTERN).ids(text).tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=20), st.integers(0, 40), st.integers(0, 40))
def test_appends_and_edits_equal_a_new_piece(data, new, start, size):
    start = min(start, len(data))
    end = min(start + size, len(data))
    piece = bpe.Piece(VOCABULARY, data)
    kept = piece.last[:start]
    piece.replace(start, end, new)
    fresh = bpe.Piece(VOCABULARY, data[:start] + new + data[end:])
    assert piece.last == fresh.last and piece.last[:start] == kept
    assert piece.append(new).ids() == bpe.Piece(VOCABULARY, fresh.data + new).ids()
    assert b"".join(VOCABULARY.tokens[t] for t in piece.ids()) == fresh.data + new


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abehinorstT"), min_size=1, max_size=25))
def test_a_prefix_has_one_last_token(word):
    """Of all tokens that end a prefix, only the stored one may stand after the token before it."""
    piece = bpe.Piece(VOCABULARY, word.encode())
    data = piece.data
    for stop in range(1, len(data) + 1):
        fits = []
        for start in range(stop):
            token = VOCABULARY.ids.get(data[start:stop])
            if token is not None and (start == 0 or VOCABULARY.may_meet(piece.last[start - 1], token)):
                fits.append(token)
        assert fits == [piece.last[stop - 1]]


def test_tables(spark):
    rows = [(1, "a text"), (1, "a text"), (None, None), (2, ""), (3, "long " * 30_000 + "é🙂")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    encoded = bpe.encoded(documents, PATH, PATTERN)
    assert sorted(map(str, (r["ids"] for r in encoded.collect()))) == sorted(
        str(LIBRARY.encode_ordinary(t or "")) for _, t in rows
    )
    decoded = [bytes(r["bytes"]).decode() for r in bpe.decoded(encoded, PATH).collect()]
    assert sorted(decoded) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(documents, PATH, PATTERN).count() == 5
    assert bpe.round_trip(documents.limit(0), PATH, PATTERN).count() == 0


def test_special_strings_are_text():
    assert len(bpe.text_encoder(PATH, PATTERN).ids("<|endoftext|>")) > 1


def test_an_unknown_id_raises(spark):
    bad = spark.createDataFrame([(1, [99_999])], "doc_id bigint, ids array<int>")
    with pytest.raises(Exception, match="99999"):
        bpe.decoded(bad, PATH).collect()
