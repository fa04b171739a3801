"""The registered corpus queries: against their SQL, and against the contract of their columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from checks.compare import connect, difference
from orderloom.llm import packing, queries

DOCUMENTS = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{DOCUMENTS}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def run(spark, name):
    return queries.QUERIES[name](spark, DOCUMENTS).toPandas()


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_equals_sql(spark, name):
    expected = connect(DOCUMENTS).execute(queries.ORACLE[name]).df()
    assert difference(run(spark, name), expected) is None


def test_secrets_counts_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    expected = connect(folder).execute(queries.ORACLE["op5_secrets"]).df()
    assert difference(queries.QUERIES["op5_secrets"](spark, folder).toPandas(), expected) is None
    assert expected["n_assign"].sum() > 0


def test_packing(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = run(spark, "op2_packing")
    assert set(found["doc_id"]) == set(documents)
    for number, parts in found.groupby("doc_id"):
        ids = tokenizer.encode(documents[number], add_special_tokens=False).ids + [packing.END_ID]
        parts = parts.sort_values("piece")
        assert list(parts["piece"]) == list(range(len(parts)))
        assert list(parts["start"]) == [0, *np.cumsum(parts["length"])[:-1]]
        assert parts["length"].sum() == len(ids)
        assert (parts["length"].iloc[1:] == packing.LENGTH).all() and (len(parts) == 1) == (len(ids) <= packing.LENGTH)
        for part in parts.itertuples():
            data = np.array(ids[part.start : part.start + part.length], "<u4").tobytes()
            assert zlib.crc32(data) == part.ids_crc32
    for _, parts in found.groupby("sequence_id"):
        parts = parts.sort_values("offset")
        assert list(parts["offset"]) == [0, *np.cumsum(parts["length"])[:-1]]
        assert parts["length"].sum() <= packing.LENGTH
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // packing.LENGTH) + 1


def test_encoding(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = run(spark, "op7_bpe").set_index("doc_id")
    for number, text in documents.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        row = found.loc[number]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_counts(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = run(spark, "op4_counts").set_index("doc_id")
    assert all(found.loc[n, "n_tokens"] == len(tokenizer.encode(t, add_special_tokens=False).ids) for n, t in documents.items())
    assert found["recounted"].max() < 200


def test_pages(spark):
    pages = spark.read.parquet(f"{DOCUMENTS}/pages.parquet").collect()
    found = run(spark, "op1_html").set_index("page_id")
    assert len(found) == len(pages)
    for page in pages:
        text = found.loc[page["page_id"], "text"]
        assert text and "©" not in text and "track(" not in text and "</" not in text
        assert found.loc[page["page_id"], "n_chars"] == len(text)
