"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the session, the documents that the stage before kept, and the
folder of tables, and returns the documents it keeps with the same columns; the
last returns the pieces of the sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import neardup, packing, quality, secrets
from orderloom.llm.landing import scratch
from orderloom.llm.shipping import ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of these documents.

    NULL and empty texts are scored like others, equal texts alike; all columns stay
    as they are, whatever their names. An empty table stays empty.
    """
    ship(spark)
    plain, names = _numbered(docs)
    key, text = names["doc_id"], names["text"]
    model = quality.fit(plain, spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", key), key, text)
    return _named(quality.score(plain, model, key, text).where("predicted = 1"), docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of rows that repeat an id and a text one stays. NULL and empty texts are equal to
    each other. An empty table stays empty.
    """
    ship(spark)
    plain, names = _numbered(docs)
    return _named(neardup.keep_one(plain, names["doc_id"], names["text"]), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; ``n_chars``, where there is one, follows the text.

    NULL texts stay NULL; repeated rows are masked alike; an empty table stays empty.
    """
    plain, names = _numbered(docs)
    text, count = names["text"], names.get("n_chars")
    masked = secrets.redact(plain, text)
    if count:
        masked = masked.withColumn(count, F.length(text).cast("bigint"))
    return _named(masked, docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under column names that clash with none of an operator's, and the new name of each."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(plain: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, under their own names."""
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and their place in it."""
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]

# The classifier, the signatures and the tokens have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
