"""The registered queries over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from orderloom.llm import bpe, counting, fingerprints, html, neardup, oracle, packing, quality, resampling, rules, secrets, sharding, topk, trie
from orderloom.llm.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 16


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(_table(spark, folder, "pages"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, folder, "documents"), _vocabulary(TOKENIZER)))


def op3_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(_table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = _table(spark, folder, "documents").select("doc_id", "text", counting.drawn_edits().alias("edits"))
    return counting.recount(documents, _vocabulary(RANKS), public_tokenizers.PATTERN)


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents").select("doc_id", "text"))
    counts = [secrets.count_of("base_spans", name).alias(f"n_{name}") for name in secrets.BASE]
    base = F.sha2(secrets.written("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.written("spans").alias("spans"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(documents, _table(spark, folder, "labels"))
    scored = quality.score(documents, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, folder, "documents"), _vocabulary(RANKS), public_tokenizers.PATTERN)


def op8_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(_table(spark, folder, "documents")).select("doc_id", "class_id", "keep")


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, folder, "documents"))


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), topk.whole_numbers("embedding", 256).alias("vector")
    )
    return topk.top_k(rows.where("id % 50 = 0"), rows, 5)


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie(_table(spark, folder, "conversations"))


def op13_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(_table(spark, folder, "documents").select("doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *base, F.array_join("failed", ",").alias("failed"))


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_packing": op2_packing,
    "op3_shards": op3_shards,
    "op4_counts": op4_counts,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_neardup": op8_neardup,
    "op9_fingerprints": op9_fingerprints,
    "op10_topk": op10_topk,
    "op11_resampling": op11_resampling,
    "op12_trie": op12_trie,
    "op13_rules": op13_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = oracle.oracle_sql(SHARDS)
