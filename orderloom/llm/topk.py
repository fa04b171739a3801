"""Exact top-k search by inner product.

Exhaustive, term at a time: the rows are sparse (a component of 0 has no
posting). For each term, the queries that have it scatter their weight times the
posting's value into a dense array of scores; the best k are taken by partition
selection, and the lists of all candidate blocks are merged.

Queries and candidates are packed into blocks of bounded size. A block of
queries meets a block of candidates through an equi-join on a cell number, so
nothing is broadcast and a task holds one block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 4_096
# Queries that scatter at a time: bounds the array of scores.
QUERY_SLICE = 128
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def whole_numbers(vector: str, factor: int) -> F.Column:
    """floor(factor * x) for each component; NULL if the vector or a component is NULL or not finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * factor))
    return F.when(finite, scaled)


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Both inputs have ``id`` (bigint) and ``vector`` (array of bigint); other
    columns are not read. Ties go to the smaller ``vec_id``. A candidate with the
    query's id is the query's own row and is no candidate. Rows with a NULL id, a
    NULL vector or a NULL component take no part. Missing components of a shorter
    vector are 0. A query id that repeats is asked once, with its smallest
    vector; candidate rows that repeat are all candidates. A score beyond 64 bits
    is the nearest 64-bit number. Fewer than k candidates give fewer rows; an
    empty side gives none.
    """
    asked = _usable(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    given = _usable(candidates)
    n_chunks = max(1, -(-given.count() // (4 * CANDIDATE_BLOCK)))

    query_blocks = (
        asked.withColumn("block", F.expr(f"pmod(xxhash64(id), {n_blocks})"))
        .groupBy("block")
        .applyInPandas(_packed_group, "block bigint, asked binary")
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, {n_chunks - 1}L)")))
    )
    candidate_blocks = (
        given.mapInPandas(_packed, "given binary, mix bigint")
        .withColumn("chunk", F.expr(f"pmod(xxhash64(mix), {n_chunks})"))
        .withColumn("block", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")))
    )
    found = (
        candidate_blocks.join(query_blocks.hint("shuffle_hash"), ["block", "chunk"])
        .select("block", "asked", "given")
        .mapInPandas(_best(k), "query_id bigint, vec_id bigint, score bigint")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _usable(rows: DataFrame) -> DataFrame:
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    return rows.where(whole).select("id", "vector")


def _pack(ids: np.ndarray, vectors: list) -> bytes:
    """Rows as bytes: number of rows, width, ids, components."""
    width = max((len(v) for v in vectors), default=0)
    matrix = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(matrix, vectors):
        row[: len(vector)] = vector
    order = np.argsort(ids, kind="stable")
    head = np.array([len(vectors), width], np.int64)
    return head.tobytes() + ids[order].tobytes() + matrix[order].tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, width = np.frombuffer(data, np.int64, 2)
    ids = np.frombuffer(data, np.int64, rows, 16)
    return ids, np.frombuffer(data, np.int64, rows * width, 16 + 8 * rows).reshape(rows, width)


def _packed_group(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["id"].to_numpy(np.int64)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "asked": [_pack(ids, list(rows["vector"]))]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of at most CANDIDATE_BLOCK rows of a partition."""
    ids, vectors = [], []

    def block() -> pd.DataFrame:
        numbers = np.array(ids, np.int64)
        return pd.DataFrame({"given": [_pack(numbers, vectors)], "mix": [int(numbers[0]) + len(ids)]})

    for rows in batches:
        for number, vector in zip(rows["id"], rows["vector"]):
            ids.append(number)
            vectors.append(vector)
            if len(ids) == CANDIDATE_BLOCK:
                yield block()
                ids, vectors = [], []
    if ids:
        yield block()


def scattered(asked: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``given`` (columns) for all of ``asked`` (rows), term at a time."""
    terms = min(asked.shape[1], given.shape[1])
    largest = [max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0 for m in (asked, given)]
    fits = largest[0] * largest[1] * max(terms, 1) < 2**62
    if not fits:
        asked, given = asked.astype(object), given.astype(object)
    scores = np.zeros((len(asked), len(given)), np.int64 if fits else object)
    for term in range(terms):
        having = np.flatnonzero(asked[:, term])
        postings = np.flatnonzero(given[:, term])
        weighted = np.multiply.outer(asked[having, term], given[postings, term])
        if len(having) == len(asked) and len(postings) == len(given):
            scores += weighted
        else:
            scores[np.ix_(having, postings)] += weighted
    return scores if fits else np.clip(scores, LOWEST, HIGHEST).astype(np.int64)


def _selected(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores, ties to the smaller id; ids are in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], ~scores[kept]))][:k]


def _best(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for asked_bytes, given_bytes in zip(rows["asked"], rows["given"]):
                names, asked = _unpack(asked_bytes)
                ids, given = _unpack(given_bytes)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for start in range(0, len(names), QUERY_SLICE):
                    scores = scattered(asked[start : start + QUERY_SLICE], given)
                    for name, row in zip(names[start : start + QUERY_SLICE], scores):
                        own = slice(np.searchsorted(ids, name, "left"), np.searchsorted(ids, name, "right"))
                        others, values = (ids, row) if own.start == own.stop else (np.delete(ids, own), np.delete(row, own))
                        best = _selected(values, others, k)
                        out.append((np.full(len(best), name), others[best], values[best]))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out)]
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run
