"""Importance resampling towards a target distribution, over hashed n-grams.

A feature is a run of consecutive words, joined by one space; its bucket is the
CRC-32 of its bytes modulo the number of buckets. A document's words are written
one space apart and scanned once, keeping the running CRC before and after every
word. The CRC of a run then follows from two of these: the CRC up to its end,
with the CRC up to its start, carried over as many zero bytes as the run is long,
cancelled out of it. That carrying is linear over GF(2) and done with tables.

Buckets are counted in the documents and in the target; a document weighs the sum
of its features' log ratios, and a fixed share of the documents with the highest
noisy weights is drawn (Gumbel noise from the key: a sample without replacement,
in proportion to the exponential of the weight).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.landing import land

ORDER = 1
BUCKETS = 10_000
SCALE = 1_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

SHORT = 64  # shifts of fewer bytes have a table of their own
SPACE_CRC = np.uint32(zlib.crc32(b" "))
# The bytes of words, in lower case; all others separate.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def _apply(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of each byte at each of its four places."""
    out = table[0, crcs & np.uint32(255)]
    for place in range(1, 4):
        out = out ^ table[place, (crcs >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def _byte_table() -> np.ndarray:
    """What one zero byte makes of each low byte: the table of the CRC."""
    crcs = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crcs = (crcs >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crcs & np.uint32(1)))
    return crcs


class Shifts:
    """Carries CRCs over any number of zero bytes."""

    def __init__(self) -> None:
        step = _byte_table()
        places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        short = [places]
        for _ in range(SHORT):
            short.append((short[-1] >> np.uint32(8)) ^ step[short[-1] & np.uint32(255)])
        self.short = np.stack(short[:SHORT])
        self.long = [short[SHORT]]  # over SHORT, 2 SHORT, 4 SHORT ... bytes

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rest = lengths % SHORT
        out = self.short[rest, 0, crcs & np.uint32(255)]
        for place in range(1, 4):
            out ^= self.short[rest, place, (crcs >> np.uint32(8 * place)) & np.uint32(255)]
        blocks, power = lengths // SHORT, 0
        while blocks.any():
            if power == len(self.long):
                self.long.append(_apply(self.long[-1], self.long[-1]))
            odd = (blocks & 1).astype(bool)
            out[odd] = _apply(self.long[power], out[odd])
            blocks, power = blocks >> 1, power + 1
        return out


class Features:
    """Buckets of a text's features, repeats counted, and its number of words."""

    def __init__(self, order: int = ORDER, buckets: int = BUCKETS) -> None:
        self.order, self.buckets, self.shifts = order, buckets, Shifts()

    def crcs(self, text: str | None) -> tuple[list[np.ndarray], int]:
        words = (text or "").encode().translate(_WORDS).split()
        if not words:
            return [], 0
        scanned = [words[0], *[b" " + word for word in words[1:]]]
        crc = zlib.crc32
        ends = np.fromiter(accumulate(scanned, lambda before, word: crc(word, before), initial=0), np.uint32, len(words) + 1)[1:]
        places = np.cumsum(np.fromiter(map(len, scanned), np.int64, len(words)))
        one = np.ones(len(words) - 1, np.int64)
        starts = np.concatenate([np.zeros(1, np.uint32), self.shifts(ends[:-1], one) ^ SPACE_CRC])
        begins = np.concatenate([np.zeros(1, np.int64), places[:-1] + 1])
        return [
            ends[n:] ^ self.shifts(starts[: len(words) - n], places[n:] - begins[: len(words) - n])
            for n in range(min(self.order, len(words)))
        ], len(words)

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        crcs, n_words = self.crcs(text)
        every = np.concatenate(crcs) if crcs else np.zeros(0, np.uint32)
        return (every % np.uint32(self.buckets)).astype(np.int64), n_words


def bucket_counts(documents: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents lie in each bucket; a task sends a row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(order, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0):
                counts += np.bincount(features(body.as_py())[0], minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "n"])

    rows = documents.select(F.col(f"`{text}`").cast("string").alias("t"))
    found = rows.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for row in found:  # as many as there are buckets
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Per bucket the scaled log ratio of its smoothed shares in target and source, rounded down."""
    every, wanted = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array(
        [math.floor(scale * math.log(float(t + 1) * every / (float(s + 1) * wanted))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(key: object, seed: int = SEED, scale: int = SCALE) -> int:
    """Gumbel noise of a key, scaled and rounded down; a NULL key is written as nothing."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((drawn + 0.5) / 4294967296)))


def weigh(
    documents: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", order: int = ORDER, seed: int = SEED
) -> DataFrame:
    """Per document ``k``, ``n_words``, ``n_features``, ``weight``, ``score`` and the partition it was read in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, part = Features(order, len(gain)), TaskContext.get().partitionId()
        for batch in batches:
            keys, found = batch.column(0).to_pylist(), [features(body.as_py()) for body in batch.column(1)]
            weights = [int(gain[buckets].sum()) for buckets, _ in found]
            columns = [
                [n for _, n in found],
                [len(buckets) for buckets, _ in found],
                weights,
                [weight + noise(k, seed) for k, weight in zip(keys, weights)],
                [part] * len(keys),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]],
                ["k", "n_words", "n_features", "weight", "score", "part"],
            )

    rows = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, part bigint")


def resample(
    documents: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, ``n_features``, ``weight``, ``score``, ``rank`` (NULL if not drawn).

    Features are runs of 1 to ``order`` words. Drawn are the ``percent`` (rounded
    down) of the documents with ``least_words`` or more that have the highest
    scores, ties to the smaller key; rank 1 is the highest.

    A NULL or empty text has no word, no feature and weight 0. A NULL key sorts
    last among ties and draws its noise as an empty one. Repeated rows are all
    kept; equal ones have equal scores and successive ranks. An empty table gives
    no rows; an empty target makes every gain a smoothed one. Other columns are not
    read. Texts are scanned twice: once to count, once to weigh.
    """
    gain = gains(bucket_counts(documents, text, order, buckets), bucket_counts(target, target_text, order, buckets))
    weighed = land(weigh(documents, gain, key, text, order, seed))
    able = weighed.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    facts = ["n_features", "weight", "score"]
    rest = weighed.where(F.col("n_words") < least_words).select("k", *facts, F.lit(None).cast("bigint").alias("rank"))
    ranks = ranked(able, ["k", *facts, "part"]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.select("k", *facts, "rank").unionByName(rest).withColumnRenamed("k", key)


def ranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with their ``rank`` by falling score, then key: 1, 2, 3 ... over the whole table.

    The sorted order is cut into ranges; a rank is the number of rows in the ranges
    before plus the place in its own. Equal rows of a part travel as one row and a
    number, so one key with any share of the rows does not fill a range.
    """
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.desc("score"), F.asc_nulls_last("k"), "n_features", "part"]
    schema = groups.schema.add("range", "integer").add("before", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy()
            places = np.cumsum(copies) - copies + before
            before += int(copies.sum())
            added = [pa.array(np.full(len(copies), part, np.int32)), pa.array(places.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "range", "before"])

    placed = land(groups.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    whole = placed.groupBy("range").agg(F.sum("copies").alias("of_range"))
    # A row per range: as many as the shuffle has partitions.
    offsets = whole.select("range", (F.sum("of_range").over(W.orderBy("range")) - F.col("of_range")).alias("offset"))
    return (
        placed.join(F.broadcast(offsets), "range")
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .select(*names, (F.col("offset") + F.col("before") + F.col("copy")).alias("rank"))
    )
