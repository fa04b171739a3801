"""Shards that each hold the mixture of all sources.

Proportional stratified interleaving: the rows of each source are ranked in a
seeded shuffle, all rows are sorted by the fraction of their source that comes
before them, and the sorted rows are cut into runs of equal length. Any run of
that order has the mixture of the whole, so every shard has it too.

Only DataFrame operations. No rank needs a source in one task: a source's rows
fall into hash ranges (``BUCKETS``), the sorted order into ranges of the fraction
(``CELLS``), and a rank is the count of the ranges before plus the place inside.
Equal rows travel as one row and a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.operators.staging import settle

# Hash ranges of a source: three hex digits of the digest.
BUCKETS_HEX = 3
# Ranges of the fractional rank; a power of two, so that the cut is exact.
CELLS = 1 << 14


def shard(
    documents: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "source",
    seed: int = 17,
) -> DataFrame:
    """One row per document: ``key``, ``size``, ``text_crc32``, ``stratum``, ``shard``, ``slot``.

    Shards are as equal in rows as possible (counts at most one apart); a slot is
    the place in its shard, gapless from 0. ``size`` is the text's UTF-8 bytes
    plus one.

    A NULL text has size 1 and the checksum of the empty text. NULL keys and
    strata are values like others (all NULL strata are one stratum). Equal rows
    are all kept and are interchangeable. An empty table gives no rows. Columns
    other than the three named are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(
        F.col(key).alias("k"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("s"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body).alias("crc"),
    )
    named = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("k").cast("string"), F.lit("-")), "crc", "size")
    groups = settle(
        rows.groupBy("k", "s", "size", "crc")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("digest", F.md5(named.cast("binary")))
        .withColumn("bucket", F.substring("digest", 1, BUCKETS_HEX))
    )
    ranked = settle(_ranked(groups, seed))
    placed = _placed(ranked)
    return (
        placed.withColumn("shard", F.expr(f"position * {n_shards} div n"))
        .withColumn("first", F.expr(f"(shard * n + {n_shards - 1}) div {n_shards}"))
        .select(
            F.col("k").alias(key),
            "size",
            F.col("crc").alias("text_crc32"),
            F.when(F.col("s") != "", F.expr("substring(s, 2)")).alias(stratum),
            F.col("shard").cast("int").alias("shard"),
            (F.col("position") - F.col("first")).alias("slot"),
        )
    )


def _ranked(groups: DataFrame, seed: int) -> DataFrame:
    """A row per document with the fraction of its stratum that comes before it.

    A stratum's rows lie one step apart from an offset within the first step, drawn
    from its name: else all strata of one row would meet in the middle of the order.
    """
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "s").cast("binary")), 1, 8), 16, 10).cast("bigint")
    offset = (drawn + F.lit(0.5)) / F.lit(4294967296.0)
    by_bucket = groups.groupBy("s", "bucket").agg(F.sum("copies").alias("rows"))
    whole = W.partitionBy("s")
    before = F.sum("rows").over(whole.orderBy("bucket")) - F.col("rows")
    offsets = by_bucket.select("s", "bucket", before.alias("before"), F.sum("rows").over(whole).alias("of"), offset.alias("offset"))
    inside = W.partitionBy("s", "bucket").orderBy("digest", "k", "crc", "size").rowsBetween(W.unboundedPreceding, 0)
    return (
        groups.withColumn("inside", F.sum("copies").over(inside) - F.col("copies"))
        .join(offsets, ["s", "bucket"])
        .withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
        .withColumn("fraction", (F.expr("before + inside + copy") + F.col("offset")) / F.col("of"))
        .withColumn("cell", F.floor(F.col("fraction") * CELLS))
        .select("k", "s", "size", "crc", "digest", "copy", "fraction", "cell")
    )


def _placed(ranked: DataFrame) -> DataFrame:
    """The place of each row in the order of fractions, and the number of rows."""
    in_order = W.orderBy("cell")  # at most CELLS rows, whatever the input
    counts = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.select(
        "cell",
        (F.sum("rows").over(in_order) - F.col("rows")).alias("before"),
        F.sum("rows").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    inside = W.partitionBy("cell").orderBy("fraction", "s", "digest", "k", "crc", "size", "copy")
    return (
        ranked.withColumn("inside", F.row_number().over(inside).cast("bigint"))
        .join(offsets, "cell")
        .withColumn("position", F.expr("before + inside - 1"))
    )
