"""Tables written in key order, and bounded reads that open only the files they need.

A ranged table is cut into ranges of its order, each sorted, and every row keeps
its range and its place there. Beside the rows lies a list of blocks: runs of a
few hundred or thousand neighbouring rows with their file, their keys' limits and
the number of rows before them, of the whole table or, with a ``group``, of each
of its values. A read looks up its blocks, which are few, and then opens the files
that hold them at the places wanted, so that neither the depth of a page nor a key
that many rows share makes it read more.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RANGE, PLACE = "range_", "place_"
BLOCK_ROWS = 1_024
# Rows in a file at most; ranges beyond that take several files.
FILE_ROWS = 4_000_000
# Blocks in a file of their list.
LIST_ROWS = 1_000_000
# Bits of a row's place in its range.
PLACE_BITS = 33


class DuplicateKeyError(ValueError):
    """A key that must be unique repeats."""


def write_ranged(
    table: DataFrame,
    path: str,
    key: str = "_id",
    group: str | None = None,
    ranges: int | None = None,
    block_rows: int = BLOCK_ROWS,
    unique: bool = False,
) -> int:
    """Replace the ranged table at ``path``, ordered by ``group`` and ``key``, NULL first; returns the rows written.

    Rows of one key are told apart by a hash of the row, so a key with any share of
    the rows spreads over several ranges. Without ``ranges`` adaptive execution sets
    their number by the size of the data. With ``unique`` a key that repeats raises
    once the rows are written.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns])
    order = [*[F.asc_nulls_first(f"`{c}`") for c in (group, key) if c is not None], "tie_"]
    told = table.withColumn("tie_", tie)
    cut = told.repartitionByRange(ranges, *order) if ranges else told.repartitionByRange(*order)
    cut = cut.sortWithinPartitions(*order).drop("tie_")
    return write_sorted(cut, path, key, group, block_rows, unique)


def write_sorted(
    table: DataFrame, path: str, key: str, group: str | None = None, block_rows: int = BLOCK_ROWS, unique: bool = False
) -> int:
    """Replace the ranged table at ``path`` by a table whose partitions are its ranges, in order and sorted."""
    # Rises by one from row to row of a partition, whose number is in the upper bits.
    placed = table.withColumn("row_", F.monotonically_increasing_id())
    placed = placed.withColumn(RANGE, F.shiftright("row_", PLACE_BITS).cast("int"))
    placed = placed.withColumn(PLACE, F.col("row_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("row_")
    observed = Observation()
    (
        placed.observe(observed, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", FILE_ROWS)
        .option("parquet.page.row.count.limit", block_rows)  # so that a read can skip to its block within a file
        .parquet(f"{path}/rows")
    )
    rows = table.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    repeated = _write_blocks(rows, path, key, group, block_rows, unique)
    if repeated:
        raise DuplicateKeyError(f"{repeated} rows repeat a key in {path}")
    return observed.get["rows"]


def _write_blocks(rows: DataFrame, path: str, key: str, group: str | None, block_rows: int, unique: bool) -> int:
    """One row per block, file and group, from one scan of the key, the group and the places; returns the repeats of unique keys."""
    groups = [] if group is None else ["group"]
    keys = rows.select(
        RANGE,
        F.expr(f"{PLACE} div {block_rows}").alias("block"),
        F.col("_metadata.file_name").alias("file"),
        *[F.col(f"`{group}`").alias(g) for g in groups],
        F.col(f"`{key}`").alias("key"),
        F.col(PLACE).alias("low"),
    )
    if unique:
        of_key = keys.groupBy(RANGE, "block", "file", *groups, "key")
        keys = of_key.agg(F.count(F.lit(1)).alias("rows"), F.min("low").alias("low"))
    else:
        keys = keys.withColumn("rows", F.lit(1).cast("bigint"))
    blocks = keys.groupBy(RANGE, "block", "file", *groups).agg(
        F.sum("rows").alias("rows"),
        F.min("low").alias("low"),
        F.min("key").alias("first"),
        F.max("key").alias("last"),
        F.sum(F.when(F.col("key").isNull(), F.col("rows")).otherwise(0)).alias("nulls"),
        *([F.count("key").alias("keys")] if unique else []),
    )
    blocks = blocks.persist()  # used twice; far fewer than the rows
    try:
        ranges = blocks.groupBy(*groups, RANGE).agg(F.sum("rows"), F.min("low"), F.count(F.lit(1)), F.sum("nulls"))
        # A row per range, and one more for each group that begins within a range.
        found = sorted(ranges.collect(), key=lambda r: [(v is not None, v) for v in r[: len(groups) + 1]])
        offsets, before = [], {}
        for *which, rows_, low, _, _ in found:
            named = tuple(which[:-1])
            offsets.append((*which, before.get(named, 0) - low))
            before[named] = before.get(named, 0) + rows_
        n_blocks = sum(r[-2] for r in found)
        repeated = _repeated(blocks, sum(r[-1] for r in found)) if unique else 0
        kinds = [blocks.schema[name] for name in (*groups, RANGE)]
        shape = StructType([*[StructField(f"{k.name} ", k.dataType) for k in kinds], StructField("offset", LongType())])
        known = rows.sparkSession.createDataFrame(offsets, shape)
        same = reduce(lambda a, b: a & b, [F.col(k.name).eqNullSafe(F.col(f"`{k.name} `")) for k in kinds])
        listed = blocks.join(F.broadcast(known), same).withColumn("before", F.col("offset") + F.col("low"))
        listed = _in_files(listed.select(*blocks.columns, "before"), n_blocks, [*groups, "before"])
        listed.write.mode("overwrite").parquet(f"{path}/blocks")
    finally:
        blocks.unpersist()
    return repeated


def _in_files(listed: DataFrame, n_blocks: int, in_order: list[str]) -> DataFrame:
    """The list in order, a partition per ``LIST_ROWS`` blocks.

    A single one takes a shuffle too: one task that coalesces all ranges would join
    each of them, and hold the joined offsets once per range.
    """
    n_files = max(1, -(-n_blocks // LIST_ROWS))
    cut = listed.repartition(1) if n_files == 1 else listed.repartitionByRange(n_files, *in_order)
    return cut.sortWithinPartitions(*in_order)


def _repeated(blocks: DataFrame, nulls: int) -> int:
    """Rows beyond the first of each key; NULL keys form one group.

    Equal keys are neighbours: repeats lie within a block, or a key is the first or
    last one of several blocks.
    """
    inside = blocks.agg(F.sum(F.col("rows") - F.col("nulls") - F.col("keys"))).first()[0] or 0
    ends = blocks.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("key")).where("key IS NOT NULL")
    across = ends.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n")).first()[0] or 0
    return inside + across + max(0, nulls - 1)


class RangedTable:
    """Reads of a ranged table. The blocks a read collects are no more than the rows it may return, and two."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.blocks = spark.read.parquet(f"{path}/blocks")

    @cached_property
    def schema(self) -> StructType:
        """Of the rows, with their range and place."""
        return self.spark.read.parquet(f"{self.path}/rows").schema

    def placed(self) -> DataFrame:
        """All rows, with their range and place."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All rows, as they were before they were written."""
        return self.placed().drop(RANGE, PLACE)

    def total(self, group: Any = None) -> int:
        """Number of rows, of one group when given."""
        return self._of(group).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]

    def at_rank(self, skip: int, limit: int, group: Any = None) -> DataFrame:
        """``limit`` rows in order after the first ``skip``, of one group when given."""
        _check_bounds(skip, limit)
        if group is None and "group" in self.blocks.columns:
            raise ValueError("a table with groups has ranks within a group only")
        return self._ordered(self._at_rank(self._of(group), skip, limit), limit)

    def equal(self, value: Any, key: str = "_id", limit: int = 1) -> DataFrame:
        """At most ``limit`` rows whose key is ``value``, the first ones in order."""
        _check_bounds(0, limit)
        if value is None:
            return self._none()
        inside = (F.col("first") <= F.lit(value)) & (F.col("last") >= F.lit(value))
        # Of the blocks that the key fills the first are enough; two may only reach up to it.
        spans, sure = [], 0
        for block in self.blocks.where(inside).orderBy("before").limit(limit + 2).collect():
            if sure < limit:
                spans.append((block, block["low"], block["low"] + block["rows"] - 1))
                filled = block["first"] == block["last"] and not block["nulls"]
                sure += block["rows"] if filled else block["last"] == value
        return self._ordered(spans, limit, F.col(f"`{key}`") == F.lit(value))

    def after(self, value: Any, limit: int, key: str = "_id", group: Any = None) -> DataFrame:
        """The next ``limit`` rows in order whose key is greater than ``value``; NULL or empty starts at the beginning."""
        if value is None or value == "":
            return self.at_rank(0, limit, group)
        _check_bounds(0, limit)
        beyond = self._of(group).where(F.col("last") > F.lit(value)).orderBy("before")
        found, sure = [], 0
        for block in beyond.limit(limit + 1).collect():
            if sure < limit:
                found.append((block, block["low"], block["low"] + block["rows"] - 1))
                sure += block["rows"] if block["first"] > value else 1
        return self._ordered(found, limit, F.col(f"`{key}`") > F.lit(value))

    def at_places(self, places: Iterable[tuple[str, int, int]]) -> DataFrame:
        """The rows at some places (file, range, place), with these; a place that does not exist gives no row."""
        places = list(places)
        if not places:
            return self._none_placed()
        by_range: dict[int, list[int]] = {}
        for _, number, place in places:
            by_range.setdefault(number, []).append(place)
        wanted = [(F.col(RANGE) == number) & F.col(PLACE).isin(own) for number, own in by_range.items()]
        return self._opened({file for file, _, _ in places}).where(reduce(lambda a, b: a | b, wanted))

    def _opened(self, files: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{file}" for file in sorted(files)])

    # -- blocks ------------------------------------------------------------------------------------

    def _of(self, group: Any) -> DataFrame:
        return self.blocks if group is None else self.blocks.where(F.col("group") == F.lit(group))

    @staticmethod
    def _at_rank(blocks: DataFrame, skip: int, limit: int) -> list[tuple[Row, int, int]]:
        """Blocks with the first and last place wanted of each."""
        held = blocks.where((F.col("before") < skip + limit) & (F.col("before") + F.col("rows") > skip)).collect()
        return [
            (
                block,
                block["low"] + max(0, skip - block["before"]),
                block["low"] + min(block["rows"], skip + limit - block["before"]) - 1,
            )
            for block in held
        ]

    def _ordered(self, spans: list[tuple[Row, int, int]], limit: int, condition: Column | None = None) -> DataFrame:
        """Rows at spans of places, in order."""
        if not spans:
            return self._none()
        rows = self._opened({block["file"] for block, _, _ in spans})
        wanted = [(F.col(RANGE) == block[RANGE]) & F.col(PLACE).between(low, high) for block, low, high in spans]
        rows = rows.where(reduce(lambda a, b: a | b, wanted))
        if condition is not None:
            rows = rows.where(condition)
        return rows.orderBy(RANGE, PLACE).limit(limit).drop(RANGE, PLACE)

    def _none_placed(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _none(self) -> DataFrame:
        return self._none_placed().drop(RANGE, PLACE)


def _check_bounds(skip: int, limit: int) -> None:
    if skip < 0 or limit < 1:
        raise ValueError(f"skip must not be negative and limit at least 1, got {skip} and {limit}")
