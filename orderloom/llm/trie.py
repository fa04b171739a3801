"""The prefix trie of conversations, with totals over subtrees.

A node is a distinct sequence of first turns. Its number is a pair of 64-bit sums:
the digest of each turn times a power of an odd number that grows with the turn's
place, so that the number of any prefix follows from sums over the sorted turns,
also where a conversation's turns lie in several partitions or its beginning is
replaced. A node is then named by its smallest conversation and its depth, and the
ancestors of a node are the nodes of that conversation at smaller depths.

Totals over subtrees roll up in bands of depths. A node adds to its ancestors in
its own band only; the first nodes of the bands form a trie themselves, of a depth
smaller by the height of a band, which is totalled in the same way; their complete
totals then go to the ancestors in the band above. So a node makes at most a band
of rows, and the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.landing import land

# Conversations of a block share the beginning of the block's first one, of fewer turns than SHARED.
BLOCK = 100
SHARED = 6
BAND = 16
# Conversations that end in a node are listed in runs of neighbouring numbers, at most 2^9 each.
RUN_BITS = 9

ODD = 0xD6E8FEB86659FD93
TABLE = 1 << 16
_low = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(TABLE - 1, ODD, np.uint64)]))
_high = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(TABLE - 1, pow(ODD, TABLE, 2**64), np.uint64)]))
_back = np.array([pow(ODD, -n, 2**64) for n in range(SHARED)], np.uint64)


def powers(places: np.ndarray) -> np.ndarray:
    """Powers of the odd number, for places below 2^32."""
    return _low[places % TABLE] * _high[places // TABLE]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _words(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _longs(batch, name).view(np.uint64)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


# -- turns in order ---------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn with its place ``p`` in its conversation, the sums ``a`` and ``b`` up to it, and its ``chars``.

    Turns are sorted into ranges, so a conversation of any length may span several.
    """
    said = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in (role, text)]
    named = F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said)
    rows = conversations.select(
        F.col(f"`{conv}`").cast("bigint").alias("c"),
        F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.unhex(F.md5(named.cast("binary"))).alias("digest"),
        F.length(said[1]).cast("bigint").alias("chars"),
        F.monotonically_increasing_id().alias("row"),  # lets equal turns fall into several ranges
    ).where("c IS NOT NULL")
    order = ["c", F.asc_nulls_first("turn"), "digest", "row"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "digest", "chars")
    local = land(ranges.mapInArrow(_summed, "c bigint, p bigint, chars bigint, a bigint, b bigint, part bigint"))
    last = F.struct("c", "p", "a", "b")
    found = local.groupBy("part").agg(F.min("c").alias("first"), F.max(last).alias("last")).collect()  # a row per range
    carried = _carried(sorted((r["part"], r["first"], *r["last"]) for r in found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                conv_, part = _longs(batch, "c"), _longs(batch, "part")
                place, a, b = _longs(batch, "p"), _words(batch, "a").copy(), _words(batch, "b").copy()
                for number in np.unique(part):
                    if number in carried:
                        first, n, a0, b0 = carried[number]
                        at = (part == number) & (conv_ == first)
                        factor = powers(np.array([n]))[0]
                        place[at] += n
                        a[at] = np.uint64(a0) + factor * a[at]
                        b[at] = np.uint64(b0) + factor * b[at]
                yield _batch(c=conv_, p=place, chars=_longs(batch, "chars"), a=a, b=b)

    return local.mapInArrow(run, "c bigint, p bigint, chars bigint, a bigint, b bigint")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and sums within a range, whose turns come in order."""
    part, current, count, sums = TaskContext.get().partitionId(), None, 0, [np.uint64(0), np.uint64(0)]
    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = _longs(batch, "c")
            digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            fresh = np.concatenate([[conv[0] != current], conv[1:] != conv[:-1]])
            starts = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
            goes_on = np.cumsum(fresh) == 0  # the turns of the conversation that the last batch ended in
            place = np.arange(len(conv)) - starts + 1 + goes_on * count
            totals = []
            for i in range(2):
                sum_ = np.cumsum(digests[:, i] * powers(place))
                before = np.concatenate([[np.uint64(0)], sum_])[starts]
                totals.append(sum_ - before + np.where(goes_on, sums[i], np.uint64(0)))
            yield _batch(c=conv, p=place, chars=_longs(batch, "chars"), a=totals[0], b=totals[1], part=np.full(len(conv), part))
            current, count, sums = conv[-1], int(place[-1]), [t[-1] for t in totals]


def _carried(ranges: list[tuple]) -> dict[int, tuple[int, int, int, int]]:
    """Per range whose first conversation began before it: that conversation, its turns so far and their sums."""
    carried: dict[int, tuple[int, int, int, int]] = {}
    open_ = None
    for part, first, conv, count, a, b in ranges:
        a, b = a % 2**64, b % 2**64
        if open_ and open_[0] == first:
            carried[part] = open_
            if conv == first:
                factor = pow(ODD, open_[1], 2**64)
                count, a, b = count + open_[1], (open_[2] + factor * a) % 2**64, (open_[3] + factor * b) % 2**64
        open_ = (conv, count, a, b)
    return carried


# -- rebuilt conversations ---------------------------------------------------------------------------


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the rebuilt conversations (``c``, ``depth``, ``a``, ``b``, ``chars``, ``last``), and all conversations with their ``depth``."""
    convs = land(
        turns.groupBy("c").agg(
            F.max("p").alias("n"),
            # Fewer than SHARED places.
            F.sort_array(F.collect_list(F.when(F.col("p") < SHARED, F.struct("p", "a", "b", "chars")))).alias("head"),
        )
    )
    first = convs.select(F.col("c").alias("base"), F.col("head").alias("shared"))
    h = (F.crc32(F.col("c").cast("string")) % SHARED).cast("int")
    plans = land(
        convs.withColumn("h", h)
        .withColumn("base", F.col("c") - F.col("c") % BLOCK)
        .join(first, "base", "left")
        .withColumn("m", F.least("h", F.coalesce(F.size("shared"), F.lit(0))).cast("bigint"))
        .withColumn("m", F.greatest("m", F.lit(0)))
        .withColumn("depth", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select(
            "c", "n", "h", "m", "depth", F.expr("slice(shared, 1, cast(m as int))").alias("shared"),
            F.get("head", F.col("h") - 1).alias("cut"),
        )
    )
    lead = plans.where("m > 0").select("c", "depth", F.explode("shared").alias("s"))
    lead = lead.select("c", F.col("s.p").alias("depth"), "s.a", "s.b", "s.chars", (F.col("s.p") == F.col("depth")).alias("last"))
    zero = F.lit(0).cast("bigint")
    start = F.get("shared", (F.col("m") - 1).cast("int"))
    ways = plans.where("n > h").select(
        "c", F.col("h").cast("bigint").alias("h"), "m", F.col("depth").alias("whole"),
        *[F.coalesce(F.col(f"cut.{x}"), zero).alias(f"cut_{x}") for x in "ab"],
        *[F.coalesce(start[x], zero).alias(f"start_{x}") for x in "ab"],
    )
    own = turns.join(ways, "c").where("p > h")
    moved = own.mapInArrow(_moved, "c bigint, depth bigint, a bigint, b bigint, chars bigint, last boolean")
    return land(lead.unionByName(moved)), plans.select("c", "depth")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns behind the shared ones: places shift, and sums start from those of the shared turns."""
    with np.errstate(over="ignore"):
        for batch in batches:
            h, m = _longs(batch, "h"), _longs(batch, "m")
            back = _back[h - m]
            sums = {x: _words(batch, f"start_{x}") + back * (_words(batch, x) - _words(batch, f"cut_{x}")) for x in "ab"}
            depth = _longs(batch, "p") - h + m
            yield _batch(
                c=_longs(batch, "c"), depth=depth, a=sums["a"], b=sums["b"], chars=_longs(batch, "chars"), last=depth == _longs(batch, "whole")
            )


# -- nodes and their totals --------------------------------------------------------------------------

NODE = ["depth", "a", "b"]


def trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    Columns ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``; the first and third are called so
    whatever the names of the input's columns, and others are not read.

    Turns go by ``turn``, NULL first, and equal ones by the digest of role and text.
    NULL roles and texts are empty, and differ from nothing else that is empty.
    Repeated rows are turns of their own. Rows without a conversation are left out.
    An empty table gives no rows.
    """
    members, convs = rebuilt(ordered_turns(conversations, conv, turn, role, text))
    summary = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("depth").alias("deepest")).first()
    root, deepest = F.lit(summary["low"]).cast("bigint"), summary["deepest"] or 0
    nodes = land(
        members.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("chars").alias("chars"))
    )
    paths = land(_paths(members, nodes, root))
    above = paths.select(F.col("c").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent_conv_id"))
    zero = F.lit(0).cast("bigint")
    top = convs.sparkSession.range(1 if summary["n"] else 0).select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(summary["n"]).cast("bigint").alias("n_convs"),
        root.alias("conv_id"), zero.alias("chars"), F.lit(None).cast("bigint").alias("parent_conv_id"),
    )
    placed = land(nodes.join(above, ["conv_id", "depth"], "left").unionByName(top))
    children = (
        placed.where("depth > 0")
        .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    counted = land(
        placed.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    )
    own = counted.select(
        "conv_id",
        "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = rolled_up(own, paths, deepest)
    ends = _ends(members.where("last").select("c", *NODE).unionByName(convs.where("depth = 0").select("c", "depth", zero.alias("a"), zero.alias("b"))))
    return (
        counted.join(totals, ["conv_id", "depth"])
        .join(ends, NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def _paths(members: DataFrame, nodes: DataFrame, root: Column) -> DataFrame:
    """Of the conversations that name a node: the node (``label``) they are in at each depth."""
    names = nodes.select(F.col("conv_id").alias("c")).distinct()
    own = members.select("c", *NODE).join(names, "c", "left_semi")
    named = own.join(nodes.select(*NODE, F.col("conv_id").alias("label")), NODE).select("c", "depth", "label")
    return named.unionByName(names.select("c", F.lit(0).cast("bigint").alias("depth"), root.alias("label")))


def rolled_up(own: DataFrame, paths: DataFrame, deepest: int, band: int = BAND, step: int = 1) -> DataFrame:
    """Sums over subtrees of all columns of ``own`` but ``conv_id`` and ``depth``, which are multiples of ``step``."""
    values = [c for c in own.columns if c not in ("conv_id", "depth")]
    height = band * step

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("conv_id", "depth").agg(*[F.sum(v).alias(v) for v in values])

    def handed_up(rows: DataFrame, low: str, high: str) -> DataFrame:
        """Each row at the depths from low to high of its own path."""
        spread = rows.withColumn("at", F.explode(F.expr(f"sequence({low}, {high}, {step}L)")))
        to = paths.select(F.col("c").alias("conv_id"), F.col("depth").alias("at"), "label")
        return spread.join(to, ["conv_id", "at"]).select(F.col("label").alias("conv_id"), F.col("at").alias("depth"), *values)

    inside = summed(handed_up(own, f"depth - depth % {height}", "depth"))
    if deepest < height:
        return inside
    inside = land(inside)
    tops = inside.where(f"depth % {height} = 0")
    complete = land(rolled_up(tops, paths, deepest, band, height))
    from_below = handed_up(complete.where("depth > 0"), f"depth - {height - step}", f"depth - {step}")
    return summed(inside.where(f"depth % {height} <> 0").unionByName(from_below)).unionByName(complete)


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the numbers of the conversations that end in each node, in order, joined by commas.

    Numbers are joined in runs first; the runs of a node then pass through one digest
    in their order, a few at a time.
    """
    runs = rows.groupBy(*NODE, F.shiftright("c", RUN_BITS).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids")  # 2^RUN_BITS at most
    )
    in_order = runs.repartition(*NODE).sortWithinPartitions(*NODE, "run")
    return in_order.select(*NODE, "ids").mapInArrow(_digests, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, a, b, ids in zip(*[column.to_pylist() for column in batch.columns]):
            if (depth, a, b) == node:
                digest.update(f",{ids}".encode())
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = (depth, a, b), hashlib.sha256(ids.encode())
        yield _found(done)
    yield _found([] if node is None else [(*node, digest.hexdigest())])


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, [*NODE, "ends_sha256"])
