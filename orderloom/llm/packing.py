"""Packing documents into training sequences of bounded length.

A document is its ids and one closing id. Only a document longer than a sequence
is cut, into full pieces with the shorter one first; full pieces are sequences of
their own. The others are packed by a grouping genetic algorithm: a child takes
whole well-filled bins of one parent into the other, bins that share a piece with
them are dissolved, and the displaced pieces go where they fit best.

Pieces fall at random into cells of bounded size. Several islands evolve each
cell's packing, and the elite of each migrates to the next island between epochs.
Bins that stay loose are dissolved, and their pieces are packed once more
together with those of other cells.
"""

from __future__ import annotations

import os
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.bpe import TextEncoder
from orderloom.operators.staging import settle

LENGTH = 2048
END_ID = 0
# Pieces of a cell, on average; it bounds what one task holds.
CELL = 2_000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 12
POPULATION = 6
# A bin with more room than this share of a sequence is loose.
LOOSE = 0.02


@cache
def tokenizer_encoder(path: str) -> TextEncoder:
    """One per Python worker; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return TextEncoder(lambda chunks: [found.ids for found in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])


def cut(ids: bytes, length: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of packed ids; the first may be shorter."""
    n = len(ids) // 4
    first = n % length or min(n, length)
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(
    documents: DataFrame, path: str, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``key``, ``piece`` from 0, ``start``, ``length``, ``ids_crc32``, and ``ids`` if asked for.

    A NULL or empty text is one piece that holds the closing id alone. Keys may be
    NULL or repeat. Other columns are not read; an empty table gives no rows.
    """
    names = ["k", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_encoder(path)
        closing = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a small part at a time bounds the ids held
                part = batch.slice(at, 256)
                rows, number, start, size, check, ids = [], [], [], [], [], []
                for row, body in enumerate(part.column(1).to_pylist()):
                    packed = encoder.packed(body) + closing
                    for i, (begin, n) in enumerate(cut(packed, length)):
                        data = packed[4 * begin : 4 * (begin + n)]
                        rows.append(row)
                        number.append(i)
                        start.append(begin)
                        size.append(n)
                        check.append(zlib.crc32(data))
                        if with_ids:
                            ids.append(np.frombuffer(data, "<i4"))
                columns = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in (start, size, check)]
                columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def pack(found: DataFrame, length: int = LENGTH, seed: int = 7) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: no sequence is longer than ``length``, none has a gap.

    ``found`` has a column ``length`` from 1 to ``length``; its other columns,
    repeated rows included, are passed on. An empty table gives no rows.
    """
    table = settle(found.withColumn("at", F.monotonically_increasing_id()))
    columns = [F.col(f"`{c}`") for c in found.columns]
    full = table.where(F.col("length") == length).select(*columns, (-F.col("at") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = table.where(F.col("length") < length)
    first = settle(_round(rest, found.columns, length, seed, 0))
    tight = first.where(f"room <= {int(LOOSE * length)}")
    second = _round(first.where(f"room > {int(LOOSE * length)}"), found.columns, length, seed + 1, 1)
    done = [t.select(*columns, "sequence_id", "offset") for t in (tight, second)]
    return full.unionByName(done[0]).unionByName(done[1])


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of pieces with ``ids``: ``sequence_id``, ``ids``, and where its pieces start (``starts``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence is bounded by its length
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))


def _round(items: DataFrame, names: list[str], length: int, seed: int, number: int) -> DataFrame:
    """Pack the rows in cells: their columns ``names``, ``at``, ``sequence_id``, ``offset``, and the ``room`` of their bin."""
    n_cells = max(1, -(-items.count() // CELL))
    dealt = items.select(*[F.col(f"`{c}`") for c in names], "at").withColumn(
        "cell", F.pmod(F.xxhash64(F.col("at"), F.lit(seed)), F.lit(n_cells))
    )
    # Within a cell a piece is known by its place in the order of ``at``.
    cells = dealt.groupBy("cell").applyInPandas(_sizes, "cell bigint, sizes binary")
    islands = settle(cells.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("genes", F.lit(None).cast("binary")))
    for epoch in range(EPOCHS):
        evolved = islands.mapInPandas(
            _evolution(length, seed + 1000 * epoch), "cell bigint, sizes binary, island int, genes binary, fitness double"
        )
        islands = settle(evolved)
        if epoch + 1 < EPOCHS:
            arriving = islands.select("cell", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), F.col("genes").alias("more"))
            islands = islands.join(arriving, ["cell", "island"]).select(
                "cell", "sizes", "island", F.concat("genes", "more").alias("genes")
            )
    best = islands.groupBy("cell").agg(F.max_by("genes", F.struct("fitness", "island")).alias("genes"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*names, "at"]) + ", sequence_id bigint, offset bigint, room bigint"
    return dealt.groupBy("cell").cogroup(best.groupBy("cell")).applyInArrow(_placing(length, number, names), schema)


def _sizes(rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows.sort_values("at")
    return pd.DataFrame({"cell": [ordered["cell"].iloc[0]], "sizes": [ordered["length"].to_numpy(np.int32).tobytes()]})


def _placing(length: int, number: int, names: list[str]) -> Callable:
    def place(rows: pa.Table, best: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        sizes = rows["length"].to_numpy().astype(np.int64)
        genes = np.frombuffer(best["genes"][0].as_py(), np.int32, len(sizes))
        fill = np.bincount(genes, sizes).astype(np.int64)
        order = np.argsort(genes, kind="stable")
        ends = np.cumsum(sizes[order])
        starts = np.concatenate([[0], np.cumsum(fill)])[genes[order]]
        offsets = np.empty(len(sizes), np.int64)
        offsets[order] = ends - sizes[order] - starts
        cell = int(rows["cell"][0].as_py())
        ids = (number << 60) + (cell << 24) + genes.astype(np.int64)
        kept = rows.select([*names, "at"])
        for name, values in (("sequence_id", ids), ("offset", offsets), ("room", (length - fill)[genes])):
            kept = kept.append_column(name, pa.array(values))
        return kept

    return place


# -- the genetic algorithm; genes are the bin of each piece, numbered from 0 ------------------------


def best_fit(sizes: np.ndarray, genes: np.ndarray, loose: np.ndarray, length: int) -> np.ndarray:
    """Put the pieces ``loose``, in the given order, where the least room stays; other genes are kept."""
    genes = genes.copy()
    fill = np.bincount(genes[genes >= 0], sizes[genes >= 0]).astype(np.int64) if (genes >= 0).any() else np.zeros(0, np.int64)
    used = np.flatnonzero(fill)
    room = sorted(((length - fill[used]) << 32 | used).tolist())
    fresh = len(fill)
    for piece in loose.tolist():
        size = int(sizes[piece])
        at = bisect_left(room, size << 32)
        if at < len(room):
            packed = room.pop(at)
            bin_, left = packed & 0xFFFFFFFF, (packed >> 32) - size
        else:
            bin_, left, fresh = fresh, length - size, fresh + 1
        genes[piece] = bin_
        if left:
            insort(room, left << 32 | bin_)
    return np.unique(genes, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, genes: np.ndarray, length: int) -> float:
    """Mean of squared fills: fewer bins and fuller ones are better."""
    fill = np.bincount(genes, sizes) / length
    return float(np.mean(fill * fill))


def crossover(sizes: np.ndarray, into: np.ndarray, giver: np.ndarray, length: int, chance: random.Random) -> np.ndarray:
    """Whole well-filled bins of ``giver`` in ``into``; pieces displaced by them are best-fitted."""
    fill = np.bincount(giver, sizes)
    order = np.argsort(-fill, kind="stable")
    best = order[: max(1, len(order) // 2)]
    taken = np.array(chance.sample(best.tolist(), max(1, len(best) // 2)))
    moved = np.isin(giver, taken)
    hit = np.isin(into, into[moved])  # bins that hold a piece twice now
    child = into.astype(np.int64)
    child[moved] = giver[moved] + len(sizes)
    loose = np.flatnonzero(hit & ~moved)
    child[loose] = -1
    kept = child >= 0
    child[kept] = np.unique(child[kept], return_inverse=True)[1]
    return best_fit(sizes, child, loose[np.argsort(-sizes[loose], kind="stable")], length)


def mutated(sizes: np.ndarray, genes: np.ndarray, length: int, chance: random.Random) -> np.ndarray:
    """The emptiest bin and a few at random are dissolved and best-fitted."""
    fill = np.bincount(genes, sizes)
    gone = {int(np.argmin(fill)), *(chance.randrange(len(fill)) for _ in range(3))}
    loose = np.flatnonzero(np.isin(genes, list(gone)))
    child = genes.astype(np.int64)
    child[loose] = -1
    return best_fit(sizes, child, loose[np.argsort(-sizes[loose], kind="stable")], length)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], length: int, chance: random.Random) -> np.ndarray:
    """The best packing of an island after some generations, or as soon as no fewer bins are possible."""
    least = -(-int(sizes.sum()) // length)
    none = np.full(len(sizes), -1, np.int64)
    people = elites or [best_fit(sizes, none, np.argsort(-sizes, kind="stable"), length)]
    best = max(people, key=lambda genes: fitness(sizes, genes, length))
    if best.max() + 1 == least:
        return best
    while len(people) < POPULATION:
        blurred = sizes * np.array([1 + chance.random() / 4 for _ in range(len(sizes))])
        people.append(best_fit(sizes, none, np.argsort(-blurred, kind="stable"), length))
    for _ in range(GENERATIONS):
        children = [crossover(sizes, *chance.sample(people, 2), length, chance) for _ in range(POPULATION // 2)]
        children += [mutated(sizes, chance.choice(people), length, chance) for _ in range(POPULATION // 4)]
        people = sorted(people + children, key=lambda genes: -fitness(sizes, genes, length))[:POPULATION]
        if people[0].max() + 1 == least:
            break
    return people[0]


def _evolution(length: int, seed: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            genes, fits = [], []
            for cell, data, island, known in zip(rows["cell"], rows["sizes"], rows["island"], rows["genes"]):
                sizes = np.frombuffer(data, np.int32).astype(np.int64)
                elites = list(np.frombuffer(known, np.int32).reshape(-1, len(sizes))) if known is not None else []
                best = evolve(sizes, elites, length, random.Random(f"{seed} {cell} {island}"))
                genes.append(best.astype(np.int32).tobytes())
                fits.append(fitness(sizes, best, length))
            yield rows[["cell", "sizes", "island"]].assign(genes=genes, fitness=fits)

    return run
