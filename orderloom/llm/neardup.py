"""Near-duplicate texts by BagMinHash signatures.

A text is the multiset of its shingles of five words. Every shingle owns Poisson
processes, one per interval of a dyadic ladder of weights; a point lies at a time,
in a register of the signature and at a weight, and counts if the text holds the
shingle at least that often. A register keeps its earliest point. The chance that
two texts agree in a register is the weighted Jaccard similarity of their
multisets. Bands of registers give candidates, whose overlap is then counted
exactly.

Equal texts are one from the start. In a bucket of texts that share a band each
text meets hubs, not all others, and then a text of the largest class. Of the pairs
left in different classes, those that may share enough of their rarest shingles are
compared too, so that every two texts that share a band are accounted for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.landing import land

WORDS = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^6)^26 = 0.9996, one of 0.85 with 1 - 5e-6.
BANDS, BAND_SIZE = 26, 6
REGISTERS = BANDS * BAND_SIZE
# Times that the texts of a bucket meet one of its largest class, after their hubs.
ROUNDS = 2
# A register stays empty until the first horizon with probability e^-6.
SAFETY = 6.0

ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses, for n places."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 14)
        steps = np.full(size, ODD, np.uint64)
        back = np.full(size, pow(ODD, -1, 2**64), np.uint64)
        steps[0] = back[0] = 1
        _powers, _inverses = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _powers, _inverses


def shingles(text: str | None) -> np.ndarray:
    """A 64-bit number for each run of five words; a shorter text is one run, one without words has none.

    Words are what stands between white space and control characters of ASCII.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    inside = data > 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _ladder(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    words = _mixed((sums[ends] - sums[starts]) * inverses[starts])
    n = min(WORDS, len(words))
    runs = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        runs = _mixed(runs + words[i : len(words) - n + 1 + i] + np.uint64(n))
    return runs


def signature(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Earliest time per register over the points of all elements with their counts."""
    registers = np.full(REGISTERS, np.inf)
    # Intervals (0, 1], (1, 2], (2, 4], (4, 8] ... of weight, as far as each element reaches.
    seeds, lows, widths, reach = [elements], [np.zeros(len(elements))], [np.ones(len(elements))], [counts]
    low = 1
    while (more := counts > low).any():
        seeds.append(_mixed(elements[more] + np.uint64(low)))
        lows.append(np.full(more.sum(), float(low)))
        widths.append(np.full(more.sum(), float(low)))
        reach.append(counts[more])
        low *= 2
    seed, low_, width, most = (np.concatenate(c) for c in (seeds, lows, widths, reach))
    now, drawn = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    horizon = (np.log(REGISTERS) + SAFETY) / counts.sum()
    while True:
        active = np.flatnonzero(now <= horizon)
        while len(active):
            block = int(np.ceil(REGISTERS * float(width[active].mean()) * (horizon - float(now[active].min())))) + 1
            block = min(block, 256)
            number = drawn[active, None] + np.arange(1, block + 1, dtype=np.uint64)
            draw = _mixed(seed[active, None] + number * np.uint64(ODD))
            gaps = -np.log(((draw >> np.uint64(32)).astype(float) + 1.0) / 2**32) / (REGISTERS * width[active, None])
            # One after the other from the last point, so that a point's time does not depend on the blocks.
            times = np.cumsum(np.concatenate([now[active, None], gaps], axis=1), axis=1)[:, 1:]
            register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32)
            counted = times <= horizon
            if (wide := width[active] > 1).any():
                place = (_mixed(draw) >> np.uint64(11)).astype(float) / 2**53
                weight = low_[active, None] + 1 + np.floor(place * width[active, None])
                counted &= ~wide[:, None] | (weight <= most[active, None])
            np.minimum.at(registers, register[counted], times[counted])
            now[active], drawn[active] = times[:, -1], drawn[active] + np.uint64(block)
            active = active[now[active] <= horizon]
        if np.isfinite(registers).all():
            return registers
        horizon *= 2
        # Points beyond the old horizon were passed over: go through them once more.
        now, drawn = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)


def bands(text: str | None) -> tuple[np.ndarray, int]:
    """A 64-bit key per band, and the number of shingles; no keys without words."""
    runs = shingles(text)
    if not len(runs):
        return np.zeros(0, np.int64), 0
    registers = signature(*np.unique(runs, return_counts=True)).view(np.uint64).reshape(BANDS, BAND_SIZE)
    keys = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(BAND_SIZE):
        keys = _mixed(keys + registers[:, i])
    return keys.view(np.int64), len(runs)


def overlap(left: str, right: str) -> tuple[int, int, int]:
    """Shared shingles of two texts, and the number of each text's."""
    (a, m), (b, n) = (np.unique(shingles(t), return_counts=True) for t in (left, right))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum()), int(m.sum()), int(n.sum())


def similarity(left: str, right: str) -> float:
    """Weighted Jaccard similarity of the shingles of two texts."""
    shared, m, n = overlap(left, right)
    return shared / max(1, m + n - shared)


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: ``key``, ``digest`` of its text, ``class_id`` and whether it is the one to keep.

    Texts whose similarity is ``least`` or more are linked, and a class is what
    links connect. The class id is the smallest key in the class (NULL only if all
    its keys are NULL); ``keep`` is true for the rows of the class that have that
    key and, among them, the smallest digest, so repeated rows share it.

    A NULL text counts as empty. Texts without words are alike only if equal; a
    text of fewer than five words is one shingle. An empty table gives no rows.
    """
    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    signed = land(
        rows.select("k", F.unhex(F.md5(F.col("t").cast("binary"))).alias("d"), "t").mapInArrow(
            _signed, f"k {rows.schema['k'].dataType.simpleString()}, d binary, n bigint, bands array<bigint>"
        )
    )
    texts = signed.groupBy("d").agg(F.max("n").alias("n"), F.max("bands").alias("bands"))
    members = texts.select("d", "n", F.explode("bands").alias("bucket"))
    labels = _linked(members, rows.select(F.unhex(F.md5(F.col("t").cast("binary"))).alias("d"), "t"), least)

    labelled = signed.select("k", "d").join(labels, "d", "left").withColumn("c", F.coalesce("c", "d"))
    heads = labelled.groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "d")).alias("head"))
    return labelled.join(heads, "c").select(
        F.col("k").alias(key),
        F.col("d").alias("digest"),
        F.col("head.k").alias("class_id"),
        (F.col("k").eqNullSafe(F.col("head.k")) & (F.col("d") == F.col("head.d"))).alias("keep"),
    )


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents, one of each class: the one with the smallest key (then the smallest digest).

    All columns stay. Rows that repeat a kept key and text are one row; of NULL
    keys too one row per class stays.
    """
    found = classes(documents, key, text, least)
    gone = found.where(~F.col("keep")).select(F.col(key).alias("k "), F.col("digest").alias("d ")).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    marked = documents.withColumn("d ", digest)
    left = marked.join(gone, marked["d "].eqNullSafe(gone["d "]) & marked[key].eqNullSafe(gone["k "]), "left_anti")
    return left.dropDuplicates([key, "d "]).select(*[F.col(f"`{c}`") for c in documents.columns])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            found = [bands(text) for text in batch.column(2).to_pylist()]
            sizes = pa.array([n for _, n in found], pa.int64())
            keys = pa.array([k for k, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, keys], ["k", "d", "n", "bands"])


# -- links and classes ------------------------------------------------------------------------------


def _linked(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Class ``c`` of each text ``d`` that has a link; members are rows (bucket, d, n).

    Every two texts of a bucket end in one class, or are compared, or are ruled out
    by a bound: the shingles that both can still share from their first one in common.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowd = land(members.join(sizes, "bucket"))  # only buckets of several texts
    weights = crowd.groupBy("d").agg(F.sum("size").alias("weight"))
    weighed = crowd.join(weights, "d")
    heads = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "d")).alias("head"))
    # A text's hub is the head it shares most bands with.
    met = crowd.join(heads, "bucket").groupBy("d", "head").agg(F.count(F.lit(1)).alias("shared"))
    hubs = land(met.groupBy("d").agg(F.max(F.struct("shared", "head")).alias("best")).select("d", F.col("best.head.d").alias("h")))
    # The texts that any comparison may need, once each: all others are read and moved no more.
    bodies = land(texts.join(hubs.select("d").hint("merge"), "d", "left_semi").groupBy("d").agg(F.max("t").alias("t")))
    compared = land(_compared(hubs.where("d <> h"), bodies))
    labels = _components(_links(compared, least))

    # Few classes are left once each text has met one of its bucket's largest class.
    for _ in range(ROUNDS):
        mixed = land(_undecided(_placed(crowd.select("bucket", "d", "n"), labels)))
        first = land(_compared(_largest(mixed, least).join(compared.select("d", "h"), ["d", "h"], "left_anti"), bodies))
        labels = _joined(labels, _links(first, least))
    undecided = _undecided(_placed(crowd.select("bucket", "d", "n"), labels))
    still = land(undecided.groupBy("d", "c").agg(F.collect_set("bucket").alias("buckets")))
    last = land(_compared(_possible(still, bodies, compared, least), bodies))
    return _joined(labels, _links(last, least))


def _largest(mixed: DataFrame, least: float) -> DataFrame:
    """Pairs (d, h): h is a text of the class that most texts of d's bucket are in, of a size that fits; d is in another.

    Such a pair shares a bucket, so comparing it decides earlier, and not otherwise.
    """
    of_class = mixed.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("n", "d")).alias("head"))
    top = of_class.groupBy("bucket").agg(F.max(F.struct("size", "c", "head")).alias("top"))
    met = mixed.join(top, "bucket").where(F.col("c") != F.col("top.c")).select("d", "n", F.col("top.head.d").alias("h"), F.col("top.head.n").alias("m"))
    return met.where(F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9).select("d", "h").distinct()


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "d", "left").withColumn("c", F.coalesce("c", "d"))


def _undecided(placed: DataFrame) -> DataFrame:
    """The rows of buckets with texts of several classes."""
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return placed.join(mixed.select("bucket"), "bucket")


def _links(compared: DataFrame, least: float) -> DataFrame:
    return compared.where(F.col("o") >= least * (F.col("nd") + F.col("nh") - F.col("o")) - 1e-9).select(
        F.col("d").alias("a"), F.col("h").alias("b")
    )


def _possible(still: DataFrame, bodies: DataFrame, compared: DataFrame, least: float) -> DataFrame:
    """Pairs (d, h) of texts of one bucket and different classes that may be alike, by their rarest shingles.

    Each text is taken apart once. Its shingles are put in an order common to all:
    first those that only one class has, then by the number of texts. Behind the
    first shingle that two texts share lie all others that they do, so as many as
    like texts share must be left in both from there; it is among the first ones.
    """
    runs = still.join(bodies, "d").select("d", "c", "t").mapInArrow(_taken_apart, "d binary, c binary, n bigint, xs array<bigint>")
    each = land(runs).select("d", "c", "n", F.explode("xs").alias("x"))
    of_several = each.groupBy("x").agg(F.count(F.lit(1)).alias("f"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    shared = each.join(of_several.select("x", "f"), "x")
    of_text = W.partitionBy("d")
    place = F.col("n") - F.count(F.lit(1)).over(of_text) + F.row_number().over(of_text.orderBy("f", "x"))
    left = shared.withColumn("left", F.col("n") - place + 1).where(F.col("left") >= F.ceil(F.col("n") * least - 1e-9))
    rarest = land(left.select("d", "c", "n", "x", "left").join(still.select("d", "buckets"), "d"))
    one, other = (rarest.select(*[F.col(c).alias(c if c == "x" else name + c) for c in rarest.columns]) for name in "ul")
    # Texts of n and m shingles are alike if they share least / (1 + least) of n + m.
    enough = F.least("uleft", "lleft") * (1 + least) >= least * (F.col("un") + F.col("ln")) - 1e-9
    apart = (F.col("ud") > F.col("ld")) & (F.col("uc") != F.col("lc"))
    met = one.join(other, (one["x"] == other["x"]) & apart & enough & F.arrays_overlap("ubuckets", "lbuckets"))
    done = compared.select(F.greatest("d", "h").alias("d"), F.least("d", "h").alias("h"))
    return land(met.select(F.col("ud").alias("d"), F.col("ld").alias("h")).distinct().join(done.distinct(), ["d", "h"], "left_anti"))


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles, repeated ones told apart by a number."""
    with np.errstate(over="ignore"):
        for batch in batches:
            found = [_told_apart(*np.unique(shingles(text), return_counts=True)) for text in batch.column(2).to_pylist()]
            sizes = pa.array([len(xs) for xs in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), sizes, pa.array([xs.view(np.int64) for xs in found], pa.list_(pa.int64()))],
                ["d", "c", "n", "xs"],
            )


def _told_apart(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    which = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return _mixed(np.repeat(elements, counts) + which.astype(np.uint64) * np.uint64(ODD))


def _compared(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (d, h) with their overlap ``o`` and sizes ``nd`` and ``nh``."""
    left = bodies.select("d", F.col("t").alias("left"))
    right = bodies.select(F.col("d").alias("h"), F.col("t").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [overlap(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                numbers = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers], ["d", "h", "o", "nd", "nh"])

    both = pairs.join(left, "d").join(right, "h").select("d", "h", "left", "right")
    return both.mapInArrow(run, "d binary, h binary, o bigint, nd bigint, nh bigint")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links. Only links between different classes are followed, as links of their labels."""
    of = labels.select(F.col("d").alias("of"), F.col("c").alias("to"))

    def labelled(table: DataFrame, name: str) -> DataFrame:
        met = table.join(of, F.col(name) == F.col("of"), "left")
        return met.withColumn(name, F.coalesce("to", name)).drop("of", "to")

    between = land(labelled(labelled(links, "a"), "b").where("a <> b").distinct())
    roots = land(_components(between))
    moved = labels.join(roots.select(F.col("d").alias("c"), F.col("c").alias("root")), "c", "left")
    known = moved.select("d", F.coalesce("root", "c").alias("c"))
    # Texts that had no link so far stand for themselves among the roots.
    return land(known.unionByName(roots.join(labels.select("d"), "d", "left_anti")))


def _components(links: DataFrame) -> DataFrame:
    """The smallest text ``c`` that links connect each text ``d`` with.

    Labels spread along links, and every third time a text also takes the label of
    its label, so that long chains shorten.
    """
    steps = [F.struct(F.col(i).alias("d"), F.col(j).alias("o")) for i, j in ("ab", "ba", "aa", "bb")]
    edges = land(links.select(F.explode(F.array(*steps)).alias("e")).select("e.d", "e.o").distinct())
    labels, turn = edges.groupBy("d").agg(F.min("o").alias("c")), 1
    while True:
        known = land(labels).select(F.col("d").alias("o"), F.col("c").alias("oc"))
        own = F.max(F.when(F.col("o") == F.col("d"), F.col("oc")))
        spread = land(edges.join(known, "o").groupBy("d").agg(F.min("oc").alias("c"), own.alias("was")))
        labels = spread.select("d", "c")
        if spread.where("was <> c").isEmpty():
            return labels
        if turn % 3 == 0:
            heads = labels.select(F.col("d").alias("c"), F.col("c").alias("cc"))
            labels = labels.join(heads, "c").select("d", F.least("c", "cc").alias("c"))
        turn += 1
