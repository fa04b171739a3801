"""Quality of documents: naive Bayes features under a linear hinge-loss model.

A document is the set of its n-grams of bytes, hashed into a fixed number of
slots. Slots are scaled by the class log-count ratio over all labelled rows, and a
linear model is fitted on them by dual coordinate descent, on a sample of labelled
rows of bounded size. A held-back part of that sample turns margins into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
LARGEST_GRAM = 4
# Longest n-gram of marks "the same word as the one before"; each has a slot of its own.
LARGEST_REPEAT = 6
# A text with fewer slots is scaled like one with so many, so that little text is weak evidence.
LEAST_SIZE = 256
# Rows that the linear model is fitted on, and turned into probabilities with, at most.
SAMPLE_ROWS = 8_000
# Slots of these rows together, at most (and those of one more row): 64 MB.
SAMPLE_SLOTS = 1 << 24
CALIBRATION_SHARE = 0.25
SMOOTHING = 1.0
PENALTY = 1.0
PASSES = 12
THRESHOLD = 0.3


def size(slots: np.ndarray) -> float:
    """What a document's slots are divided by."""
    return float(np.sqrt(max(LEAST_SIZE, len(slots))))


class Grams:
    """Slots of a text's n-grams; keeps one array of marks."""

    def __init__(self) -> None:
        self.marks = np.zeros(SLOTS, bool)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        gram = np.zeros(len(data), np.uint32)
        for n in range(1, LARGEST_GRAM + 1):
            if len(data) < n:
                break
            gram = gram[: len(data) - n + 1] * np.uint32(263) + data[n - 1 :] + np.uint32(n)
            self.marks[(gram * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)] = True
        words = text.split()
        same = bytes(map(eq, words, words[1:]))
        for n in range(1, LARGEST_REPEAT + 1):
            if b"\1" * n not in same:
                break
            self.marks[n] = True
        found = np.flatnonzero(self.marks)
        self.marks[found] = False
        return found.astype(np.int32)


@dataclass
class Model:
    """Weight of each slot, and what turns a margin into the probability of label 1."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum()) / size(slots) + self.bias

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -30, 30))))


def learnable(key: str) -> F.Column:
    """Rows whose label may be learned from; the others are held out."""
    return ~held_out(key)


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of ``label`` (0 or 1), learned from the labelled rows that are not held out.

    Of repeated labels of a document the lowest counts; of repeated documents one
    counts (the text that sorts last). NULL keys, labels and other label values
    teach nothing; a NULL text is empty. N-grams are counted over all labelled rows;
    the linear model is fitted, in one task, on SAMPLE_ROWS rows by a hash of their
    key, and of these on the first with SAMPLE_SLOTS slots together. Without rows of both classes every score
    is the (smoothed) share of label 1.
    """
    marks = (
        labels.where(learnable(key) & F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("k"))
        .agg(F.min(label).cast("int").alias("y"))
    )
    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    counts = (
        rows.join(marks.hint("merge"), "k")  # labels grow with the documents: no plan that suits few of them only
        .select("t", "y")
        .mapInArrow(_counted, "slot int, ones bigint, zeros bigint")
        .groupBy("slot")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .toPandas()  # a row per slot and one for the documents, whatever the input
    )
    ones, zeros = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    ones[counts["slot"]], zeros[counts["slot"]] = counts["ones"], counts["zeros"]
    share = (ones[SLOTS] + 1) / (ones[SLOTS] + zeros[SLOTS] + 2)
    untaught = Model(np.zeros(SLOTS), 0.0, 0.0, float(np.log(share / (1 - share))))
    if not ones[SLOTS] or not zeros[SLOTS]:
        return untaught
    positive, negative = ones[:SLOTS] + SMOOTHING, zeros[:SLOTS] + SMOOTHING
    ratios = np.log(positive / positive.sum()) - np.log(negative / negative.sum())

    chosen = marks.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(SAMPLE_ROWS)
    sample = (
        rows.join(F.broadcast(chosen), "k")  # at most SAMPLE_ROWS rows
        .groupBy("h", "k")
        .agg(F.max("t").alias("t"), F.max("y").alias("y"))
        .select("h", F.col("k").cast("string").alias("k"), "y", "t")
        .mapInArrow(_slots, "h bigint, k string, y int, slots binary")
    )
    return _fitted_in_a_task(sample, ratios) or untaught


def _fitted_in_a_task(sample: DataFrame, ratios: np.ndarray) -> Model | None:
    """The model of the sample's first SAMPLE_SLOTS slots, fitted by one task; only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, held = [], 0
        for batch in batches:
            for key, label, slots in zip(batch.column("k").to_pylist(), batch.column("y").to_pylist(), batch.column("slots")):
                if held < SAMPLE_SLOTS:
                    taken.append((key, label * 2 - 1, np.frombuffer(slots.as_py(), np.int32)))
                    held += len(taken[-1][2])
        taken.sort(key=lambda row: row[0])
        model = _fitted([slots for _, _, slots in taken], np.array([y for _, y, _ in taken]), ratios) if taken else None
        found = [] if model is None else [(model.weights.tobytes(), model.bias, model.slope, model.shift)]
        kinds = [pa.binary(), pa.float64(), pa.float64(), pa.float64()]
        columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "bias", "slope", "shift"])

    in_order = sample.repartition(1).sortWithinPartitions("h", "k")  # bounded by SAMPLE_ROWS rows
    row = in_order.mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    return row and Model(np.frombuffer(row["weights"], np.float64), row["bias"], row["slope"], row["shift"])


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    All columns and rows stay, except that columns of these two names are
    replaced. A NULL text scores as an empty one. Only the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            scores = [model.score(grams(body or "")) for body in batch.column("text ").to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("score", "predicted")]
    rows = documents.select(*kept, F.col(text).cast("string").alias("text "))
    schema = documents.select(*kept).schema.add("score", "double")
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per slot, of one partition; the last slot counts all documents."""
    counts, grams = np.zeros((2, SLOTS + 1), np.int64), Grams()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label, grams(text)] += 1
            counts[label, SLOTS] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(counts[1, used]), pa.array(counts[0, used])], ["slot", "ones", "zeros"]
    )


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # a small part at a time bounds what is held
            part = batch.slice(at, 64)
            slots = [grams(text).tobytes() for text in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(slots, pa.binary())], ["h", "k", "y", "slots"])


def _fitted(data: list[np.ndarray], truth: np.ndarray, ratios: np.ndarray) -> Model | None:
    """Dual coordinate descent on most of the rows, probabilities from the rest."""
    chance = np.random.default_rng(11)
    order = chance.permutation(len(data))
    held = max(1, int(len(data) * CALIBRATION_SHARE))
    check, train = order[:held], order[held:]
    if not (truth[train] == 1).any() or not (truth[train] == -1).any():
        return None
    weights, bias = descend(data, truth, ratios, train, chance)
    model = Model(weights * ratios, bias, 1.0, 0.0)
    margins = np.array([model.margin(data[i]) for i in check])
    model.slope, model.shift = probabilities(margins, truth[check] > 0)
    return model


def descend(
    data: list[np.ndarray], truth: np.ndarray, ratios: np.ndarray, train: np.ndarray, chance: np.random.Generator
) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss; each step solves for one row's dual variable.

    Rows are divided by ``size``; both classes weigh the same.
    """
    weights, bias = np.zeros(SLOTS), 0.0
    dual = np.zeros(len(data))

    def scaled(slots: np.ndarray) -> np.ndarray:
        """A row's values, worked out anew each time: all of them would take twice the room of the slots."""
        return ratios[slots] / size(slots)

    sizes = [float(v @ v) + 1.0 for v in map(scaled, data)]
    positive = max(1, int((truth[train] > 0).sum()))
    limit = {1: PENALTY * len(train) / (2 * positive), -1: PENALTY * len(train) / (2 * max(1, len(train) - positive))}
    for _ in range(PASSES):
        moved = 0.0
        for i in chance.permutation(train):
            y = int(truth[i])
            values = scaled(data[i])
            slope = y * (float(weights[data[i]] @ values) + bias) - 1
            fresh = min(max(dual[i] - slope / sizes[i], 0.0), limit[y])
            change = fresh - dual[i]
            if change:
                dual[i] = fresh
                weights[data[i]] += change * y * values
                bias += change * y
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return weights, bias


def probabilities(margins: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, with smoothed targets."""
    ones = int(truth.sum())
    zeros = len(truth) - ones
    target = np.where(truth, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        error, spread = chance - target, np.maximum(chance * (1 - chance), 1e-9)
        gradient = np.array([(error * margins).sum() + 1e-3 * (slope - 1), error.sum()])
        curve = np.array(
            [[(spread * margins**2).sum() + 1e-3, (spread * margins).sum()], [(spread * margins).sum(), spread.sum() + 1e-6]]
        )
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)
