"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes ratios.

The features of a text are the hashed n-grams it has: byte n-grams, and n-grams over the marks "same word as
before" and "another word". An indicator's value is the log of how much more of the good than of the bad training
texts have it, over the square root of the number of the text's indicators. The weights solve the
L2-regularised hinge-loss problem, found by dual coordinate descent, and a logistic curve fitted to the
training margins turns a margin into a score between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorkeep.llm.common import md5_bits, sliced

BUCKETS_LOG2 = 18
# The last buckets stand for the runs of marks and for the constant term.
RUNS = 8
SIZE = (1 << BUCKETS_LOG2) + RUNS + 1
# Labelled rows that the model is fitted on, at most: those first by a hash of their id.
TRAINING_ROWS = 12_000
COST = 1.0
SWEEPS = 200
# The fit ends when the primal value is within this share of the dual one, looked at after so many sweeps.
GAP = 1e-3
LOOK = 5
CUT = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose label must not be seen."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Features:
    """The places of a text's indicators; keeps one array for marking what has been seen."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BUCKETS_LOG2, dtype=np.int64)

    def places(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        n = len(data) - 3
        found = [np.array([SIZE - 1])]
        if n > 0:
            grams = data[:n] | data[1 : n + 1] << 8 | data[2 : n + 2] << 16 | data[3:] << 24
            buckets = (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)
            numbers = np.arange(n)
            self.last[buckets] = numbers
            found.append(buckets[self.last[buckets] == numbers].astype(np.int64))
        words = text.split()
        same = np.fromiter(map(eq, words[1:], words), dtype=np.int64, count=max(len(words) - 1, 0))
        if len(same) > 2:
            runs = np.unique(same[:-2] + 2 * same[1:-1] + 4 * same[2:])
            found.append((1 << BUCKETS_LOG2) + runs)
        return np.concatenate(found)


def fit(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights (ratios included), and slope and offset of the logistic curve. One class alone gives a constant score."""
    y = np.where(good, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return np.zeros(SIZE), 0.0, 0.0 if not len(y) else float(5 * y[0])
    counts = [np.ones(SIZE), np.ones(SIZE)]
    for places, g in zip(rows, good, strict=True):
        counts[int(g)][places] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[SIZE - 1] = 1.0
    scale = np.array([1 / np.sqrt(len(p)) for p in rows])
    norm = np.array([max(float(ratio[p] @ ratio[p]) * s * s, 1e-12) for p, s in zip(rows, scale, strict=True)])
    # Both classes weigh the same in all.
    cost = COST * len(y) / 2 / np.where(good, good.sum(), (~good).sum())
    w, alpha, dice = np.zeros(SIZE), np.zeros(len(y)), np.random.RandomState(7)
    for sweep in range(1, SWEEPS + 1):
        for i in dice.permutation(len(y)).tolist():
            p = rows[i]
            gradient = y[i] * scale[i] * float(w[p] @ ratio[p]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[p] += (new - alpha[i]) * y[i] * scale[i] * ratio[p]
                alpha[i] = new
        if sweep % LOOK == 0:
            slack = np.array([1 - t * s * float(w[p] @ ratio[p]) for p, s, t in zip(rows, scale, y, strict=True)])
            primal, dual = w @ w / 2 + cost @ np.maximum(slack, 0), alpha.sum() - w @ w / 2
            if primal - dual <= GAP * primal:
                break
    weights = w * ratio
    margin = np.array([s * float(weights[p].sum()) for p, s in zip(rows, scale, strict=True)])
    return weights, *curve(margin, good)


def curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, towards slightly softened targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - target) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, quality, text of at most ``rows`` labelled rows that are not held out; rows without a label or id are not used.

    Rows that share id, text and label are one. Of an id with very many texts or labels no more than ``rows`` are taken either.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = md5_bits(F.col("doc_id").cast("string"), 60)
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(order, "doc_id", "quality").limit(rows)
    # Both lists are bounded by the number of rows.
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    keys = texts.select("doc_id", "mark").join(F.broadcast(chosen), "doc_id").distinct().orderBy(order, "doc_id", "quality", "mark").limit(rows)
    sample = texts.join(F.broadcast(keys), ["doc_id", "mark"]).groupBy("doc_id", "mark", "quality").agg(F.first("text").alias("text"))
    return sample.select("doc_id", "quality", "text")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, float, float]:
    """The model, from ``training_rows``.

    Features are taken where the texts are; one task gets at most ``rows`` lists of places and fits.
    """
    sample = training_rows(docs, labels, rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for start, texts in sliced(batch.column(2)):
                places = pa.array([features.places(t) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(texts)) for c in (0, 1)), places], ["doc_id", "quality", "places"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, good = [], []
        for batch in batches:
            places += [np.asarray(x.values, dtype=np.int32) for x in batch.column(2)]
            good += batch.column(1).to_pylist()
        weights, slope, offset = fit(places, np.array(good, dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()]), pa.array([slope]), pa.array([offset])], ["weights", "slope", "offset"])

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, places array<long>"
    extracted = sample.mapInArrow(extract, fields)
    ordered = extracted.repartition(1).sortWithinPartitions("doc_id", "quality", F.hash("places"))
    model = ordered.mapInArrow(solve, "weights binary, slope double, offset double").first()
    if model is None:
        return fit([], np.empty(0, dtype=bool))
    return np.frombuffer(model.weights, dtype="<f8"), model.slope, model.offset


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, in one scan; a null text scores as an empty one.

    Repeated rows give equal rows, a null doc_id stays null, and further columns are not read.
    """
    weights, slope, offset = model
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for start, texts in sliced(batch.column(1)):
                margins = np.array([float(weights[p].sum()) / np.sqrt(len(p)) for p in map(features.places, texts)])
                scores = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {doc_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Train on the labels that may be seen and score every row."""
    return score(docs, train(docs, labels, rows))
