"""Quality scores from random-indexing word vectors and a small network.

Every unit of text (a run of letters with digits, or the marks behind it) falls in one of
``BUCKETS`` hash buckets and owns a sparse ternary index vector. A bucket's word vector is
the sum of the index vectors of its neighbours over all documents. A document is the mean
and the spread of its word vectors; a network of two layers turns that into a probability,
whose temperature is set on labelled rows that the network has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm import words as W

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 32, 4, 2
HIDDEN, ROUNDS, SEED = 32, 400, 7
TRAINING_ROWS = 20_000
"""Bound on the labelled rows the network is fitted on, those of the smallest hashes."""

THRESHOLD = 0.3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    draw = W.mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(SEED << 40)).reshape(BUCKETS, NONZERO)
    return (draw % np.uint64(DIMENSIONS)).astype(np.int64), np.where(draw >> np.uint64(63), 1.0, -1.0)


def unit_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unit, letter case kept, and the index of each text's first unit."""
    hashes, _, _, first = W.word_hashes(buf, offsets, W.PLAIN, cut_after_letters=True)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), first


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = W.text_bytes(batch.column(at))
    for lo, hi in W.row_slices(offsets):
        part = offsets[lo : hi + 1]
        yield lo, hi, *unit_buckets(buf[part[0] : part[-1]], part - part[0])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMENSIONS vectors of length one, from all texts; null texts add nothing.

    Each task sends at most one row for a bucket, so the exchange grows with the tasks.
    """
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        sums = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for _, _, unit, first in _texts(batch, 0):
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for reach in range(1, REACH + 1):
                    same = np.flatnonzero(text[reach:] == text[:-reach])
                    a, b = unit[same], unit[same + reach]
                    for i in range(NONZERO):
                        for x, y in ((a, b), (b, a)):
                            sums += np.bincount(x * DIMENSIONS + place[y, i], sign[y, i], len(sums))
        table = sums.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(used), *[pa.array(table[used, i]) for i in range(DIMENSIONS)]]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *names])

    schema = "bucket bigint, " + ", ".join(f"{n} double" for n in names)
    sums = docs.select("text").mapInArrow(count, schema).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    found = sums.toArrow()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[found.column("bucket").to_numpy()] = np.stack([found.column(n).to_numpy() for n in names], axis=1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pooled(unit: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and its length; zeros when empty."""
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIMENSIONS + 1))
    full = np.flatnonzero(n)
    if len(full):
        starts = first[:-1][full]
        x = vectors[unit[: first[-1]]]
        mean = np.add.reduceat(x, starts, axis=0) / n[full, None]
        square = np.add.reduceat(x * x, starts, axis=0) / n[full, None]
        out[full, :DIMENSIONS] = mean
        out[full, DIMENSIONS:-1] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, -1] = np.log1p(n[full]) / 8
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over standardised inputs; logits are divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on four fifths of the rows, set the temperature on the rest; all steps are fixed.

    Without rows, or with one label only, the score is the share of label 1 (one half of
    nothing) drawn in by two rows, one of each label.
    """
    width = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), (np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share)))))
    random = np.random.default_rng(SEED)
    order = random.permutation(len(x))
    held = order[: len(x) // 5]
    rest = order[len(x) // 5 :]
    centre, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    z, t = (x[rest] - centre) / scale, y[rest]
    parts = [random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, ROUNDS + 1):
        h = np.tanh(z @ parts[0] + parts[1])
        error = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -40, 40))) - t) / len(t)
        back = np.outer(error, parts[2]) * (1 - h * h)
        slopes = [z.T @ back + 1e-4 * parts[0], back.sum(axis=0), h.T @ error + 1e-4 * parts[2], np.array([error.sum()])]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            parts[i] = parts[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    network = Network(centre, scale, (parts[0], parts[1], parts[2], float(parts[3][0])))
    logits, truth = network.logits(x[held]), y[held]
    heats = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / h).mean() if len(held) else h for h in heats]
    return Network(centre, scale, network.weights, float(heats[int(np.argmin(loss))]) if len(held) else 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _pool_rows(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, unit, first in _texts(batch, 1):
                x = pooled(unit, first, vectors)
                at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                rows = pa.ListArray.from_arrays(at, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), rows], ["y", "x"])

    return docs.select(F.col("y").cast("double"), "text").mapInArrow(pool, "y double, x array<double>")


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``rows`` labelled rows.

    Labels of held-out rows, null labels and labels without a document are not used.
    """
    vectors = word_vectors(docs)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").alias("y"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    found = _pool_rows(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), vectors).toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, 2 * DIMENSIONS + 1)
    y = found.column("y").to_numpy()
    order = np.lexsort((*x.T[:4], y))  # the same rows in the same order whatever the partitions
    return Model(vectors, train(x[order], y[order]))


def score_texts(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 from the text alone; null and empty included.

    A column that ``docs`` has under the name of the score is replaced.
    """
    docs = docs.drop(column)
    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, unit, first in _texts(batch, at):
                got = model.network.score(pooled(unit, first, model.vectors))
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got)], [*names, column])

    return docs.mapInArrow(score, f"{schema}, `{column}` double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without units; repeated rows get equal
    scores; an empty table gives no rows; columns beyond doc_id and text are not read.
    """
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
