"""Quality scores: random Fourier features, ridge from partition-summed normal equations, isotonic calibration.

A text's statistics (its shares, the logarithm of its words and their mean length) are standardised and
mapped to ``FEATURES`` cosines that approximate a Gaussian kernel. Each partition of the learning rows
sums its part of the normal equations; the sums, one small matrix for each of ``PARTS`` partitions, give
the ridge weights. Rows left out of that sum calibrate the raw score isotonically to a probability.

Labels are learnt from all labelled rows with crc32(doc_id as text) mod 5 not 0; of these, remainder 1
calibrates and the others fit. Labels, lang, source and doc_id are no inputs. Every whole text is scored.

Defined results: a null or empty text is scored like any other, from zero counts; without learning rows
each score is 0.5; equal rows each return a row, null ids too (not held out); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .rules import labelled, lists, matrix
from .stats import SHARES, measure

FEATURES = 160
PARTS = 16
RIDGE = 1.0
WIDTH = 2.0
SEED = 11
CUT = 0.3
INPUTS = len(SHARES) + 2


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(2))


def inputs(texts: list[str | None]) -> np.ndarray:
    """Statistics of each text, on scales that keep small shares apart."""
    counts, shares = measure(texts)
    words = counts[:, 0]
    return np.c_[np.sqrt(np.clip(shares, 0, 1)), np.log1p(words) / 4, np.minimum(counts[:, 1] / np.maximum(words, 1), 30) / 10]


class Features:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / WIDTH / np.sqrt(INPUTS / 4), (INPUTS, FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.c_[np.sqrt(2 / FEATURES) * np.cos(z), np.ones(len(x))]


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) that rise."""
    blocks: list[list[float]] = []  # weight, weighted label, weighted score
    for i in np.argsort(score, kind="stable"):
        blocks.append([weight[i], label[i], weight[i] * score[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    w, y, s = np.array(blocks).T
    return s / w, y / w


class Model:
    def __init__(self, features: Features, weights: np.ndarray):
        self.features, self.weights, self.knots = features, weights, None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, *self.knots) if self.knots else raw, 0, 1)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of each document."""

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), lists(inputs(b.column(1).to_pylist()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(measures: DataFrame, labels: DataFrame) -> Model | None:
    learn = labels.where(fold(F.col("doc_id")) != 0)
    rows = labelled(measures, learn, "quality").select("x", "label", fold(F.col("doc_id")).cast("int").alias("part"))
    return _fit(materialize(rows))


def _fit(rows: DataFrame) -> Model | None:
    x = lambda b: matrix(b.column(0), INPUTS)

    def summed(f, width: int) -> np.ndarray:
        """The sum over all partitions of a vector made of each batch's rows."""

        def run(batches):
            total = np.zeros(width)
            for b in batches:
                total += f(b)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = rows.coalesce(PARTS).mapInArrow(run, "v array<double>").collect()  # PARTS rows at most
        return np.sum([r[0] for r in parts], axis=0) if parts else np.zeros(width)

    moments = summed(lambda b: np.r_[b.num_rows, x(b).sum(0), (x(b) ** 2).sum(0)], 1 + 2 * INPUTS)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : 1 + INPUTS] / n
    scale = np.sqrt(np.maximum(moments[1 + INPUTS :] / n - mean**2, 1e-6))
    features, wide = Features(mean, scale), FEATURES + 1

    def equations(b) -> np.ndarray:
        use = np.array(b.column(2).to_pylist()) != 1
        z, y = features(x(b)[use]), np.array(b.column(1).to_pylist(), np.float64)[use]
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    sums = summed(equations, wide * wide + wide)
    gram = sums[: wide * wide].reshape(wide, wide) + RIDGE * np.eye(wide)
    model = Model(features, np.linalg.solve(gram, sums[wide * wide :]))

    def raw(batches):
        for b in batches:
            use = np.array(b.column(2).to_pylist(), np.int64) == 1
            bins = (model.raw(x(b)[use]) * 1000).round().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(bins, -2000, 3000)), pa.array(np.array(b.column(1).to_pylist(), np.int64)[use])], names=["bin", "label"])

    bins = rows.mapInArrow(raw, "bin long, label long").groupBy("bin").agg(F.count("*"), F.sum("label")).collect()  # 5,001 rows at most
    if bins:
        b = np.array(bins, np.float64)
        model.knots = isotonic(b[:, 0] / 1000, b[:, 2], b[:, 1])
    return model


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    measures = materialize(measured(docs))
    model = fit(measures, labels)

    def run(batches):
        for b in batches:
            s = model.score(matrix(b.column(1), INPUTS)) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = measures.select("doc_id", "x", (fold(F.col("doc_id")) == 0).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
