"""Quality rules: fixed limits, then an isolation forest over the rule statistics.

The statistics are the shares of ``stats.SHARES`` as they are, on a square-root scale that keeps small
ones apart; none is cut at a limit. Each node of a tree splits a random statistic at a random place of the
range that is still open there, not of the points seen, so the splits are known before any text is, and
the space where no good text lies is cut off after few of them: a text that falls there, by one statistic
or by an unusual combination of ordinary ones, has a short path. All labelled good texts that pass the
limits are counted in the leaves of all trees; a path ends where, of ``SUBSAMPLE`` good texts, one or less
would be left, so the numbers of all texts stand for the usual random draws. The threshold on the forest's
score is the one that best parts labelled bad from labelled good texts, a lost good text counting ``LOSS``
times, from the numbers of both at each of ``GRID`` steps of the score. Both counts are sums over all
labelled rows, bounded by the leaves and the steps, whatever the input; words, counts and verdicts cover
all texts whole.

Defined results: a null or empty text has no words and fails the base rule; without labelled rows of
both kinds, the method keeps whatever passes the base rule; equal rows each return a row, null ids too;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .stats import BASE, SHARES, measure

TREES, SUBSAMPLE, DEPTH = 100, 512, 12
LEAVES = 1 << DEPTH
GRID = 1 << 16
LOSS = 10
SEED = 7
ROWS = 2048


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Rows of all labelled documents, with their label; the rows should be narrow, as they are joined by doc_id."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    return rows.join(known, "doc_id")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and shares of each document."""

    def run(batches):
        for b in batches:
            counts, shares = measure(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), lists(counts), lists(shares)], names=["doc_id", "counts", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, counts array<long>, shares array<double>")


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def base_failed(counts: np.ndarray) -> np.ndarray:
    words, repeats = counts[:, BASE.index("n_words")], counts[:, BASE.index("n_repeat_words")]
    return (words < 20) | (100 * repeats > 30 * words)


def _mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points; between 1 and 2 points in proportion."""
    n = np.asarray(n, np.float64)
    return np.where(n <= 2, np.clip(n - 1, 0, 1), 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1))


def points(shares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(shares, 0, 1)).astype(np.float32)


class Trees:
    """Random splits of the space of points, ``DEPTH`` levels of them in each tree: node n leads to 2n + 1 and 2n + 2."""

    def __init__(self, width: int = len(SHARES), seed: int = SEED):
        rng = np.random.default_rng(seed)
        low, high = np.zeros((TREES, 1, width), np.float32), np.ones((TREES, 1, width), np.float32)
        features, splits = [], []
        for _ in range(DEPTH):
            k = rng.integers(width, size=low.shape[:2])[..., None]
            at = rng.random(k.shape, np.float32)
            split = (1 - at) * np.take_along_axis(low, k, 2) + at * np.take_along_axis(high, k, 2)
            features.append(k[..., 0].astype(np.uint8))
            splits.append(split[..., 0])
            low, high = np.repeat(low, 2, 1), np.repeat(high, 2, 1)
            np.put_along_axis(high[:, 0::2], k, split, 2)
            np.put_along_axis(low[:, 1::2], k, split, 2)
        self.feature, self.split = np.concatenate(features, 1), np.concatenate(splits, 1)

    def count(self, rows: np.ndarray) -> np.ndarray:
        """How many of the points end in each leaf, tree after tree."""
        out, trees = np.zeros(TREES * LEAVES, np.int64), np.arange(TREES)
        for i in range(0, len(rows), ROWS):
            part = rows[i : i + ROWS]
            at, own = np.zeros((len(part), TREES), np.int64), np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (part[own, self.feature[trees, at]] > self.split[trees, at])
            out += np.bincount((at - (LEAVES - 1) + trees * LEAVES).ravel(), minlength=len(out))
        return out


class Forest:
    """Isolation forest: nodes as flat arrays; a leaf leads to itself and holds the path length at its end."""

    def __init__(self, known: np.ndarray, seed: int = SEED):
        trees = Trees(known.shape[1], seed)
        self._end(trees, trees.count(known))

    @classmethod
    def of(cls, trees: Trees, held: np.ndarray) -> Forest:
        """From what all leaves of the trees hold."""
        out = cls.__new__(cls)
        out._end(trees, held)
        return out

    def _end(self, trees: Trees, held: np.ndarray) -> None:
        """Ends the paths, and keeps the nodes that they reach."""
        levels = [held.reshape(TREES, LEAVES)]
        while levels[0].shape[1] > 1:
            levels.insert(0, levels[0].reshape(TREES, -1, 2).sum(2))
        all_ = int(levels[0][0, 0])
        size = min(SUBSAMPLE, all_)
        self.scale = max(float(_mean_depth(size)), 1e-9)
        left = np.concatenate(levels, 1) * (size / all_)  # of a subsample, in each node
        depth = np.repeat(np.arange(DEPTH + 1), 1 << np.arange(DEPTH + 1))
        goes_on = (left > 1) & (depth < DEPTH)
        kept = np.ones(left.shape, bool)
        for n in range(1, left.shape[1]):
            kept[:, n] = kept[:, (n - 1) // 2] & goes_on[:, (n - 1) // 2]
        tree, node = np.nonzero(kept)
        number = np.cumsum(kept).reshape(kept.shape) - 1
        inner, own = goes_on[kept], np.arange(len(tree))
        at = np.where(inner, node, 0)
        self.roots = number[:, 0].astype(np.int32)
        self.feature = np.where(inner, trees.feature[tree, at], 0).astype(np.int32)
        self.split = np.where(inner, trees.split[tree, at], 0).astype(np.float32)
        self.below = np.where(inner, number[tree, 2 * at + 1], own).astype(np.int32)
        self.above = np.where(inner, number[tree, 2 * at + 2], own).astype(np.int32)
        self.length = np.where(inner, 0, depth[node] + _mean_depth(left[kept])).astype(np.float32)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1: isolated early; the lower, the more good texts are alike."""
        out = np.zeros(len(rows))
        for i in range(0, len(rows), ROWS):
            part = rows[i : i + ROWS]
            at, own = np.broadcast_to(self.roots, (len(part), len(self.roots))), np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                at = np.where(part[own, self.feature[at]] <= self.split[at], self.below[at], self.above[at])
            out[i : i + ROWS] = 2.0 ** (-self.length[at].mean(1, dtype=np.float64) / self.scale)
        return out


def steps(score: np.ndarray) -> np.ndarray:
    """The step of the grid that each score is on: step n is up to n / GRID."""
    return np.ceil(score * GRID).astype(np.int64)


def threshold(step: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The best cut between scores, from the numbers of good and bad texts at the steps that hold any."""
    cuts = np.r_[(step[1:] + step[:-1]) // 2, step[-1] + 1] / GRID
    caught, lost = 1 - np.cumsum(bad) / bad.sum(), 1 - np.cumsum(good) / good.sum()
    return float(cuts[np.argmax(caught - LOSS * lost)])


class Rules:
    """Forest and threshold; fitted here on measured labelled rows, where these are given."""

    def __init__(self, counts: np.ndarray | None = None, shares: np.ndarray | None = None, label: np.ndarray | None = None):
        self.fitted = False
        if counts is not None:
            use = ~base_failed(counts)
            known, good = points(shares[use]), label[use] == 1
            if good.any() and (~good).any():
                forest = Forest(known[good])
                step, at = np.unique(steps(forest.score(known)), return_inverse=True)
                self.learn(forest, threshold(step, np.bincount(at[good], minlength=len(step)), np.bincount(at[~good], minlength=len(step))))

    def learn(self, forest: Forest, cut: float) -> Rules:
        self.forest, self.threshold, self.fitted = forest, cut, True
        return self

    def judge(self, counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the base rule fails, and the score by the forest (0 if not fitted)."""
        return base_failed(counts), self.forest.score(points(shares)) if self.fitted else np.zeros(len(counts))

    def keep(self, failed: np.ndarray, score: np.ndarray) -> np.ndarray:
        return ~failed & (score <= self.threshold) if self.fitted else ~failed


def fit(measures: DataFrame, labels: DataFrame) -> Rules:
    """Rules learnt from all labelled documents, of which the measures are given."""
    words, repeats = (F.col("counts")[BASE.index(c)] for c in ("n_words", "n_repeat_words"))
    passes = (words >= 20) & (100 * repeats <= 30 * words)  # as base_failed, without another Python step beside the measuring one
    rows = materialize(labelled(measures.where(passes).select("doc_id", "shares"), labels, "quality").select("shares", "label"))
    trees = Trees()

    def leaves(batches):
        total = np.zeros(TREES * LEAVES, np.int64)
        for b in batches:
            total += trees.count(points(matrix(b.column(0), len(SHARES))))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["leaf", "n"])

    held = np.zeros(TREES * LEAVES, np.int64)
    found = rows.where("label = 1").mapInArrow(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # a row for each leaf at most
    held[found.column("leaf").to_numpy()] = found.column("n").to_numpy()
    if not held.any():
        return Rules()
    forest = Forest.of(trees, held)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(steps(forest.score(points(matrix(b.column(0), len(SHARES)))))), b.column(1)], names=["step", "label"])

    at = rows.mapInArrow(scored, "step long, label int").groupBy("step").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("bad"))
    step, good, bad = (c.to_numpy() for c in at.orderBy("step").toArrow().columns)  # a row for each step at most
    return Rules().learn(forest, threshold(step, good, bad)) if bad.any() else Rules()


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and anomaly (the forest's score) of each document."""
    measures = materialize(measured(docs))
    rules = fit(measures, labels)

    def run(batches):
        for b in batches:
            counts = matrix(b.column(1), len(BASE))
            failed, score = rules.judge(counts, matrix(b.column(2), len(SHARES)))
            arrays = [b.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(rules.keep(failed, score)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return measures.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, anomaly double")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep; columns as they were. Texts are measured again, so that none is shuffled or kept."""
    rules, at = fit(measured(docs), labels), [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            failed, score = rules.judge(*measure(b.column(at).to_pylist()))
            yield b.filter(pa.array(rules.keep(failed, score)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
