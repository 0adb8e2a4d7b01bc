"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the number of pieces of each length matters to a packing, and there are at most ``CAPACITY``
lengths, so the plan is made from that histogram, whatever the input: lengths from the largest down,
each placed in the sequences with the smallest gap that holds it. Pieces above one third of the
capacity meet at most twice in a sequence, so for them this is a greedy matching of each with the
largest partner that fits; the smaller ones then fill the gaps that are left, best fit first. The plan is
a list of runs: so many pieces of one length, at this offset, in consecutive sequences. A piece finds
its run by its rank among the pieces of its length: its rank within the partition that tokenized it,
plus the counts of earlier partitions.

Defined results: a null or empty text is one piece of the end id alone; a document longer than the
capacity is cut, and its first piece takes what is left over; equal rows and null ids are packed like
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import IdPacker, vocabulary

CAPACITY = 2048
END = b"\0\0\0\0"


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document's packed ids and its end id."""
    ids += END
    n = len(ids) // 4
    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; ``part`` and ``nth`` number the pieces of a length within a partition."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches):
        packer, part, seen = IdPacker(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for k, (start, length, crc) in enumerate(pieces_of(packer.ids(text), capacity)):
                    at.append(i)
                    rows.append((k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            arrays = [pa.array(cols[0], pa.int64()).cast(pa.int32()), *(pa.array(c) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], names=names)

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, nth long")


class Sequences:
    """Opened sequences by the gap that is left in them, and the runs placed so far."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.spans: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, number of sequences)
        self.gaps: list[int] = []

    def _left(self, gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in self.spans:
                insort(self.gaps, gap)
            self.spans.setdefault(gap, []).append((first, number))

    def _smallest_gap(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        first, number = self.spans[gap].pop()
        if not self.spans[gap]:
            del self.spans[gap]
            self.gaps.pop(at)
        return gap, first, number

    def place(self, length: int, pieces: int, most: int) -> None:
        """All pieces of a length, each in the smallest gap that holds it; at most ``most`` in a sequence."""
        rank = 0
        while rank < pieces:
            found = self._smallest_gap(length)
            if found is None:
                number = -(-(pieces - rank) // min(most, self.capacity // length))
                found = self.capacity, self.opened, number
                self.opened += number
            gap, first, number = found
            each = min(most, gap // length)
            full = min(number, (pieces - rank) // each)
            if full:
                self.runs.append((length, rank, first, each, self.capacity - gap))
                self._left(gap - each * length, first, full)
                rank += full * each
            if (rest := pieces - rank) and full < number:  # fewer than fill one sequence
                self.runs.append((length, rank, first + full, rest, self.capacity - gap))
                self._left(gap - rest * length, first + full, 1)
                full, rank = full + 1, pieces
            self._left(gap, first + full, number - full)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset of the first piece)."""
    lengths = sorted((n for n, c in histogram.items() if c), reverse=True)
    sequences = Sequences(capacity)
    # Matching: above a third of the capacity two meet in a sequence at most, each with the largest earlier one that leaves it room.
    for length in (n for n in lengths if 3 * n > capacity):
        sequences.place(length, histogram[length], 2)
    # Best fit: the others fill the gaps.
    for length in (n for n in lengths if 3 * n <= capacity):
        sequences.place(length, histogram[length], capacity)
    return sequences.runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    pieces = materialize(tokenize(docs, path, capacity))
    counts = pieces.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most one row for each length
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches):
        names = np.int64(1) << np.int64(40)
        keys = runs[:, 0] * names + runs[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = runs[np.searchsorted(keys, length * names + rank, "right") - 1]
            nth = rank - r[:, 1]
            columns = [*(b.column(i) for i in range(5)), pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + nth % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(counts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"))
