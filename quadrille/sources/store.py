"""Quads kept on disk: snapshots of parquet files in three orders, and the changes since.

A snapshot is written by predicate, and again by object and by subject. Files are partitioned by a hash of
the term that leads the order and sorted by it and the next two (``ORDERS``), so
a pattern reads one partition of the order whose leading term it gives, and in it the row groups that can
hold it; a frequent term is spread over several files by ranges of the next two. A pattern with a subject reads
by subject, else one with an object by object, else one with a predicate by predicate. A snapshot is
complete or not there at all, so readers keep theirs while a new one is written, and an older one can be
opened again. Changes are small files of their own until they have grown (see ``State``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.changes import QUAD, State, latest, merged
from ..terms import Term
from .quads import QuadFrame

PARTS = 64
#: The term that leads each order, and those that follow it; all three, so that no pair of frequent terms is in one task.
ORDERS = {"p": "pso", "o": "ops", "s": "spo"}


def part_of(text) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(PARTS)).cast("int")


class StoredQuads(QuadFrame):
    """Quads in one or more orders, each with the column ``part`` of its layout, and changes to them."""

    def __init__(self, orders: dict[str, DataFrame], changes: DataFrame | None = None, union: bool = True):
        self.orders, self.changes = orders, changes
        super().__init__(self._merged(orders["p"], changes), union)

    @staticmethod
    def _merged(rows: DataFrame, changes: DataFrame | None) -> DataFrame:
        rows = rows.select(*QUAD)
        return rows if changes is None else merged(rows, changes)

    def narrowed(self, pattern) -> QuadFrame:
        given = [order for order, t in (("s", pattern[0]), ("o", pattern[2]), ("p", pattern[1])) if isinstance(t, Term) and order in self.orders]
        if not given:
            return self
        term = dict(zip("spo", pattern))[given[0]]
        rows = self.orders[given[0]].where(F.col("part") == part_of(F.lit(term.lex)))
        changes = self.changes if self.changes is None else self.changes.where(F.col(given[0])["lex"] == term.lex)
        return QuadFrame(self._merged(rows, changes), self.union, self.single, self.known)


class QuadStore(State):
    """Snapshots of a dataset under a path, and changes to it."""

    def _order(self, n: int, order: str) -> str:
        return self._snapshot(n) if order == "p" else f"{self.path}/{order}-{n}"

    def write(self, batch: int, quads: DataFrame, repeats: bool = False) -> None:
        """A full snapshot; ``repeats`` says that a quad may come more than once."""
        for order, terms in ORDERS.items():
            rows = quads.select(*QUAD, part_of(F.col(terms[0])["lex"]).alias("part"))
            rows = rows.repartitionByRange("part", *terms)
            if repeats and order == "p":  # equal quads are in one range, so dropping repeats needs no shuffle of its own
                rows = rows.distinct()
            rows = rows.sortWithinPartitions("part", *terms)
            rows.write.mode("overwrite").partitionBy("part").parquet(self._order(batch, order))
            quads = self.spark.read.parquet(self._snapshot(batch))  # the other orders are made from the first

    def commit(self, quads: DataFrame) -> int:
        """Write the next snapshot; its number."""
        n = self.last() + 1
        self.write(n, quads, repeats=True)
        return n

    def commit_changes(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Write the next batch: quads removed, then quads added; only these are written."""
        n, parts = self.last() + 1, []
        for at, (quads, op) in enumerate(((removed, "D"), (added, "A"))):
            if quads is not None:
                parts.append(quads.select(*QUAD, F.lit(op).alias("op"), F.lit(at).alias("at")))
        self.change(n, latest(parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1]), "at"))
        return n

    def open(self, snapshot: int | None = None, union: bool = True) -> QuadFrame:
        """The last snapshot or batch, or an earlier one, as a source of queries."""
        base, batches = self._since(self.last() if snapshot is None else snapshot)
        if base < 0:
            return QuadFrame(self.read(snapshot), union)
        orders = {order: self.spark.read.parquet(self._order(base, order)) for order in ORDERS if self._exists(self._order(base, order))}
        return StoredQuads(orders, self.changes(batches), union)

    def vacuum(self) -> None:
        base, _ = self._since(self.last())
        super().vacuum()
        for order in ORDERS:
            for n in self._numbers(order):
                if n < base:
                    fs, at = self._hadoop(self._order(n, order))
                    fs.delete(at, True)

    def destroy(self) -> None:
        fs, path = self._hadoop(self.path)
        fs.delete(path, True)


def open_store(spark: SparkSession, path: str) -> QuadStore:
    return QuadStore(spark, path)
