"""The relational tables as a virtual graph: one subject for each row, one named graph for each table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .graph import Dataset
from .sources.quads import BASE, VOCAB, MappedTables, map_table

#: Keys, and foreign keys with the table that they lead to. lineitem has no unique key.
TABLES = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": (None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {}),
}
PREFIXES = {"v": VOCAB, "c": f"{BASE}c#", "g": f"{BASE}g/", "": BASE}


def dataset(spark: SparkSession, sf_dir: str, names=None) -> Dataset:
    """The tables of a folder, or some of them, ready for SPARQL."""
    tables = [map_table(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), *TABLES[n]) for n in names or TABLES]
    return Dataset(spark, MappedTables(spark, tables), PREFIXES)
