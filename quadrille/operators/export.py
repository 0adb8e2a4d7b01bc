"""Graphs as edge tables for graph libraries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import RDF, RDFS, Term, equal, n3


def edges(quads: DataFrame, name: Callable[[Column], Column] = n3) -> DataFrame:
    """(src, dst, key): an edge for each triple."""
    return quads.select(name(F.col("s")).alias("src"), name(F.col("o")).alias("dst"), name(F.col("p")).alias("key"))


def weighted(quads: DataFrame, directed: bool = True, name: Callable[[Column], Column] = n3) -> DataFrame:
    """(src, dst, weight, keys): parallel edges as one; undirected, the lesser end comes first."""
    rows = edges(quads, name)
    if not directed:
        rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "key")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.sort_array(F.collect_list("key")).alias("keys"))


def vertices(quads: DataFrame, name: Callable[[Column], Column] = n3) -> DataFrame:
    """(id, term) of every node."""
    return quads.select(F.col("s").alias("term")).union(quads.select("o")).distinct().select(name(F.col("term")).alias("id"), "term")


def schema_edges(quads: DataFrame) -> DataFrame:
    """(property, domain, range) of an RDFS schema; classes without properties have none."""
    at = lambda iri, c: quads.where(equal(F.col("p"), Term(2, RDFS + iri))).select(F.col("s").alias("property"), F.col("o").alias(c))
    return at("domain", "domain").join(at("range", "range"), "property", "full").select(*[F.col(c)["lex"].alias(c) for c in ("property", "domain", "range")])


def schema_dot(quads: DataFrame) -> str:
    """A GraphViz drawing of classes and the properties between them."""
    kinds = quads.where(equal(F.col("p"), Term(2, RDF + "type")) & F.col("o")["lex"].endswith("Class")).select(F.col("s")["lex"]).distinct()
    names = sorted(r[0] for r in kinds.collect())
    lines = [f'  "{n}";' for n in names]
    lines += [f'  "{r.domain}" -> "{r.range}" [label="{r.property}"];' for r in schema_edges(quads).dropna().orderBy("property").collect()]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"
