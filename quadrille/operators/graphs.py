"""Operations on whole graphs: descriptions, components, lists, containers, profiles, skolem names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..terms import BNODE, GENID, RDF, Term, equal, lit, make
from .paths import reach


def description(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples of the nodes, of the blank nodes that they lead to, and of statements about any of these."""
    triples = quads.select("s", "p", "o").distinct()
    links = triples.where(F.col("o")["k"] == BNODE).select(F.col("s").alias("a"), F.col("o").alias("b"))
    start = nodes.select(F.col("n").alias("a")).join(links, "a").select("a", "b")
    seen = nodes.select("n").union(reach(start, links).select(F.col("b").alias("n"))).distinct()
    about = triples.where(equal(F.col("p"), Term(2, RDF + "subject"))).join(seen.withColumnRenamed("n", "o"), "o", "left_semi").select(F.col("s").alias("n"))
    every = materialize(seen.union(about).distinct())
    return triples.join(every.withColumnRenamed("n", "s"), "s", "left_semi").select("s", "p", "o", lit(None).alias("g"))


def components(quads: DataFrame) -> DataFrame:
    """(n, root) of every node, links taken both ways; hook to the least neighbour, double pointers, contract.

    The least neighbours tell all nodes, links to oneself included, and don't change with repeated links, so neither is
    made distinct before; links are turned round only for them.
    """
    left, root = materialize(quads.select(F.col("s").alias("a"), F.col("o").alias("b"))), None
    while root is None or not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")))
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = materialize(parent.join(up, "p").select("v", F.col("pp").alias("p")))
        moved = parent.select(F.col("v").alias("root"), F.col("p").alias("to"))
        root = moved.select(F.col("root").alias("v"), F.col("to").alias("root")) if root is None else materialize(root.join(moved, "root", "left").select("v", F.coalesce("to", "root").alias("root")))
        at_a, at_b = (parent.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        left = materialize(left.join(at_a, "a").join(at_b, "b").where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return root.select(F.col("v").alias("n"), "root")


def is_connected(quads: DataFrame) -> bool:
    return components(quads).select("root").distinct().limit(2).count() < 2


def roots(quads: DataFrame, p: Term) -> DataFrame:
    """Objects of a predicate that are no subjects of it."""
    links = quads.where(equal(F.col("p"), p))
    return links.select(F.col("o").alias("n")).distinct().join(links.select(F.col("s").alias("n")), "n", "left_anti")


def tree(quads: DataFrame, root: Term, p: Term, down: bool = True):
    """Nested (node, children) from a root; ``down`` goes from objects to subjects. A node is entered once."""
    links = quads.where(equal(F.col("p"), p)).select(*([F.col("o").alias("a"), F.col("s").alias("b")] if down else [F.col("s").alias("a"), F.col("o").alias("b")]))
    first = links.where(equal(F.col("a"), root))
    found = reach(first, links).select(F.col("b").alias("a")).distinct()
    below = links.join(found, "a", "left_semi").union(first).distinct()
    children: dict[Term, list[Term]] = {}
    for r in below.collect():
        children.setdefault(Term(*r[0]), []).append(Term(*r[1]))
    done: set[Term] = set()

    def build(node: Term):
        done.add(node)
        return node, [build(c) for c in sorted(children.get(node, [])) if c not in done]

    return build(root)


def list_positions(quads: DataFrame, head: Term) -> DataFrame:
    """(position, item) of an rdf:List; each round doubles the jumps and the cells that are found, so rounds are few; raises ValueError on a loop."""
    nil = equal(F.col("o"), Term(2, RDF + "nil"))
    jump = materialize(quads.where(equal(F.col("p"), Term(2, RDF + "rest")) & ~nil).select(F.col("s").alias("at"), F.col("o").alias("to")).distinct())
    first = quads.where(equal(F.col("p"), Term(2, RDF + "first"))).select(F.col("s").alias("at"), F.col("o").alias("item"))
    seen = materialize(quads.sparkSession.range(1).select(lit(head).alias("at"), F.lit(0).alias("position")))
    step = 1
    while True:
        new = materialize(seen.join(jump, "at").select(F.col("to").alias("at"), (F.col("position") + step).alias("position")).distinct())
        if new.isEmpty():
            break
        if not new.join(seen, "at", "left_semi").isEmpty():
            raise ValueError("the list has a loop")
        seen = materialize(seen.union(new))
        jump = materialize(jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("far")), "to").select("at", F.col("far").alias("to")).distinct())
        step *= 2
    return seen.join(first, "at").select("position", "item")


def list_items(quads: DataFrame, head: Term) -> list:
    return [r.item for r in list_positions(quads, head).orderBy("position").collect()]


def container_members(quads: DataFrame, container: Term) -> DataFrame:
    """(item, position) of rdf:_1, rdf:_2, ... in order."""
    number = F.regexp_extract(F.col("p")["lex"], f"^{RDF.replace('.', '[.]')}_([1-9][0-9]*)$", 1)
    rows = quads.where(equal(F.col("s"), container)).select(F.col("o").alias("item"), number.try_cast("long").alias("position"))
    return rows.where("position IS NOT NULL").orderBy("position")


def profile(quads: DataFrame) -> DataFrame:
    """A VoID profile: (scope, term, triples, subjects, objects) of the whole, of classes and of properties."""
    triples = quads.select("s", "p", "o").distinct()
    measures = [F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects")]
    types = triples.where(equal(F.col("p"), Term(2, RDF + "type"))).select("s", F.col("o").alias("class"))
    whole = triples.agg(*measures).select(F.lit("dataset").alias("scope"), F.lit(None).cast("string").alias("term"), "triples", "subjects", "objects")
    by_property = triples.groupBy("p").agg(*measures).select(F.lit("property").alias("scope"), F.col("p.lex").alias("term"), "triples", "subjects", "objects")
    by_class = triples.join(types, "s").groupBy("class").agg(*measures).select(F.lit("class").alias("scope"), F.col("class.lex").alias("term"), "triples", "subjects", "objects")
    return whole.union(by_property).union(by_class)


def skolemize(quads: DataFrame, authority: str = "http://localhost") -> DataFrame:
    named = lambda c: F.when(F.col(c)["k"] == BNODE, make(2, F.concat(F.lit(authority + GENID), F.col(c)["lex"]))).otherwise(F.col(c))
    return quads.select(*[named(c).alias(c) for c in "spog"])


def de_skolemize(quads: DataFrame) -> DataFrame:
    def plain(c: str):
        lex = F.col(c)["lex"]
        return F.when((F.col(c)["k"] == 2) & lex.contains(GENID), make(BNODE, F.substring_index(lex, GENID, -1))).otherwise(F.col(c))

    return quads.select(*[plain(c).alias(c) for c in "spog"])


