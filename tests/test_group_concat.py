"""GROUP_CONCAT by pieces: order, repeats, groups without a value, other aggregates beside it, one large group."""

from quadrille.graph import Dataset
from quadrille.sources.quads import MappedTables, map_table
from quadrille.terms import BNode, IRI, Literal

E = "http://x/"


def test_small_groups(spark):
    data = [("a", "x"), ("a", "z"), ("a", "y"), ("b", "q"), ("c", "")]
    quads = [(IRI(E + s), IRI(E + "p"), Literal(o)) for s, o in data] + [(IRI(E + "a2"), IRI(E + "same"), IRI(E + "a")), (IRI(E + "d"), IRI(E + "p"), BNode("n"))]
    ds = Dataset.of(spark, quads, prefixes={"": E})
    ask = lambda t: sorted(tuple(r) for r in ds.query(t).native().collect())
    assert ask('SELECT ?s (GROUP_CONCAT(STR(?o); SEPARATOR="--") AS ?t) { ?s :p ?o } GROUP BY ?s') == [(E + "a", "x--y--z"), (E + "b", "q"), (E + "c", ""), (E + "d", "")]
    both = 'SELECT ?s (COUNT(?o) AS ?n) (GROUP_CONCAT(?t; SEPARATOR="") AS ?x) (GROUP_CONCAT(DISTINCT ?t; SEPARATOR="|") AS ?y) { ?s :p ?o FILTER(?s = :a || ?s = :b) VALUES ?t { "k" "k" "j" } } GROUP BY ?s'
    assert ask(both) == [(E + "a", 9, "jjjkkkkkk", "j|k"), (E + "b", 3, "jkk", "j|k")]
    assert ask("SELECT (GROUP_CONCAT(?o) AS ?t) (COUNT(*) AS ?n) { ?s :none ?o }") == [("", 0)]
    assert ask("SELECT (GROUP_CONCAT(?o) AS ?t) { ?s :none ?o }") == [("",)]


def test_unbound_keys(spark):
    quads = [(IRI(E + s), IRI(E + "p"), Literal(o)) for s, o in (("a", "x"), ("a", "z"), ("b", "q"))] + [(IRI(E + "u"), IRI(E + "same"), IRI(E + "a"))]
    found = Dataset.of(spark, quads, prefixes={"": E}).query("SELECT ?u (COUNT(*) AS ?n) (GROUP_CONCAT(?o) AS ?t) { ?s :p ?o OPTIONAL { ?u :same ?s } } GROUP BY ?u").native()
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(None, 1, "q"), (E + "u", 2, "x z")], key=repr)


def test_one_large_group(spark):
    """A group of 300,000 texts and a value repeated 200,000 times lie in several pieces."""
    rows = spark.range(500_000).selectExpr("id AS k", "IF(id < 200000, 'hot', CAST(id AS STRING)) AS t", "'one' AS g")
    ds = Dataset(spark, MappedTables(spark, [map_table("n", rows, "k", base=E)]), {"v": E + "v#"})
    found = ds.query("SELECT ?g (GROUP_CONCAT(?t) AS ?x) { ?s v:g ?g ; v:t ?t } GROUP BY ?g").native()
    [(_, text)] = found.collect()
    assert text.split(" ") == sorted(["hot"] * 200_000 + [str(i) for i in range(200_000, 500_000)])
    assert "rangepartitioning" in found._jdf.queryExecution().executedPlan().toString()
