"""Virtual graphs in which several tables describe one subject."""

import random
from collections import Counter

import pytest

from quadrille.graph import Dataset
from quadrille.sources.quads import MappedTables, QuadFrame, map_table

PREFIXES = {"v": "http://ex/v#", "c": "http://ex/c#", "g": "http://ex/g/"}


@pytest.fixture(scope="module")
def sources(spark):
    """People in three tables of one prefix, one of which repeats a column; towns; and people's keys as strings."""
    rng = random.Random(4)
    people = spark.createDataFrame([(i, f"n{i}", rng.randint(1, 4)) for i in range(1, 13)], "id long, name string, town int")
    pay = spark.createDataFrame([(i, float(i * 10), f"n{i}") for i in range(4, 16)], "id long, pay double, name string")
    notes = spark.createDataFrame([(str(i), f"note {i % 3}") for i in range(2, 20, 3)] + [("x", "odd")], "id string, note string")
    towns = spark.createDataFrame([(i, f"T{i}", f"note {i}") for i in range(1, 5)], "id long, label string, note string")
    tables = [map_table("person", people, "id", {"town": "town"}), map_table("pay", pay, "id", about="person"), map_table("note", notes, "id", about="person"), map_table("town", towns, "id")]
    mapped = MappedTables(spark, tables)
    explicit = QuadFrame(mapped.quads().cache(), union=True)
    return Dataset(spark, mapped, PREFIXES), Dataset(spark, explicit, PREFIXES)


QUERIES = [
    "SELECT ?s ?n ?p { ?s v:town ?t ; v:pay ?p ; v:name ?n }",
    "SELECT ?s ?n ?x { ?s v:name ?n ; v:note ?x }",
    "SELECT ?s ?p ?x { ?s v:pay ?p ; v:note ?x FILTER(?p > 60) }",
    "SELECT ?s ?c { ?s v:note ?x ; a ?c }",
    "SELECT ?s { ?s a c:Pay ; v:town ?t ; v:note 'note 2' }",
    "SELECT ?s ?c ?d { ?s a ?c , ?d ; v:pay '80.0'^^<http://www.w3.org/2001/XMLSchema#double> }",
    "SELECT ?p ?o { <http://ex/person/5> ?p ?o }",
    "SELECT ?n ?x { <http://ex/person/5> v:name ?n ; v:note ?x ; v:pay ?any }",
    "SELECT ?s ?p ?o { ?s v:note 'note 2' ; ?p ?o }",
    "SELECT ?s ?p { ?s ?p 'note 2' }",
    "SELECT ?s ?p ?l { ?s v:town_ref ?t . ?t ?p ?l }",
    "SELECT ?s ?p { ?s ?p <http://ex/town/2> }",
    "SELECT ?g ?s ?n ?x { GRAPH ?g { ?s v:name ?n ; v:id ?x } }",
    "SELECT ?s ?n ?p { GRAPH g:pay { ?s v:name ?n ; v:pay ?p } }",
    "SELECT ?s ?n { GRAPH g:pay { ?s v:name ?n ; v:town ?p } }",
    "SELECT ?g ?p ?o { GRAPH ?g { <http://ex/person/8> ?p ?o } }",
    "SELECT ?s ?o { ?s v:name ?o . ?t v:label ?l . ?s v:town_ref ?t ; v:pay ?p }",
    "SELECT ?s ?q ?o { ?s v:pay ?p OPTIONAL { ?s v:town ?t ; v:note ?q ; v:name ?o } }",
    "SELECT (COUNT(*) AS ?n) { ?s ?p ?o }",
    "SELECT ?s { ?s v:label ?l ; v:pay ?p }",
    "SELECT ?x { ?s v:name ?n . ?n ?p ?x }",
]


@pytest.mark.parametrize("text", QUERIES)
def test_same_answers_as_the_explicit_quads(sources, text):
    mapped, explicit = (Counter(frozenset((k, t.n3()) for k, t in r.items()) for r in ds.query(text).rows()) for ds in sources)
    assert mapped == explicit
    assert mapped or text in QUERIES[-7:]


def test_only_the_tables_needed_are_read(spark, tmp_path):
    for name, columns in (("person", ["'n' || id AS name", "id % 4 AS town"]), ("pay", ["id * 1.5D AS pay"]), ("town", ["'T' || id AS label"])):
        spark.range(40).selectExpr("id", *columns).write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    ds = Dataset(spark, MappedTables(spark, [map_table("person", read("person"), "id", {"town": "town"}), map_table("pay", read("pay"), "id", about="person"), map_table("town", read("town"), "id")]), PREFIXES)

    def files(text):
        df = ds.query(text).native()
        return {f.split("/")[-2] for f in df.inputFiles()}, df._jdf.queryExecution().executedPlan().toString(), df.count()

    assert files("SELECT ?s ?n ?p { ?s v:name ?n ; v:pay ?p }")[0] == {"person", "pay"}
    assert files("SELECT ?p ?o { <http://ex/town/3> ?p ?o }")[0] == {"town"}
    assert files("SELECT ?s ?p ?o { ?s v:town_ref ?t . ?t ?p ?o }")[0] == {"person", "town"}
    assert files("SELECT ?s ?p ?o { ?s v:pay 3e0 ; ?p ?o }")[0] == {"person", "pay"}
    assert files("SELECT ?s ?p { ?s ?p <http://ex/town/2> }")[0] == {"person"}
    read_, plan, n = files("SELECT ?n ?p { <http://ex/person/7> v:name ?n ; v:pay ?p }")
    assert read_ == {"person", "pay"} and n == 1 and "NestedLoop" not in plan
    assert files("SELECT ?s ?p ?t { ?s v:pay ?p ; v:town ?t }")[1].count("Scan parquet") == 2


def test_prefixes_that_go_on_from_one_another(spark):
    a = spark.createDataFrame([("1", "one"), ("b/2", "two")], "id string, x string")
    b = spark.createDataFrame([(2, "zwei"), (3, "drei")], "id long, y string")
    tables = [map_table("a", a, "id"), map_table("b", b, "id", about="a/b")]
    ds = Dataset(spark, MappedTables(spark, tables), PREFIXES)
    assert [(r["s"].lex, r["x"].lex, r["y"].lex) for r in ds.query("SELECT ?s ?x ?y { ?s v:x ?x ; v:y ?y }").rows()] == [("http://ex/a/b/2", "two", "zwei")]
    found = Counter(r["p"].lex.rsplit("#")[-1] for r in ds.query("SELECT ?p { <http://ex/a/b/2> ?p ?o }").rows())
    assert found == Counter(["id", "id", "x", "y", "type", "type"])
