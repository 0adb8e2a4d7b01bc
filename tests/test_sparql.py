"""Queries and updates on small graphs."""

import pytest

from quadrille.functions.registry import register, register_python, unregister
from quadrille.graph import Dataset, Graph, Literal
from quadrille.plans.syntax import SparqlSyntaxError, parse_query, parse_update
from quadrille.sources.turtle import TurtleParser
from quadrille.terms import IRI, XSD, Term, make

DATA = """@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p 1, 2 ; :q :b ; :name "Anna"@en, "Anne" . :b :p 3.5 ; :q :c ; :name "Bob" . :c :p "4"^^xsd:int, 1e0 ; :q :a .
:d :p "x" ; :when "2011-01-10T14:45:13.815-05:00"^^xsd:dateTime . [ :q :d ; :list (1 :a "z") ] ."""
E = "http://e/"


@pytest.fixture(scope="module")
def ds(spark):
    quads = [*TurtleParser(DATA, "http://b/").parse(), (IRI(E + "g"), IRI(E + "in"), Literal(1), IRI(E + "g1")), (IRI(E + "h"), IRI(E + "in"), Literal(2), IRI(E + "g2"))]
    return Dataset.of(spark, quads, prefixes={"": E}, union=False)


def rows(ds, text, **options):
    def short(t):
        return t.lex.removeprefix(E) if t.k == 2 else "_:" if t.k == 1 else t.n3({"xsd": XSD}).replace('"', "")

    return sorted(tuple(sorted((n, short(t)) for n, t in r.items())) for r in ds.query(text, **options).rows())


INT = "^^xsd:integer"
CASES = {
    "SELECT ?s { ?s :p ?o FILTER(?o > 2) }": ["s=b", "s=c"],
    "SELECT ?s { ?s :p ?o FILTER(?o = 1) }": ["s=a", "s=c"],
    "SELECT ?s { ?s :p 1 }": ["s=a"],
    "SELECT ?s { ?s :p ?o FILTER(!(?o > 0)) }": [],
    "SELECT ?s { ?s :p ?o FILTER(?o > 0 || true) }": ["s=a", "s=a", "s=b", "s=c", "s=c", "s=d"],
    "SELECT ?s ?n { ?s :q ?o OPTIONAL { ?s :p ?n FILTER(?n < 2) } FILTER(isIRI(?s)) }": [f"n=1{INT} s=a", "n=1e0^^xsd:double s=c", "s=b"],
    "SELECT ?s { ?s :p ?o MINUS { ?s :q ?x } }": ["s=d"],
    "SELECT ?s { ?s :q ?o FILTER NOT EXISTS { ?o :q :c } FILTER(isIRI(?s)) }": ["s=b", "s=c"],
    "SELECT ?s { ?s :q ?o FILTER(EXISTS { ?o :q :c } || ?o = :a) }": ["s=a", "s=c"],
    "SELECT ?x { :a :q+ ?x }": ["x=a", "x=b", "x=c"],
    "SELECT ?x { ?x :q* :d FILTER(isIRI(?x)) }": ["x=d"],
    "SELECT ?x { :a :q? ?x }": ["x=a", "x=b"],
    "SELECT ?x { :a :q/:q ?x }": ["x=c"],
    "SELECT ?x { :a ^:q ?x }": ["x=c"],
    "SELECT ?x { :a (:q|^:q) ?x }": ["x=b", "x=c"],
    "SELECT ?x { :d !(:p|^:q) ?x }": ["x=2011-01-10T14:45:13.815-05:00^^xsd:dateTime"],
    "SELECT ?i { ?l :list/rdf:rest*/rdf:first ?i }": [f"i=1{INT}", "i=a", "i=z"],
    "SELECT (SUM(?o) AS ?t) { :a :p ?o }": [f"t=3{INT}"],
    "SELECT (AVG(?o) AS ?t) (COUNT(DISTINCT ?o) AS ?n) { :a :p ?o }": [f"n=2{INT} t=1.5^^xsd:decimal"],
    "SELECT (SUM(?o) AS ?t) { ?s :p ?o }": [""],
    "SELECT ?s (MAX(?o) AS ?m) { ?s :p ?o } GROUP BY ?s HAVING(COUNT(?o) = 2)": [f"m=2{INT} s=a", "m=4^^xsd:int s=c"],
    'SELECT (GROUP_CONCAT(?n; SEPARATOR=", ") AS ?all) { ?s :name ?n }': ["all=Anna, Anne, Bob"],
    "SELECT (COUNT(*) AS ?n) { ?s :none ?o }": [f"n=0{INT}"],
    "SELECT ?s { ?s :p ?o } ORDER BY DESC(?o) LIMIT 1": ["s=d"],
    "SELECT DISTINCT ?s { ?s :p ?o } ORDER BY ?s OFFSET 1 LIMIT 2": ["s=b", "s=c"],
    "SELECT ?s ?z { VALUES (?s ?y) { (:a 1) (:b UNDEF) } ?s :p ?y BIND(?y * 2 AS ?z) }": [f"s=a z=2{INT}", "s=b z=7^^xsd:decimal"],
    "SELECT ?x { BIND(1/0 AS ?x) }": [""],
    "SELECT ?l { :a :name ?n BIND(LANG(?n) AS ?l) }": ["l=", "l=en"],
    'SELECT ?r { BIND(REPLACE("abcab", "(a)b", "$1-") AS ?r) }': ["r=a-ca-"],
    'SELECT ?r { BIND(REPLACE("a.b[a.b", "a.b[", "$1\\\\", "q") AS ?r) }': ["r=$1\\\\a.b"],
    'SELECT ?r { BIND(REGEX("hello world", "hello[ ]w  o r\\n l D$", "xi") AS ?r) }': ["r=true^^xsd:boolean"],
    'SELECT ?r { BIND(REGEX("axb", "a.b", "q") AS ?r) }': ["r=false^^xsd:boolean"],
    'SELECT ?r { BIND(REGEX("A.B", "a.b", "qi") AS ?r) }': ["r=true^^xsd:boolean"],
    'SELECT ?r { BIND(REGEX("ab", "ab", "z") AS ?r) }': [""],
    'SELECT ?r { VALUES ?f { "x" "q" "" "z" } BIND(REGEX("a b", "a b", ?f) AS ?r) }': ["", "r=false^^xsd:boolean", "r=true^^xsd:boolean", "r=true^^xsd:boolean"],
    'SELECT ?r { BIND(STRLANG(SUBSTR("hello", 2, 3), "EN") AS ?r) }': ["r=ell@en"],
    'SELECT ?r { BIND(CONCAT("a"@en, "b"@en) AS ?r) }': ["r=ab@en"],
    "SELECT ?h ?m ?s ?z { :d :when ?w BIND(HOURS(?w) AS ?h) BIND(MINUTES(?w) AS ?m) BIND(SECONDS(?w) AS ?s) BIND(TIMEZONE(?w) AS ?z) }": [f"h=14{INT} m=45{INT} s=13.815^^xsd:decimal z=-PT5H^^xsd:dayTimeDuration"],
    'SELECT ?d { BIND("2011-01-31T00:00:00Z"^^xsd:dateTime + "P1MT1H"^^xsd:duration AS ?d) }': ["d=2011-02-28T01:00:00Z^^xsd:dateTime"],
    'SELECT ?d { BIND("2011-01-10T00:00:00Z"^^xsd:dateTime - "2011-01-08T12:00:00Z"^^xsd:dateTime AS ?d) }': ["d=P1DT12H^^xsd:dayTimeDuration"],
    'SELECT ?x { BIND(xsd:integer("12") + xsd:decimal("0.5") AS ?x) }': ["x=12.5^^xsd:decimal"],
    "SELECT ?x { BIND(IF(?none, 1, 2) AS ?x) }": [""],
    "SELECT ?x { BIND(COALESCE(?none, 1/0, 3) AS ?x) }": [f"x=3{INT}"],
    "SELECT ?x { BIND(ROUND(-2.5) AS ?x) }": ["x=-2^^xsd:decimal"],
    "SELECT ?g ?s { GRAPH ?g { ?s :in ?o } }": ["g=g1 s=g", "g=g2 s=h"],
    "SELECT ?s { GRAPH :g2 { ?s :in ?o } }": ["s=h"],
    "SELECT ?s FROM :g1 { ?s :in ?o }": ["s=g"],
    "SELECT ?s FROM NAMED :g1 { GRAPH ?g { ?s :in ?o } }": ["s=g"],
    "SELECT ?x { { SELECT (MAX(?o) AS ?x) { :a :p ?o } } }": [f"x=2{INT}"],
    "SELECT ?b { BIND(isBlank(BNODE()) AS ?b) }": ["b=true^^xsd:boolean"],
}


@pytest.mark.parametrize("text", CASES)
def test_select(ds, text):
    got = [" ".join(f"{n}={v}" for n, v in r) for r in rows(ds, text)]
    assert got == sorted(CASES[text])


def test_forms(ds):
    assert ds.query("ASK { :a :q :b }").ask and not ds.query("ASK { :b :q :a }").ask
    made = ds.query("CONSTRUCT { ?s :r _:x . _:x :v ?o } WHERE { ?s :p ?o FILTER(?s = :a) }").graph.collect()
    assert len(made) == 4 and len({o for _, p, o in made if p.lex == E + "r"}) == 2
    described = ds.query("DESCRIBE ?l { ?l :list ?x }").graph.collect()
    assert len(described) == 8  # the node and the list that hangs on it
    assert rows(ds, "SELECT ?o { ?s :p ?o }", bindings={"s": IRI(E + "b")}) == [(("o", "3.5^^xsd:decimal"),)]


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x }", "SELECT (COUNT(?a) AS ?b) ?c { ?a ?b ?c }", "SELECT ?x { { _:b ?p ?o } { _:b ?q ?r } }", "SELECT (1 AS ?x) { ?x ?p ?o }", "ASK { ?x u:p ?o }", "SELECT (SUM(COUNT(?x)) AS ?y) { ?x ?p ?o }"])
def test_rejected(text):
    with pytest.raises(SparqlSyntaxError):
        parse_query(text)


@pytest.mark.parametrize("text", ["INSERT DATA { ?x <p:> 1 }", "DELETE DATA { _:a <p:> 1 }", "DELETE { _:a <p:> 1 } WHERE {}", "FOO"])
def test_rejected_updates(text):
    with pytest.raises(SparqlSyntaxError):
        parse_update(text)


def test_updates(spark):
    ds = Dataset.of(spark, TurtleParser(DATA, "http://b/").parse(), prefixes={"": E}, union=False)
    first, seen = ds.source, []
    ds.subscribe("changed", lambda old, new: seen.append((old, new)))
    ds.update("DELETE { ?s :q ?o } INSERT { ?o :q ?s } WHERE { ?s :q ?o FILTER(isIRI(?s)) }")
    assert rows(ds, "SELECT ?s ?o { ?s :q ?o FILTER(isIRI(?s)) }") == [(("o", "a"), ("s", "b")), (("o", "b"), ("s", "c")), (("o", "c"), ("s", "a"))]
    added, removed = ds.changes(first)
    assert (added.count(), removed.count()) == (3, 3) and len(seen) == 1
    ds.update("COPY DEFAULT TO :g ; DROP DEFAULT ; INSERT DATA { GRAPH :h { :x :y 1 } }")
    assert {t and t.lex for t in ds.graphs()} == {None, E + "g", E + "h"}
    ds.update("CREATE GRAPH :empty ; CLEAR GRAPH :g ; DELETE WHERE { GRAPH :h { ?s ?p ?o } }")
    assert len(ds) == 0 and E + "empty" in {t and t.lex for t in ds.graphs()}
    with pytest.raises(ValueError):
        ds.update("CREATE GRAPH :empty")
    ds.update("CREATE SILENT GRAPH :empty ; LOAD SILENT <file:///nowhere.ttl>")
    ds._replace(first)  # a snapshot is enough to roll back
    assert rows(ds, "SELECT ?o { :a :q ?o }") == [(("o", "b"),)]


def test_functions_by_iri(ds):
    register(E + "twice", lambda t: make(3, t["lex"]))
    register_python(E + "upper", lambda t: Literal(t.lex.upper()) if t else None)
    with pytest.raises(ValueError):
        register(E + "twice", lambda t: t)
    assert rows(ds, "SELECT (:twice(?n) AS ?x) (:upper(?n) AS ?y) { :b :name ?n }") == [(("x", "Bob"), ("y", "BOB"))]
    unregister(E + "twice"), unregister(E + "upper")


def test_results_round_trip(ds):
    from quadrille.sources.results import parse_result

    result = ds.query("SELECT ?s ?o { ?s :p ?o }")
    want = sorted(map(repr, ({n: t for n, t in sorted(r.items())} for r in result.rows())))
    for form in ("json", "xml", "tsv"):
        names, got = parse_result(result.serialize(form), form)
        assert names == ["s", "o"] and sorted(map(repr, ({n: t for n, t in sorted(r.items())} for r in got))) == want
    assert parse_result(result.serialize("csv"), "csv")[0] == ["s", "o"]
    assert "?s" not in result.serialize("txt") and parse_result(ds.query("ASK {}").serialize("xml"), "xml") is True


def test_term_values():
    assert Literal(1.5) == Term(3, "1.5", XSD + "double") and Literal("a", datatype=XSD + "string") == Literal("a")
    assert not Term(3, "300", XSD + "byte").is_well_typed() and Literal("x", "EN").lang == "en"


def test_graph_query(spark):
    g = Graph.parse(spark, data="@prefix : <http://e/> . :a :b :c .")
    assert g.query("SELECT ?x { ?x ?p ?o }").rows() == [{"x": IRI(E + "a")}]
