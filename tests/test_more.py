"""Endpoints, shapes, exports, namespaces, literals, the builder and the command line."""

import http.server
import json
import threading
import urllib.parse

import pytest

from quadrille import cli
from quadrille.builder import Builder
from quadrille.functions import literals as Lit
from quadrille.graph import Dataset, Graph, Literal
from quadrille.namespaces import ClosedNamespace, Namespace, Prefixes, URIPattern, defrag, fragment, split_iri
from quadrille.operators.export import edges, schema_dot, vertices, weighted
from quadrille.operators.shacl import build_path, parse_path
from quadrille.plans import compiler
from quadrille.plans import nodes as N
from quadrille.sources.remote import Endpoint, service
from quadrille.terms import IRI, RDF, RDFS, XSD, Term, parse_term

E = "http://e/"


@pytest.fixture
def endpoint():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            seen.append((self.command, self.headers.get("Content-Type"), body))
            rows = [{"x": {"type": "uri", "value": E + "a"}, "s": {"type": "uri", "value": E + "a"}}]
            text = json.dumps({"head": {"vars": ["x"]}, "results": {"bindings": rows}} if "ASK" not in body else {"boolean": True}).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/sparql-results+json")
            self.end_headers()
            self.wfile.write(text)

        def do_GET(self):  # noqa: N802
            self.answer(urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)["query"][0])

        def do_POST(self):  # noqa: N802
            self.answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", seen
    server.shutdown()


def test_endpoint(spark, endpoint):
    url, seen = endpoint
    remote = Endpoint(url, auth=("u", "p"))
    assert remote.query("SELECT ?x { ?x ?p ?o }")[1][0]["x"] == IRI(E + "a") and seen[-1][0] == "GET"
    remote.query("SELECT ?x { ?x ?p ?o } # " + "x" * 700)
    assert seen[-1][:2] == ("POST", "application/x-www-form-urlencoded")
    assert remote.triples(spark, (None, IRI(E + "p"), IRI(E + "o"))).count() == 1
    assert remote.triples(spark, (IRI(E + "s"), IRI(E + "p"), IRI(E + "o"))).count() == 1
    remote.add([(IRI(E + "s"), IRI(E + "p"), Literal(1))], IRI(E + "g"))
    remote.remove((None, IRI(E + "p"), None))
    remote.commit()
    assert seen[-1][1] == "application/sparql-update" and "INSERT DATA" in seen[-1][2] and "DELETE { ?S" in seen[-1][2]
    ds = Dataset.of(spark, [(IRI(E + "a"), IRI(E + "p"), 1), (IRI(E + "b"), IRI(E + "p"), 2)])
    text = f"SELECT ?x ?o {{ ?x <{E}p> ?o SERVICE <{url}> {{ ?x <{E}q> ?z }} }}"
    assert compiler.SERVICE is service
    assert [r["o"].lex for r in ds.query(text).rows()] == ["1"]
    silent = text.replace(f"SERVICE <{url}>", "SERVICE SILENT <http://127.0.0.1:9/>")
    assert len(ds.query(silent).rows()) == 2
    compiler.SERVICE = None
    try:
        with pytest.raises(NotImplementedError):
            ds.query(text)
    finally:
        compiler.SERVICE = service


def test_rewrites_extend_evaluation(spark):
    """Instances of a subclass count as instances of the class, by a rewrite of type patterns."""
    kind, sub = IRI(RDF + "type"), IRI(RDFS + "subClassOf")
    ds = Dataset.of(spark, [(IRI(E + "x"), kind, IRI(E + "Cat")), (IRI(E + "Cat"), sub, IRI(E + "Animal"))])

    def infer(node):
        if isinstance(node, N.BGP) and any(p == kind for _, p, _ in node.patterns):
            path = N.Seq((N.Link(kind), N.Mul(N.Link(sub), "*")))
            return N.BGP([(s, path if p == kind else p, o) for s, p, o in node.patterns])
        return None

    text = f"SELECT ?x {{ ?x a <{E}Animal> }}"
    assert ds.query(text).rows() == []
    compiler.REWRITES.append(infer)
    try:
        assert ds.query(text).rows() == [{"x": IRI(E + "x")}]
    finally:
        compiler.REWRITES.remove(infer)


def test_shapes(spark):
    p, q = N.Link(IRI(E + "p")), N.Link(IRI(E + "q"))
    for path in (p, p / q, p | ~q, (p / ~q) * "*", N.Mul(p, "+"), N.Mul(p | q, "?")):
        node, triples = build_path(path)
        graph = Graph.of(spark, [*triples, (IRI(E + "s"), IRI(E + "path"), node)])
        assert parse_path(graph, graph.value(IRI(E + "s"), IRI(E + "path"))) == path


def test_exports(spark):
    a, b, p, q = (IRI(E + n) for n in "abpq")
    g = Graph.of(spark, [(a, p, b), (a, q, b), (b, p, a), (p, IRI(RDFS + "domain"), a), (p, IRI(RDFS + "range"), b), (a, IRI(RDF + "type"), IRI(RDFS + "Class"))])
    assert edges(g.quads).count() == 6 and vertices(g.quads).count() == 4
    rows = {(r.src, r.dst): r.weight for r in weighted(g.quads).collect()}
    assert rows[a.n3(), b.n3()] == 2 and {(r.src, r.dst): r.weight for r in weighted(g.quads, False).collect()}[a.n3(), b.n3()] == 3
    assert '"http://e/a" -> "http://e/b" [label="http://e/p"]' in schema_dot(g.quads)
    assert g.serialize("dot").startswith("digraph")


def test_closure_and_transactions(spark):
    from pyspark.sql import functions as F

    a, p = IRI(E + "a"), IRI(E + "p")
    g = Graph.of(spark, [(a, p, IRI(E + "b")), (IRI(E + "b"), p, IRI(E + "c")), (IRI(E + "c"), p, a)])
    step = lambda new, graph: new.join(graph.quads, new.n == graph.quads.s).select(F.col("o").alias("n"))
    assert g.closure(step, a).count() == 3
    ds = Dataset.of(spark, [(a, p, 1)])
    ds.begin()
    ds.add([(a, p, 2)])
    ds.rollback()
    assert len(ds) == 1
    ds.add([(a, p, 3)]).commit()
    ds.rollback()
    assert len(ds) == 2


def test_namespaces():
    ns = Namespace(E)
    assert ns.a == ns["a"] == IRI(E + "a") and IRI(E + "b") in ns and URIPattern(E + "x/{}").format(3) == IRI(E + "x/3")
    closed = ClosedNamespace(E, ["a"])
    assert closed.a == IRI(E + "a")
    with pytest.raises(AttributeError):
        closed.b  # noqa: B018
    assert split_iri(E + "x/12ab") == (E + "x/12", "ab") and fragment(IRI(E + "#f")) == "f" and defrag(IRI(E + "#f")) == IRI(E)
    names = Prefixes({"e": E})
    assert names.bind("e", "http://other/") == "e1" and names.curie(E + "a") == "e:a" and names.expand("e1:z") == IRI("http://other/z")
    assert names.bind("f", E, override=False) == "e" and names.curie("http://third/q") == "ns1:q"
    assert names.bind("e", "http://fourth/", replace=True) == "e" and names.expand("e:x") == IRI("http://fourth/x")


def test_literals():
    day = Literal("2011-01-31", datatype=XSD + "date")
    assert Lit.add(day, Literal("P1M", datatype=XSD + "yearMonthDuration")).lex == "2011-02-28"
    assert Lit.subtract(Literal(5), Literal(7)) == Literal(-2) and Lit.add(Literal(1), Literal(0.5)) == Literal(1.5)
    assert Lit.add(Literal("a"), Literal("b")) == Literal("ab") and Lit.absolute(Literal(-3)) == Literal(3) and Lit.invert(Literal(1)) == Literal(-2)
    assert Lit.normalize(Literal("007", datatype=XSD + "integer")).lex == "7" and Lit.normalize(Literal("1.500", datatype=XSD + "decimal")).lex == "1.5"
    with pytest.raises(TypeError):
        Lit.negate(Literal("x"))
    Lit.bind_datatype(E + "pair", lambda t: tuple(t.split(",")), ",".join)
    assert Lit.value(Term(3, "a,b", E + "pair")) == ("a", "b")
    Lit.reset_datatypes()
    assert parse_term('"x"^^<http://e/t>') == Term(3, "x", E + "t") and parse_term("-1.5e3").dt == XSD + "double" and parse_term("") is None


def test_builder_and_command_line(spark, tmp_path, capsys):
    b = Builder(E + "me")
    b.value(IRI(E + "name"), "Me")
    with b.rel(IRI(E + "knows"), E + "you"):
        b.value(IRI(E + "name"), "You")
    graph = b.graph(spark)
    assert len(graph) == 3
    (tmp_path / "x.ttl").write_text(graph.serialize())
    assert cli.main(["convert", str(tmp_path / "x.ttl"), "--to", "nt"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    cli.main(["query", str(tmp_path / "x.ttl"), "--sparql", f"SELECT ?n {{ ?x <{E}name> ?n }}", "--to", "csv"], spark)
    assert sorted(capsys.readouterr().out.split()) == ["Me", "You", "n"]
    (tmp_path / "t.csv").write_text("id,full name\n1,Ann\n2,\n")
    cli.main(["lift", str(tmp_path / "t.csv"), "--base", E, "--id", "id"], spark)
    assert '<http://e/1> <http://e/fullName> "Ann" .' in capsys.readouterr().out


def test_utilities():
    from quadrille import util

    assert util.unique([3, 1, 3]) == [3, 1] and util.more_than(iter(range(5)), 4) and not util.more_than([1], 1)
    assert util.date_time(1001265984) == "2001-09-23T17:26:24Z" and util.parse_date_time("2001-09-23T19:26:24+02:00") == 1001265984
    assert util.to_term("<http://e/a>") == IRI(E + "a") and util.to_term('"x"') == Literal("x") and util.to_term(None) is None
    assert util.guess_format("a.nq") == "nquads" and util.guess_format("a.unknown") == "turtle"


ROUND_TRIP = [
    "SELECT ?s (COUNT(DISTINCT ?o) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?s HAVING(COUNT(?o) > 1) ORDER BY DESC(?n) ?s LIMIT 3",
    "SELECT DISTINCT ?s ?x WHERE { ?s <http://e/p>|^<http://e/q> ?o OPTIONAL { ?o <http://e/p> ?x FILTER(?x > 1) } FILTER(!BOUND(?x) || ?x IN (1, 2)) }",
    "SELECT * WHERE { { ?s <http://e/q>+ ?o } UNION { VALUES (?s ?o) { (<http://e/a> UNDEF) } } MINUS { ?s <http://e/p> 1 } BIND(CONCAT(STR(?s), \"x\") AS ?c) }",
    "SELECT ?s WHERE { ?s ?p ?o FILTER NOT EXISTS { ?s <http://e/q> ?z } { SELECT (MAX(?v) AS ?m) WHERE { ?a <http://e/p> ?v } } }",
    "ASK { ?s !(<http://e/p>|^<http://e/q>) ?o }",
    "CONSTRUCT { ?s <http://e/z> ?o } WHERE { ?s <http://e/p> ?o FILTER(?o * 2 - 1 >= 3) }",
]


@pytest.mark.parametrize("text", ROUND_TRIP)
def test_algebra_as_text(spark, text):
    from quadrille.plans.syntax import parse_query
    from quadrille.plans.text import to_sparql

    a, b, p, q = (IRI(E + n) for n in "abpq")
    ds = Dataset.of(spark, [(a, p, 1), (a, p, 2), (b, p, 3), (a, q, b), (b, q, a), (b, IRI(E + "r"), 5)])

    def outcome(query):
        r = ds.query(query)
        if r.form == "ASK":
            return r.ask
        if r.form == "CONSTRUCT":
            return r.graph.collect()
        return sorted(map(repr, ({n: t for n, t in sorted(x.items())} for x in r.rows())))

    assert outcome(to_sparql(parse_query(text))) == outcome(text)


def test_store(spark, tmp_path):
    from quadrille.sources.store import QuadStore

    a, p, q = IRI(E + "a"), IRI(E + "p"), IRI(E + "q")
    store = QuadStore(spark, str(tmp_path / "store"))
    assert store.open().quads.count() == 0
    first = store.commit(Dataset.of(spark, [(a, p, 1), (a, q, 2), (a, p, 1)]).quads)
    ds = Dataset(spark, store.open())
    result = ds.query(f"SELECT ?o {{ ?s <{E}p> ?o }}")
    assert [r["o"] for r in result.rows()] == [Literal(1)]
    plan = result.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    store.commit(ds.add([(a, q, 3)]).quads)
    assert store.open().quads.count() == 3 and store.open(first).quads.count() == 2
    store.destroy()
    assert store.last() == -1


def test_csv_lift_all_lifts_every_customer(spark, tmp_path):
    from quadrille import queries

    rows = [(k, f"Customer#{k}", ["BUILDING", "MACHINERY"][k % 2]) for k in (*range(1, 121), 15_000)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(map(tuple, queries.all_queries()["csv_lift_all"](spark, str(tmp_path)).select("s", "p", "o").collect()))
    assert len(got) == 3 * len(rows)
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert got == sorted(duckdb.execute(queries.all_sql()["csv_lift_all"]).fetchall())
