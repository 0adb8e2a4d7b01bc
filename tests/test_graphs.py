"""Documents, the graph API, canonical labels, collections, lifting and change logs."""

import random

import pytest

from quadrille.graph import Aggregate, Dataset, Graph, Literal, Regex, Resource
from quadrille.operators.canonical import isomorphic, similar
from quadrille.operators.collections import Collection, Container, list_triples
from quadrille.plans.nodes import Link
from quadrille.sources import readers, writers
from quadrille.sources.lift import Column, lift
from quadrille.sources.turtle import TurtleParser, TurtleSyntaxError
from quadrille.streaming.changes import replay
from quadrille.terms import RDF, XSD, BNode, IRI, Literal as L, format_duration, parse_duration

E = "http://e/"
TRIG = r"""@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :T ; :s "plain", "l\"q\\\n\té"@en-GB, '''long "x"''', "\U0001F600" ; :n 1, 2.50, 1e3, true, "x"^^:dt ; :l ( 1 ( :b ) [] ) .
:b :r [ :p :a ; :q [ :z "deep" ] ] . _:x :same _:x .
:g { :s1 :p "in g" . _:y :p :a } GRAPH _:h { :s2 :p () }"""


@pytest.fixture(scope="module")
def quads(spark):
    return readers.read_text(spark, TRIG, "trig")


@pytest.mark.parametrize("form", ["nquads", "hext", "patch", "trig", "trix"])
def test_quads_round_trip(spark, quads, form):
    back = readers.read_text(spark, writers.to_text(quads, form, {"": E}), form)
    assert isomorphic(quads, back)


@pytest.mark.parametrize("form", ["nt", "turtle", "longturtle", "n3", "xml", "pretty-xml", "json-ld"])
def test_triples_round_trip(spark, quads, form):
    graph = Graph(quads.where("g IS NULL"))
    back = Graph(readers.read_text(spark, graph.serialize(form), form))
    assert graph.isomorphic(back)


@pytest.mark.parametrize("form", ["nt", "nquads", "hext", "turtle", "trig", "longturtle", "xml", "json-ld", "trix"])
def test_folders_round_trip(spark, quads, tmp_path, form):
    ground = quads.where("s.k > 1 AND o.k > 1 AND (g IS NULL OR g.k > 1)")
    if form in ("nt", "turtle", "longturtle", "xml"):
        ground = Graph(ground.where("g IS NULL")).quads
    writers.write(ground, str(tmp_path / form), form, {"": E})
    back = readers.read(spark, str(tmp_path / form), form)
    assert back.exceptAll(ground).isEmpty() and ground.exceptAll(back).isEmpty()


@pytest.mark.parametrize("form", ["nquads", "hext", "trig", "json-ld", "trix"])
def test_folders_keep_blank_nodes(spark, quads, tmp_path, form):
    writers.write(quads.repartition(3), str(tmp_path / form), form)
    assert isomorphic(quads, readers.read(spark, str(tmp_path / form), form, shared=True))


@pytest.mark.parametrize("form", ["pretty-xml", "n3", "turtle", "json-ld"])
def test_folders_of_bounded_documents(spark, tmp_path, form):
    """Records nest whole where they fit a document; a record and a subject that don't are spread over several."""
    node = lambda i, j: BNode(f"r{i}x{j}")
    data = []
    for i in range(12):
        data += [(IRI(E + f"a{i}"), IRI(E + "has"), node(i, 0)), (node(i, 0), IRI(E + "n"), L(str(i)))]
        data += [(node(i, 0), IRI(E + "part"), node(i, j)) for j in range(1, 3)] + [(node(i, j), IRI(E + "n"), L(f"{i}-{j}")) for j in range(1, 3)]
    data += [(BNode("hub"), IRI(E + "part"), BNode(f"big{i}")) for i in range(40)] + [(BNode(f"big{i}"), IRI(E + "n"), L(f"big {i}")) for i in range(40)]
    data += [(IRI(E + "hot"), IRI(E + "n"), L(f"hot {i}")) for i in range(50)]
    quads = Dataset.of(spark, data).quads
    writers.write(quads, str(tmp_path / form), form, {"": E}, records=20)
    back = readers.read(spark, str(tmp_path / form), form, shared=True)
    assert back.count() == len(data)
    if form in ("pretty-xml", "n3"):  # what nests has no label
        assert isomorphic(quads, back)
    else:
        assert back.exceptAll(quads).isEmpty()
    texts = [p.read_text() for p in (tmp_path / form).glob("part-*")]
    sizes = [len(list(readers.DOCUMENTS[readers.ALIASES.get(form, form)](t, "http://b/", ""))) for t in texts]
    assert sum(sizes) == len(data) and max(sizes) <= 20 and len(sizes) >= len(data) / 20
    named = {i for i in range(12) for t in texts if f"r{i}x" in t}
    assert not named if form in ("pretty-xml", "n3") else len(named) == 12


def test_folder_of_nothing(spark, tmp_path):
    for form in ("n3", "pretty-xml", "json-ld"):
        writers.write(Dataset.of(spark, []).quads, str(tmp_path / form), form)
        assert readers.read(spark, str(tmp_path / form), form).isEmpty()


def test_strict_and_lax_lines(spark):
    text = "<a:> <b:> <c:> .\nnonsense\n# comment\n\n<a:> <b:> \"x\"@EN . # end\r\n"
    with pytest.raises(Exception, match="not a statement"):
        readers.read_text(spark, text, "nt").collect()
    assert readers.read_text(spark, text, "nt", strict=False).count() == 2


@pytest.mark.parametrize("text", ["@prefix : <x> . :a :b", ":a :b :c .", "<a> <b> .", "<a> 'x' <c> .", "'x' <b> <c> .", "<a> <b> \"x\n\" ."])
def test_bad_turtle(text):
    with pytest.raises(TurtleSyntaxError):
        list(TurtleParser(text, "http://b/").parse())


RDFXML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://e/base">
<e:T rdf:about="a" e:x="att" xml:lang="en"><e:p rdf:resource="b"/><e:c rdf:parseType="Collection"><rdf:Description rdf:about="i"/></e:c>
<e:r rdf:parseType="Resource"><e:v rdf:datatype="http://www.w3.org/2001/XMLSchema#int">1</e:v></e:r><e:n><e:U rdf:nodeID="k"/></e:n><rdf:li>one</rdf:li><e:s rdf:ID="st">t</e:s></e:T></rdf:RDF>"""
TURTLE = """@prefix : <http://e/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :T ; :x "att"@en ; :p :b ; :c ( :i ) ; :r [ :v "1"^^xsd:int ] ; :n _:k ; rdf:_1 "one"@en ; :s "t"@en . _:k a :U .
<http://e/base#st> a rdf:Statement ; rdf:subject :a ; rdf:predicate :s ; rdf:object "t"@en ."""
JSONLD = """{"@context": {"@vocab": "http://e/", "id": "@id", "p": {"@type": "@id"}, "c": {"@container": "@list", "@type": "@id"}, "x": {"@language": "en"}, "s": {"@language": "en"}, "@base": "http://e/"},
"id": "a", "@type": "T", "x": "att", "p": "b", "c": ["i"], "r": {"v": {"@value": "1", "@type": "http://www.w3.org/2001/XMLSchema#int"}}, "n": {"id": "_:k", "@type": "U"},
"http://www.w3.org/1999/02/22-rdf-syntax-ns#_1": {"@value": "one", "@language": "en"}, "s": "t"}"""


def test_other_syntaxes_agree_with_turtle(spark):
    want = readers.read_text(spark, TURTLE, "turtle")
    assert isomorphic(readers.read_text(spark, RDFXML, "rdfxml", "http://e/doc"), want)
    less = want.where("s.lex != 'http://e/base#st'")
    assert isomorphic(readers.read_text(spark, JSONLD, "jsonld"), less)


def test_isomorphism(spark):
    rng = random.Random(1)

    def cycle(names):
        return [(BNode(a), IRI(E + "p"), BNode(b)) for a, b in zip(names, names[1:] + names[:1])]

    six = Graph.of(spark, cycle(list("abcdef")))
    names = [f"n{i}" for i in range(6)]
    rng.shuffle(names)
    assert six.isomorphic(Graph.of(spark, cycle(names)))
    two = Graph.of(spark, cycle(list("abc")) + cycle(list("def")))
    assert not six.isomorphic(two) and similar(six.quads, two.quads) is False or not six.isomorphic(two)
    more = Graph.of(spark, cycle(list("abcdef")) + [(BNode("a"), IRI(E + "q"), Literal(1))])
    both, here, there = six.diff(more)
    assert len(there) > 0 and len(both) + len(here) == 6
    assert more.canonical().collect() == more.canonical().canonical().collect() or len(more.canonical()) == 7


def test_isomorphism_of_many_copies(spark):
    """Thousands of equal records, alone and in linked pairs, with names of their own in each graph."""
    at = IRI(E + "at")

    def records(salt: str, pairs: int = 40) -> Graph:
        alone = [(BNode(f"{salt}{i}"), at, Literal(i % 3)) for i in range(2500)]
        ones = [(BNode(f"{salt}x{i}"), at, BNode(f"{salt}y{i}")) for i in range(pairs)]
        loops = [(BNode(f"{salt}{a}{i}"), IRI(E + "p"), BNode(f"{salt}{b}{i}")) for i in range(20) for a, b in ("uv", "vw", "wu")]
        return Graph.of(spark, alone + ones + loops)

    a, b = records("a"), records("zb")
    assert a.isomorphic(b) and not a.isomorphic(records("c", 39))
    assert a.canonical().quads.select("s").distinct().count() == 2500 + 40 + 60
    six = [(BNode(f"{n}{i}"), IRI(E + "p"), BNode(f"{n}{(i + 1) % 6}")) for n in "ab" for i in range(6)]
    threes = [(BNode(f"{n}{i}"), IRI(E + "p"), BNode(f"{n}{(i + 1) % 3}")) for n in "abcd" for i in range(3)]
    assert not Graph.of(spark, six).isomorphic(Graph.of(spark, threes))


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.parse(spark, data="@prefix : <http://e/> . :a :p 1, 2 ; :q :b . :b :q :c . :c :p 3 . :x :q :y . :bag a <http://www.w3.org/1999/02/22-rdf-syntax-ns#Bag> .").bind("", E)


def test_graph_api(spark, graph):
    a, p, q = (IRI(E + n) for n in "apq")
    assert len(graph) == 7 and (a, q, IRI(E + "b")) in graph and (a, q, a) not in graph
    assert graph.objects(a, p).count() == 2 and graph.subjects(p, unique=True).count() == 2
    assert graph.value(a, q) == IRI(E + "b") and graph.value(a, IRI(E + "none"), default=a) == a
    with pytest.raises(ValueError):
        graph.value(a, p, any=False)
    assert graph[a:p].count() == 2 and graph[a].count() == 3
    assert graph.triples(([a, IRI(E + "c")], p, None)).count() == 3
    assert graph.triples((Regex("http://e/[ab]"), None, None)).count() == 5
    assert {r[0].lex for r in graph.transitive_objects(a, q).collect()} == {E + n for n in "abc"}
    assert {r[0].lex for r in graph.transitive_subjects(q, IRI(E + "c")).collect()} == {E + n for n in "abc"}
    assert graph.triples((None, Link(q) / Link(q), None)).count() == 1
    assert {r[0].lex for r in graph.roots(q).collect()} == {E + "c", E + "y"}
    node, children = graph.tree(a, q, down=False)
    assert node == a and children[0][0] == IRI(E + "b") and children[0][1][0][0] == IRI(E + "c")
    assert not graph.connected() and len(graph.set((a, p, 9))) == 6 and len(graph.remove((a, None, None))) == 4
    other = Graph.of(spark, [(a, p, 1), (a, p, 7)])
    assert [len(x) for x in (graph + other, graph & other, graph - other, graph ^ other)] == [8, 1, 6, 7]
    assert len(Aggregate(graph, other)) == 9
    assert graph.qname(E + "a") == ":a" and graph.expand(":a") == a
    assert Resource(graph, a).value(q) == Resource(graph, IRI(E + "b"))
    blank = Graph.of(spark, [(BNode("n"), p, 1)])
    assert next(iter(blank.skolemize().collect()))[0].lex.startswith("http://localhost/.well-known/genid/")
    assert blank.skolemize().de_skolemize().isomorphic(blank)
    scopes = {r.scope: r for r in graph.void().collect() if r.scope == "dataset"}
    assert (scopes["dataset"].triples, scopes["dataset"].subjects) == (7, 5)


def test_collections(spark):
    head, triples = list_triples([L(1), L(2), L(3)])
    c = Collection(Graph.of(spark, triples), head)
    assert c.items() == [L(1), L(2), L(3)] and c.index(L(2)) == 1
    assert c.append(L(4)).items() == [L(1), L(2), L(3), L(4)] and c.set(0, L(9)).items()[0] == L(9)
    assert c.delete(1).items() == [L(1), L(3)] and len(c.clear().graph) == 0
    loop = Graph.of(spark, [(BNode("x"), IRI(RDF + "rest"), BNode("x")), (BNode("x"), IRI(RDF + "first"), L(1))])
    with pytest.raises(ValueError):
        loop.items(BNode("x"))
    b = Container.of(Graph.of(spark, [(IRI(E + "a"), IRI(E + "b"), 1)]), IRI(E + "bag"), [L("x"), L("y")])
    assert b.insert(2, L("m")).items() == [L("x"), L("m"), L("y")] and b.delete(1).items() == [L("y")] and b.index(L("y")) == 2


def test_lift(spark):
    df = spark.createDataFrame([("1", "A b", "x;y", "5", "no"), ("2", None, "", "z", "YES")], "id string, name string, tags string, n string, ok string")
    columns = {"name": Column(E + "name", "uri", prefix=E + "n/", cls=E + "N"), "tags": Column(E + "tag", split=";"), "n": Column(E + "n", "int"), "ok": Column(E + "ok", "bool")}
    got = Graph(lift(df, ["id"], E, columns, cls=E + "Row")).collect()
    one, two = IRI(E + "1"), IRI(E + "2")
    kind = IRI(RDF + "type")
    assert got == {
        (one, IRI(E + "name"), IRI(E + "n/A_b")), (IRI(E + "n/A_b"), kind, IRI(E + "N")), (one, IRI(E + "tag"), L("x")), (one, IRI(E + "tag"), L("y")), (one, IRI(E + "n"), L(5)), (one, kind, IRI(E + "Row")),
        (one, IRI(E + "ok"), L(False)), (two, IRI(E + "ok"), L(True)), (two, kind, IRI(E + "Row")),
    }


def test_patch_order_and_aborts(spark, tmp_path):
    text = "TX .\nA <a:> <b:> <c:> .\nD <a:> <b:> <c:> .\nA <a:> <b:> <d:> .\nTC .\nTX .\nA <a:> <b:> <e:> .\nTA .\n"
    got = Graph(readers.read_text(spark, text, "patch")).collect()
    assert {o.lex for _, _, o in got} == {"d:"}
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.rdp").write_text("A <a:> <b:> <c:> .\nA <a:> <b:> <d:> .\n")
    assert replay(spark, str(tmp_path / "log"), str(tmp_path / "state")).count() == 2
    (tmp_path / "log" / "2.rdp").write_text("D <a:> <b:> <c:> .\n")
    assert replay(spark, str(tmp_path / "log"), str(tmp_path / "state")).count() == 1


def test_dataset_api(spark):
    g = IRI(E + "g")
    ds = Dataset.of(spark, [(IRI(E + "a"), IRI(E + "p"), 1), (IRI(E + "a"), IRI(E + "p"), 1, g)])
    assert ds.graphs() == [None, g] and len(ds.graph(g)) == 1
    assert ds.query("SELECT * { ?s ?p ?o }").plan.df.count() == 1  # the union holds a triple once
    ds.add([(IRI(E + "b"), IRI(E + "p"), 2, g)]).remove((IRI(E + "a"), None, None))
    assert len(ds) == 1 and ds.remove_graph(g).graphs() == [None]


def test_durations():
    assert parse_duration("-P1Y2M3DT4H5M6.5S") == (-14, -(3 * 86400 + 4 * 3600 + 5 * 60) * 10**6 - 6_500_000)
    assert format_duration(14, 1_500_000) == "P1Y2MT1.5S" and format_duration(0, 0) == "PT0S"
    assert XSD


def test_components_read_links_once_and_need_few_rounds(spark, monkeypatch):
    from quadrille.operators import graphs

    rng = random.Random(12)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(k, k) for k in (3, 400)] + [(500, 501), (501, 502)]
    least = {k: k for link in links for k in link}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    term = lambda k: IRI(f"http://e/{k:04}")
    frame = spark.createDataFrame([(term(a), term(0), term(b), None) for a, b in links * 2], "s {0}, p {0}, o {0}, g {0}".format("struct<k:tinyint,lex:string,dt:string,lang:string>"))
    got = [(r.n.lex, r.root.lex) for r in graphs.components(frame).collect()]
    assert sorted(got) == sorted((term(k).lex, term(v).lex) for k, v in least.items())
    calls, cut = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df: calls.append(1) or cut(df))
    star = spark.createDataFrame([(term(k), term(0), term(k // 10), None) for k in range(100, 200)], frame.schema)
    assert len({r.root for r in graphs.components(star).collect()}) == 10
    assert len(calls) == 4
    assert graphs.components(star.limit(0)).collect() == []
