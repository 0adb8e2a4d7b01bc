"""Documents and endpoints over HTTP, from a server of this process."""

import http.server
import json
import threading
import urllib.parse

import pytest

from quadrille.graph import Dataset, Graph
from quadrille.sources.web import alternate, sniff
from quadrille.terms import IRI, Literal

E = "http://e/"
DOCUMENTS = {
    "/a.ttl": ("", "", "@prefix : <http://e/> . :a :p 1 ."),
    "/turtle": ("text/turtle; charset=utf-8", "", "@prefix : <http://e/> . :b :p 2 ; :name \"é\" ."),
    "/nq": ("application/octet-stream", "", "<http://e/c> <http://e/p> \"3\" <http://e/g> .\n_:x <http://e/p> \"4\" .\n"),
    "/rdf": ("application/rdf+xml", "", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description rdf:about="http://e/d"><e:p>5</e:p></rdf:Description></rdf:RDF>'),
    "/json": ("application/ld+json", "", json.dumps({"@context": "ctx", "@id": "http://e/f", "p": "6"})),
    "/ctx": ("application/ld+json", "", json.dumps({"@context": ["sub/ctx2", {"q": "http://e/q"}]})),
    "/sub/ctx2": ("application/ld+json", "", json.dumps({"@context": {"p": "http://e/p"}})),
    "/page": ("text/html", '<turtle>; rel="alternate"; type="text/turtle"', "<html><p>nothing here</p></html>"),
    "/round": ("application/ld+json", "", json.dumps({"@context": "round", "@id": "http://e/f", "p": "6"})),
}


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            parts = urllib.parse.urlsplit(self.path)
            asked.append((parts.path, self.headers.get("Accept", ""), urllib.parse.parse_qs(parts.query)))
            if parts.path.startswith("/sparql"):
                return self.sparql(urllib.parse.parse_qs(parts.query)["query"][0])
            if parts.path not in DOCUMENTS:
                return self.send_error(404)
            kind, link, text = DOCUMENTS[parts.path]
            self.send(kind, text, link)

        def do_POST(self):  # noqa: N802
            body = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            asked.append((urllib.parse.urlsplit(self.path).path, "", body))
            self.sparql(body["query"][0])

        def sparql(self, text):
            """?x is what was bound, ?z its length; of the second endpoint, its length and 100."""
            values = [v.strip("<>") for v in text.split("{", 2)[2].split("}")[0].replace("(", " ").replace(")", " ").split()] if "VALUES" in text else [E + "a"]
            more = 100 if "two" in self.path else 0
            rows = [{"x": {"type": "uri", "value": v}, "z": {"type": "literal", "value": str(len(v) + more)}} for v in values if v.startswith(E)]
            self.send("application/sparql-results+json", json.dumps({"head": {"vars": ["x", "z"]}, "results": {"bindings": rows}}))

        def send(self, kind, text, link=""):
            self.send_response(200)
            for name, value in (("Content-Type", kind), ("Link", link)):
                if value:
                    self.send_header(name, value)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *args):
            pass

    found = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", asked
    found.shutdown()


def objects(quads):
    return sorted((r.o.lex, r.g and r.g.lex) for r in quads.where(f"p.lex = '{E}p'").collect())


def test_documents_of_several_formats(spark, server):
    url, asked = server
    asked.clear()
    from quadrille.sources.readers import read

    quads = read(spark, [url + p for p in ("/a.ttl", "/turtle", "/nq", "/rdf", "/json", "/page")])
    assert objects(quads) == [("1", None), ("2", None), ("3", E + "g"), ("4", None), ("5", None), ("6", None)]
    assert objects(quads) and sum(p == "/a.ttl" for p, *_ in asked) == 1  # fetched once, read twice
    assert sum(p == "/turtle" for p, *_ in asked) == 2  # once for the page that names it
    assert all("text/turtle" in accept for p, accept, _ in asked if p == "/a.ttl")
    assert Graph.parse(spark, url + "/turtle").query(f'ASK {{ ?s <{E}name> "é" }}').ask
    with pytest.raises(Exception, match="404"):
        read(spark, url + "/none")
    with pytest.raises(Exception, match="go round"):
        read(spark, url + "/round").collect()


def test_load_over_http(spark, server):
    url, _ = server
    ds = Dataset.of(spark, []).update(f"LOAD <{url}/nq> ; LOAD <{url}/json> INTO GRAPH <{E}h> ; LOAD SILENT <{url}/none>")
    assert objects(ds.quads) == [("3", E + "g"), ("4", None), ("6", E + "h")]
    with pytest.raises(Exception, match="404"):
        Dataset.of(spark, []).update(f"LOAD <{url}/none>").quads.collect()


@pytest.mark.parametrize("text,form", [
    ('["a", "b", "c", "", "", ""]\n', "hext"), ('[{"@id": "x"}]', "jsonld"), ('{"@id": "x"}', "jsonld"), ("# c\n<http://a> <http://b> <http://c> .\n", "nquads"), ('_:a <http://b> "x\\"y"@en <http://g> .', "nquads"),
    ("<?xml version='1.0'?>\n<TriX xmlns='x'>", "trix"), ("<?xml version='1.0'?><rdf:RDF>", "rdfxml"), ("<rdf:RDF>", "rdfxml"), ("<!DOCTYPE html><html>", "jsonld"), ("@prefix : <x> .\n:a :b :c .", "turtle"), ("PREFIX e: <x>\ne:g { e:a e:b e:c }", "trig"),
    ("GRAPH <http://g> { }", "trig"), ("TX .\nA <http://a> <http://b> <http://c> .", "patch"), ("", "turtle"), ("<http://a> <http://b> 1 ; <http://c> 2 .", "turtle"),
])
def test_what_a_document_starts_with(text, form):
    assert sniff(text) == form
    assert sniff(text, "text/turtle") == "turtle" and sniff(text, "text/plain", "http://x/y.rdf?z=1") == "rdfxml"


def test_alternates():
    links = ['<style.css>; rel=stylesheet, </data.rdf>; type="application/rdf+xml"; rel="alternate"', '<b>; rel="alternate"; type="text/turtle"']
    assert alternate(links, "http://h/x/y") == "http://h/data.rdf" and alternate(links[:0], "http://h/") is None


def test_service_is_a_bind_join(spark, server):
    url, asked = server
    asked.clear()
    ds = Dataset.of(spark, [(IRI(f"{E}n{i}"), IRI(E + "p"), i % 3) for i in range(250)] + [(IRI(E + "n1"), IRI(E + "other"), 1)])
    text = f"PREFIX e: <{E}> SELECT ?x ?z {{ ?x e:p ?o SERVICE <{url}/sparql/one> {{ ?x e:len ?z }} }}"
    found = {r["x"].lex: r["z"].lex for r in ds.query(text).rows()}
    assert found == {f"{E}n{i}": str(len(f"{E}n{i}")) for i in range(250)}
    sent = [q["query"][0] for p, _, q in asked]
    assert 3 <= len(sent) <= 12 and all("VALUES (?x)" in q and f"<{E}len>" in q for q in sent)
    assert sum(q.count(f"<{E}n") for q in sent) == 250


def test_service_endpoints_in_a_variable(spark, server):
    url, asked = server
    asked.clear()
    at = [IRI(f"{url}/sparql/{n}") for n in ("one", "two")]
    ds = Dataset.of(spark, [(IRI(f"{E}n{i}"), IRI(E + "at"), at[i % 2]) for i in range(6)])
    rows = ds.query(f"SELECT ?x ?z ?e {{ ?x <{E}at> ?e SERVICE ?e {{ ?x <{E}len> ?z }} }}").rows()
    assert {(r["x"].lex, r["z"].lex) for r in rows} == {(f"{E}n{i}", str(len(E) + 2 + 100 * (i % 2))) for i in range(6)}
    assert {p for p, *_ in asked} == {"/sparql/one", "/sparql/two"}


def test_service_optional_silent_and_alone(spark, server):
    url, asked = server
    ds = Dataset.of(spark, [(IRI(E + "a"), IRI(E + "p"), Literal(1)), (IRI("http://other/b"), IRI(E + "p"), Literal(2))])
    rows = ds.query(f"SELECT ?x ?z {{ ?x <{E}p> ?o OPTIONAL {{ SERVICE <{url}/sparql> {{ ?x <{E}len> ?z }} }} }}").rows()
    assert sorted((r["x"].lex, r["z"].lex if "z" in r else None) for r in rows) == [(E + "a", str(len(E) + 1)), ("http://other/b", None)]
    silent = ds.query(f"SELECT ?x ?z {{ ?x <{E}p> ?o SERVICE SILENT <{url}/none> {{ ?x <{E}len> ?z }} }}").rows()
    assert len(silent) == 2 and not any("z" in r for r in silent)
    alone = ds.query(f"SELECT ?x {{ SERVICE <{url}/sparql> {{ ?x <{E}len> ?z }} }}").rows()
    assert [r["x"].lex for r in alone] == [E + "a"]
