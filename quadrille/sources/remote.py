"""SPARQL endpoints over HTTP: queries, updates, pattern scans, and SERVICE as a bind join."""

from __future__ import annotations

import base64
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Val
from ..plans.nodes import Service
from ..plans.plan import Plan, fresh
from ..session import materialize
from ..terms import BNODE, IRI_KIND, TERM, Term, Var, term_schema
from .results import parse_json, parse_result

#: Longest query that is sent by GET; longer ones are posted.
GET_LIMIT = 600


class Endpoint:
    """One endpoint; ``method`` is GET, POST or POST_FORM, and GET falls back to POST for long queries."""

    def __init__(self, query_url: str, update_url: str | None = None, method: str = "GET", auth: tuple[str, str] | None = None, headers: dict[str, str] | None = None, timeout: float = 60):
        self.query_url, self.update_url, self.method, self.timeout = query_url, update_url or query_url, method, timeout
        self.headers = dict(headers or {})
        if auth:
            self.headers["Authorization"] = "Basic " + base64.b64encode(":".join(auth).encode()).decode()
        self.edits: list[str] = []

    def _send(self, url: str, data: bytes | None, headers: dict[str, str]) -> tuple[str, str]:
        request = urllib.request.Request(url, data, {**self.headers, **headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read().decode(), (answer.headers.get_content_type() or "")

    def query(self, text: str, default_graph: str | None = None, named_graph: str | None = None):
        """(variables, solutions), or the truth value of ASK."""
        asked = {k: v for k, v in (("default-graph-uri", default_graph), ("named-graph-uri", named_graph)) if v}
        accept = {"Accept": "application/sparql-results+json, application/sparql-results+xml;q=0.8"}
        if self.method == "GET" and len(text) < GET_LIMIT:
            body, kind = self._send(self.query_url + "?" + urllib.parse.urlencode({**asked, "query": text}), None, accept)
        elif self.method == "POST":
            url = self.query_url + ("?" + urllib.parse.urlencode(asked) if asked else "")
            body, kind = self._send(url, text.encode(), {**accept, "Content-Type": "application/sparql-query"})
        else:
            body, kind = self._send(self.query_url, urllib.parse.urlencode({**asked, "query": text}).encode(), {**accept, "Content-Type": "application/x-www-form-urlencoded"})
        return parse_result(body, kind) if kind.endswith("xml") else parse_json(body)

    def update(self, text: str) -> None:
        self._send(self.update_url, text.encode(), {"Content-Type": "application/sparql-update"})

    def solutions(self, spark: SparkSession, text: str) -> DataFrame:
        """Solutions as term columns."""
        names, rows = self.query(text)
        return spark.createDataFrame([tuple(None if n not in r else tuple(r[n]) for n in names) for r in rows], term_schema(*names))

    def triples(self, spark: SparkSession, pattern: tuple, graph: Term | None = None, limit: int | None = None) -> DataFrame:
        """Triples (s, p, o, g) that match; None matches anything."""
        if any(t is not None and t.k == 1 for t in pattern):
            raise ValueError("an endpoint has no blank nodes of ours")
        slots = " ".join(t.n3() if t is not None else f"?{c}" for c, t in zip("spo", pattern))
        body = f"GRAPH {graph.n3()} {{ {slots} }}" if graph is not None else slots
        tail = f" LIMIT {limit}" if limit is not None else ""
        if None not in pattern:
            found = self.query(f"ASK {{ {body} }}")
            rows = [{}] if found else []
        else:
            _, rows = self.query(f"SELECT * WHERE {{ {body} }}{tail}")
        data = [tuple(tuple(r.get(c, t)) for c, t in zip("spo", pattern)) + (tuple(graph) if graph else None,) for r in rows]
        return spark.createDataFrame(data, term_schema(*"spog"))

    def graphs(self) -> list[Term]:
        return [r["g"] for r in self.query("SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } }")[1]]

    def __len__(self) -> int:
        return int(self.query("SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }")[1][0]["n"].lex)

    # Buffered edits

    def add(self, triples, graph: Term | None = None) -> None:
        body = " ".join(f"{s.n3()} {p.n3()} {o.n3()} ." for s, p, o in triples)
        self.edits.append(f"INSERT DATA {{ GRAPH {graph.n3()} {{ {body} }} }}" if graph else f"INSERT DATA {{ {body} }}")

    def remove(self, pattern: tuple, graph: Term | None = None) -> None:
        slots = " ".join(t.n3() if t is not None else f"?{c}" for c, t in zip("SPO", pattern))
        self.edits.append((f"WITH {graph.n3()} " if graph else "") + f"DELETE {{ {slots} }} WHERE {{ {slots} }}")

    def commit(self) -> None:
        if self.edits:
            self.update(";\n".join(self.edits))
        self.edits = []

    def rollback(self) -> None:
        self.edits = []


#: Bindings that are sent in one request.
BATCH = 100


def service(spark: SparkSession, node: Service, left: Plan | None = None, timeout: float = 60) -> Plan:
    """The solutions of a SERVICE clause that can meet those of ``left``, as a bind join.

    The distinct bindings that ``left`` has for the clause's variables are dealt over executors, which send
    them ``BATCH`` at a time as VALUES before the pattern, to the endpoint that is named or bound. Without
    such variables the pattern is sent once. Bindings with a blank node meet nothing elsewhere, and unbound
    variables are sent as UNDEF. With SILENT, a request that fails gives its bindings back as they were.
    What came back is kept in the shared checkpoint folder, so that no request is sent twice.
    """
    from ..plans.syntax import visible
    from ..plans.text import Writer

    names = sorted(visible(node.p))
    given = [n for n in names if left is not None and n in left.vars]
    at = node.term.name if isinstance(node.term, Var) else None
    if at is not None and (left is None or at not in left.vars):
        raise ValueError("SERVICE needs the IRI of an endpoint, or a variable that is bound before it")
    sent = given if at is None or at in given else [*given, at]
    if sent:
        p = left.as_terms(sent)
        rows = p.df.select(*[p.vars[n].col.alias(f"v{k}") for k, n in enumerate(sent)]).distinct()
    else:
        rows = spark.range(1).select(F.lit(None).cast(TERM).alias("v0"))
    body, out = Writer().group(node.p), list(dict.fromkeys([*sent, *names]))
    endpoint = None if at is not None else node.term.lex

    def ask(url: str, bindings: list[dict]) -> list[dict]:
        columns = [n for n in given]
        values = " ".join("(" + " ".join(b[n].n3() if b.get(n) is not None else "UNDEF" for n in columns) + ")" for b in bindings)
        text = f"SELECT * WHERE {{ VALUES ({' '.join(f'?{n}' for n in columns)}) {{ {values} }} {body} }}" if columns else f"SELECT * WHERE {{ {body} }}"
        try:
            _, found = Endpoint(url, timeout=timeout).query(text)
        except Exception:
            if not node.silent:
                raise
            return bindings
        return [{**r, at: Term(IRI_KIND, url)} if at is not None else r for r in found]

    def run(batches):
        import pandas as pd

        for batch in batches:
            by_url: dict[str, list[dict]] = {}
            for row in batch.itertuples(index=False):
                b = {n: None if v is None else Term(*(v[c] for c in Term._fields)) for n, v in zip(sent, row)}
                url = endpoint if at is None else b[at].lex if b[at] is not None and b[at].k == IRI_KIND else None
                if url is not None and not any(t is not None and t.k == BNODE for t in b.values()):
                    by_url.setdefault(url, []).append(b)
            for url, bindings in by_url.items():
                for k in range(0, len(bindings), BATCH):
                    found = ask(url, bindings[k : k + BATCH])
                    yield pd.DataFrame([[None if r.get(n) is None else r[n]._asdict() for n in out] for r in found], columns=[f"v{k}" for k in range(len(out))])

    schema = ", ".join(f"v{k} {TERM}" for k in range(len(out))) or f"v0 {TERM}"
    found = materialize(rows.mapInPandas(run, schema))
    cols = {n: fresh(n) for n in out}
    if not out:
        return Plan(found.select(F.lit(1).alias(fresh("one"))))
    # Bound on the left for certain, and sent, is bound in what comes back.
    sure = frozenset(n for n in sent if n in left.certain) if sent else frozenset()
    return Plan(found.select(*[F.col(f"v{k}").alias(cols[n]) for k, n in enumerate(out)]), {n: Val("term", F.col(cols[n])) for n in out}, sure)
