"""Query results as documents: SPARQL XML, JSON, CSV and TSV, text tables, and the result-set vocabulary."""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from ..terms import BNODE, IRI_KIND, BNode, IRI, Literal, Term, parse_term

SPARQL = "http://www.w3.org/2005/sparql-results#"
RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"
#: Names and media types of the formats.
FORMATS = {
    "xml": "xml", "application/sparql-results+xml": "xml", "srx": "xml",
    "json": "json", "application/sparql-results+json": "json", "srj": "json",
    "csv": "csv", "text/csv": "csv",
    "tsv": "tsv", "text/tab-separated-values": "tsv",
    "txt": "txt", "text/plain": "txt",
}

Solutions = tuple[list[str], list[dict[str, Term]]]


def parse_result(text: str, form: str) -> Solutions | bool:
    """(variables, solutions) of SELECT, or the truth value of ASK."""
    return {"xml": parse_xml, "json": parse_json, "csv": parse_csv, "tsv": parse_tsv}[FORMATS[form]](text)


def parse_xml(text: str) -> Solutions | bool:
    root = ET.fromstring(text)
    tag = lambda n: f"{{{SPARQL}}}{n}"
    if (b := root.find(tag("boolean"))) is not None:
        return b.text.strip() == "true"

    def value(e) -> Term:
        x = e[0]
        kind, text = x.tag.removeprefix(f"{{{SPARQL}}}"), x.text or ""
        if kind == "uri":
            return IRI(text)
        if kind == "bnode":
            return BNode(text)
        return Literal(text, x.get("{http://www.w3.org/XML/1998/namespace}lang"), x.get("datatype"))

    names = [v.get("name") for v in root.iter(tag("variable"))]
    return names, [{b.get("name"): value(b) for b in r.iter(tag("binding"))} for r in root.iter(tag("result"))]


def parse_json(text: str) -> Solutions | bool:
    doc = json.loads(text)
    if "boolean" in doc:
        return doc["boolean"]

    def value(x: dict) -> Term:
        if x["type"] == "uri":
            return IRI(x["value"])
        if x["type"] == "bnode":
            return BNode(x["value"])
        return Literal(x["value"], x.get("xml:lang"), x.get("datatype"))

    return doc["head"].get("vars", []), [{n: value(x) for n, x in row.items()} for row in doc["results"]["bindings"]]


def parse_csv(text: str) -> Solutions:
    """Without types: ``_:`` starts a blank node, http(s) an IRI, anything else is a plain literal."""
    rows = list(csv.reader(io.StringIO(text)))

    def value(x: str) -> Term:
        return BNode(x[2:]) if x.startswith("_:") else IRI(x) if re.match("https?://", x) else Literal(x)

    return rows[0], [{n: value(x) for n, x in zip(rows[0], row) if x} for row in rows[1:] if row]


def parse_tsv(text: str) -> Solutions:
    lines = [line.rstrip("\r") for line in text.split("\n")]
    names = [n.lstrip("?") for n in lines[0].split("\t")]
    body = lines[1:-1] if lines[-1] == "" else lines[1:]
    return names, [{n: t for n, x in zip(names, line.split("\t")) if (t := parse_term(x)) is not None} for line in body]


def parse_result_graph(triples) -> Solutions | bool:
    """A result set described in a graph."""
    by: dict[Term, dict[str, list[Term]]] = {}
    for s, p, o in triples:
        by.setdefault(s, {}).setdefault(p.lex, []).append(o)
    root = next(s for s, d in by.items() if IRI(RS + "ResultSet") in d.get("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", []))
    if RS + "boolean" in by[root]:
        return by[root][RS + "boolean"][0].lex == "true"
    index = lambda n: int(by[n].get(RS + "index", [Literal(0)])[0].lex)
    rows = [{by[b][RS + "variable"][0].lex: by[b][RS + "value"][0] for b in by[n].get(RS + "binding", [])} for n in sorted(by[root].get(RS + "solution", []), key=index)]
    return [t.lex for t in by[root].get(RS + "resultVariable", [])], rows


def write_result(result, form: str = "json") -> str:
    form = FORMATS.get(form, form)
    if result.form == "ASK":
        if form == "json":
            return json.dumps({"head": {}, "boolean": result.ask})
        if form == "xml":
            return f'<?xml version="1.0"?>\n<sparql xmlns="{SPARQL}"><head/><boolean>{str(result.ask).lower()}</boolean></sparql>\n'
        if form == "txt":
            return str(result.ask)
        raise ValueError(f"{form} holds solutions only")
    if result.form != "SELECT":
        return result.graph.serialize(form)
    return WRITERS[form](result.names, result)


def write_json(names: list[str], rows) -> str:
    def value(t: Term) -> dict:
        if t.k == IRI_KIND:
            return {"type": "uri", "value": t.lex}
        if t.k == BNODE:
            return {"type": "bnode", "value": t.lex}
        return {"type": "literal", "value": t.lex} | ({"xml:lang": t.lang} if t.lang else {"datatype": t.dt} if t.dt else {})

    return json.dumps({"head": {"vars": names}, "results": {"bindings": [{n: value(t) for n, t in row.items()} for row in rows]}}, ensure_ascii=False)


def write_xml(names: list[str], rows) -> str:
    def value(t: Term) -> str:
        if t.k == IRI_KIND:
            return f"<uri>{escape(t.lex)}</uri>"
        if t.k == BNODE:
            return f"<bnode>{escape(t.lex)}</bnode>"
        kind = f' xml:lang="{t.lang}"' if t.lang else f' datatype="{escape(t.dt)}"' if t.dt else ""
        return f"<literal{kind}>{escape(t.lex)}</literal>"

    head = "".join(f'<variable name="{n}"/>' for n in names)
    body = "".join("<result>" + "".join(f'<binding name="{n}">{value(t)}</binding>' for n, t in row.items()) + "</result>" for row in rows)
    return f'<?xml version="1.0"?>\n<sparql xmlns="{SPARQL}"><head>{head}</head><results>{body}</results></sparql>\n'


def write_csv(names: list[str], rows) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(names)
    for row in rows:
        writer.writerow([("_:" if row[n].k == BNODE else "") + row[n].lex if n in row else "" for n in names])
    return out.getvalue()


def write_tsv(names: list[str], rows) -> str:
    lines = ["\t".join(f"?{n}" for n in names)]
    lines += ["\t".join(row[n].n3() if n in row else "" for n in names) for row in rows]
    return "\n".join(lines) + "\n"


def write_txt(names: list[str], rows) -> str:
    cells = [[row[n].n3() if n in row else "-" for n in names] for row in rows]
    widths = [max([len(n), *(len(r[i]) for r in cells)]) for i, n in enumerate(names)]
    line = lambda r: " | ".join(x.center(w) for x, w in zip(r, widths)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * w for w in widths), *map(line, cells)]) + "\n"


WRITERS = {"json": write_json, "xml": write_xml, "csv": write_csv, "tsv": write_tsv, "txt": write_txt}

