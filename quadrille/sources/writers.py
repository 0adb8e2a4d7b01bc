"""Quads to documents. ``write`` makes a folder of part files in parallel; ``to_text`` one document on the driver.

Line formats are made by the JVM. Folders of the other formats hold a bounded document to a file, whose blank nodes
are named, as other files may name them too; ``read`` them with ``shared``. Nested RDF/XML and N3 put all triples of
linked blank nodes into one document, where they nest.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable
from functools import cache, partial, reduce
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import BNODE, IRI_KIND, LITERAL, RDF, XSD, Term, n3, shorten
from .rdfxml import TRIX

NIL = Term(IRI_KIND, RDF + "nil")
FIRST, REST, TYPE = (Term(IRI_KIND, RDF + n) for n in ("first", "rest", "type"))
ALIASES = {
    "nt11": "nt", "ntriples": "nt", "application/n-triples": "nt", "nq": "nquads", "application/n-quads": "nquads", "ttl": "turtle", "text/turtle": "turtle", "application/trig": "trig",
    "xml": "rdfxml", "application/rdf+xml": "rdfxml", "pretty-xml": "rdfxml-nested", "json-ld": "jsonld", "application/ld+json": "jsonld", "text/n3": "n3", "application/trix": "trix",
}


# Line formats


def _nt(quads: DataFrame) -> Column:
    return F.concat(n3(F.col("s")), F.lit(" "), n3(F.col("p")), F.lit(" "), n3(F.col("o")), F.lit(" ."))


def _nq(quads: DataFrame) -> Column:
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), n3(F.col("g")))).otherwise("")
    return F.concat(n3(F.col("s")), F.lit(" "), n3(F.col("p")), F.lit(" "), n3(F.col("o")), g, F.lit(" ."))


def _hext(quads: DataFrame) -> Column:
    name = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.when(F.col(c)["k"] == BNODE, "_:").otherwise(""), F.col(c)["lex"]))
    o = F.col("o")
    kind = F.when(o["k"] == IRI_KIND, "globalId").when(o["k"] == BNODE, "localId").when(o["lang"].isNotNull(), RDF + "langString").otherwise(F.coalesce(o["dt"], F.lit(XSD + "string")))
    return F.to_json(F.array(name("s"), name("p"), F.concat(F.when(o["k"] == BNODE, "_:").otherwise(""), o["lex"]), kind, F.coalesce(o["lang"], F.lit("")), name("g")))


LINES = {"nt": _nt, "nquads": _nq, "hext": _hext}


def lines(quads: DataFrame, form: str) -> DataFrame:
    """One ``value`` for each quad, in a line format."""
    return quads.select(LINES[form](quads).alias("value"))


def patch_lines(quads: DataFrame | None = None, old: DataFrame | None = None, operation: str = "add") -> DataFrame:
    """RDF Patch lines: all quads added or removed, or, with ``old``, what turns it into ``quads``."""
    if old is not None:
        gone, more = old.exceptAll(quads), quads.exceptAll(old)
        return _ops(gone, "D").union(_ops(more, "A"))
    return _ops(quads, {"add": "A", "remove": "D"}[operation])


def _ops(quads: DataFrame, code: str) -> DataFrame:
    return quads.select(F.concat(F.lit(code + " "), _nq(quads)).alias("value"))


DOCUMENT = 100_000  # triples


def write(quads: DataFrame, path: str, form: str = "nquads", prefixes: dict[str, str] | None = None, records: int = 0) -> None:
    """A folder of files; ``records`` bounds the lines or triples of a file (no bound for lines, ``DOCUMENT`` for others, if not given).

    Documents are cut from rows sorted by subject, so that a subject with very many triples lies in many. Linked
    blank nodes with more triples than the bound are named, not nested. A formula of N3 is never cut; triples of graphs
    named by IRIs, which N3 has not, are written without them.
    """
    form = ALIASES.get(form, form)
    if form == "patch":
        patch_lines(quads).write.text(path)
    elif form in LINES:
        out = lines(quads, form).write
        (out.option("maxRecordsPerFile", records) if records else out).text(path)
    elif form in PARTS or form in NESTED:
        bound, names = records or DOCUMENT, prefixes or {}
        flat = PARTS.get(form) or partial(TEXTS[form], inline=False)
        nested = TEXTS[form]

        def run(batches):
            rows, at, start = [], None, 0  # start: where the rows of the group begin that the last row is of
            written = False

            def made(some: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([(flat if at is None else nested)(some, names)])], names=["value"])

            for b in batches:
                for root, row in zip(strings(b.column(0)), zip(*(terms_of(b, 1 + 4 * k) for k in range(4)))):
                    if rows and ((root is None) != (at is None) or (root is None and len(rows) >= bound)):
                        yield made(rows)
                        rows, written = [], True
                    if root != at or not rows:
                        start, at = len(rows), root
                    rows.append(row)
                    if start and len(rows) > bound:  # groups before this one fill a document
                        yield made(rows[:start])
                        rows, start, written = rows[start:], 0, True
            if rows or not written:
                yield made(rows)

        rows = _grouped(quads, form, bound) if form in NESTED else quads.select("s", "p", "o", "g", F.lit(None).cast("string").alias("root"))
        keys = ["g", "s", "p", "o"] if form in ("trig", "trix", "jsonld") else ["s", "p", "o", "g"]
        single = F.col("root").isNull()
        spread = rows.repartitionByRange("root", *[F.when(single, F.col(c)) for c in keys]).sortWithinPartitions("root", *keys)
        fields = [F.col(c)[f].alias(f"{c}_{f}") for c in "spog" for f in Term._fields]
        spread.select("root", *fields).mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)
    else:
        raise ValueError(f"{form} is written as one document; use to_text")


def terms_of(batch: pa.RecordBatch, at: int) -> Iterable[Term | None]:
    """The terms whose four fields are columns of a batch, from ``at`` on."""
    kind, *texts = (batch.column(at + k) for k in range(4))
    if kind.null_count == batch.num_rows:
        return itertools.repeat(None, batch.num_rows)
    found = map(Term._make, zip(kind.fill_null(0).to_numpy().tolist(), *map(strings, texts)))
    return found if not kind.null_count else (t if t.k else None for t in found)


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pandas().tolist() if column.null_count < len(column) else [None] * len(column)


def _grouped(quads: DataFrame, form: str, bound: int) -> DataFrame:
    """Quads with the label of the group of linked blank nodes that they are to be nested in, if any.

    Blank nodes of one triple are linked, and in N3 a formula with all in it. Only linked ones go through components;
    another is a group by itself. Groups beyond the bound are fewer than rows by that factor, so these are broadcast.
    """
    from ..operators.graphs import components

    quads = quads.select("s", "p", "o", "g")
    formulae = form == "n3"
    if formulae:
        quads = quads.withColumn("g", F.when(F.col("g")["k"] == BNODE, F.col("g")))
    blank = [F.when(F.col(c)["k"] == BNODE, F.col(c)["lex"]) for c in ("gso" if formulae else "so")]
    quads = quads.withColumn("root", F.coalesce(*blank))
    linked = quads.where(reduce(Column.__or__, [b != F.col("root") for b in blank[1:]]))  # the condition by itself goes down to scans
    links = linked.select("root", F.explode(F.array(*blank[1:])).alias("o")).where("o <> root")
    if not links.isEmpty():
        groups = components(links.withColumnRenamed("root", "s")).select(F.col("n").alias("first"), F.col("root").alias("least"))
        quads = quads.withColumnRenamed("root", "first").join(groups, "first", "left").withColumn("root", F.coalesce("least", "first"))
    sized = quads.where("root IS NOT NULL").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("g").isNotNull()).alias("formula"))
    beyond = sized.where((F.col("size") > bound) & ~F.col("formula") if formulae else F.col("size") > bound)
    quads = quads.join(F.broadcast(beyond.select(F.col("root").alias("beyond"))), F.col("root") == F.col("beyond"), "left")
    return quads.select("s", "p", "o", "g", F.when(F.col("beyond").isNull(), F.col("root")).alias("root"))


def to_text(quads: DataFrame, form: str = "turtle", prefixes: dict[str, str] | None = None, **options) -> str:
    """One document, in a stable order."""
    form = ALIASES.get(form, form)
    if form in LINES:
        return "".join(sorted(r[0] + "\n" for r in lines(quads, form).toLocalIterator()))
    if form == "patch":
        body = "".join(sorted(r[0] + "\n" for r in patch_lines(quads, **options).toLocalIterator()))
        return f"TX .\n{body}TC .\n"
    if form == "longturtle" and options.get("canon"):
        from ..operators.canonical import canonical

        quads = canonical(quads)
    rows = sorted((tuple(None if t is None else Term(*t) for t in (r.s, r.p, r.o, r.g)) for r in quads.toLocalIterator()), key=repr)
    return TEXTS[form](rows, prefixes or {})


# Documents


class _Tree:
    """Triples by subject, with what can be written inside something else."""

    def __init__(self, rows: Iterable[tuple], inline: bool = True):
        self.by: dict[Term, dict[Term, list[Term]]] = {}
        uses: dict[Term, int] = {}
        for s, p, o, *_ in rows:
            self.by.setdefault(s, {}).setdefault(p, []).append(o)
            if o.k == BNODE:
                uses[o] = uses.get(o, 0) + 1
        self.inline = {n for n, c in uses.items() if c == 1 and n in self.by} if inline else set()
        parent = {o: s for s, d in self.by.items() for os in d.values() for o in os if o in self.inline}
        state: dict[Term, int] = {}  # walks up from each node: a walk that meets itself found a loop
        for walk, node in enumerate(list(parent), 1):
            while node in parent and node not in state:
                state[node] = walk
                node = parent[node]
            if state.get(node) == walk:
                self.inline.discard(node)  # a loop of single uses must start somewhere

    def heads(self) -> list[Term]:
        return [s for s in self.by if s not in self.inline]

    def list_items(self, node: Term) -> list[Term] | None:
        """Items of a well-formed list whose cells nothing else uses."""
        items, seen = [], set()
        while node != NIL:
            d = self.by.get(node, {})
            if node in seen or node not in self.inline or set(d) != {FIRST, REST} or len(d[FIRST]) != 1 or len(d[REST]) != 1:
                return None
            seen.add(node)
            items.append(d[FIRST][0])
            node = d[REST][0]
        return items


def _used(rows, prefixes: dict[str, str]) -> dict[str, str]:
    names = {t.lex for q in rows for t in q if t is not None and t.k == IRI_KIND} | {t.dt for q in rows for t in q if t is not None and t.dt}
    return {p: n for p, n in prefixes.items() if any(x.startswith(n) for x in names)}


def _turtle_term(t: Term, prefixes) -> str:
    if t.k == LITERAL and t.dt == XSD + "integer" and t.lex.lstrip("+-").isdigit():
        return t.lex
    if t.k == LITERAL and t.dt == XSD + "boolean" and t.lex in ("true", "false"):
        return t.lex
    return t.n3(prefixes)


def _turtle_body(rows, prefixes, long: bool = False, pad: str = "", inline: bool = True) -> str:
    tree = _Tree(rows, inline)

    def obj(t: Term, pad: str) -> str:
        if t.k == BNODE and t in tree.inline:
            items = tree.list_items(t)
            if items is not None:
                return "( " + " ".join(obj(i, pad + "    ") for i in items) + " )"
            return "[ " + props(t, pad + "    ") + " ]"
        return "()" if t == NIL else _turtle_term(t, prefixes)

    def props(s: Term, pad: str) -> str:
        d = tree.by[s]
        parts = []
        for p in sorted(d, key=lambda p: (p != TYPE, p)):
            name = "a" if p == TYPE else p.n3(prefixes)
            sep = f" ,\n{pad}        " if long else ", "
            parts.append(f"{name} " + (f"\n{pad}        " if long else "") + sep.join(obj(o, pad) for o in sorted(d[p])))
        return f" ;\n{pad}    ".join(parts)

    return "".join(f"{pad}{_turtle_term(s, prefixes)} {props(s, pad)} .\n" for s in sorted(tree.heads()))


def _prefix_lines(prefixes) -> str:
    return "".join(f"@prefix {p}: <{n}> .\n" for p, n in sorted(prefixes.items())) + ("\n" if prefixes else "")


def turtle(rows, prefixes, inline: bool = True) -> str:
    used = _used(rows, prefixes)
    return _prefix_lines(used) + _turtle_body(rows, used, inline=inline)


def long_turtle(rows, prefixes, inline: bool = True) -> str:
    used = _used(rows, prefixes)
    return _prefix_lines(used) + _turtle_body(rows, used, True, inline=inline)


def trig(rows, prefixes, inline: bool = True) -> str:
    used = _used(rows, prefixes)
    by: dict[Term | None, list] = {}
    for q in rows:
        by.setdefault(q[3], []).append(q)
    out = _prefix_lines(used) + (_turtle_body(by.pop(None), used, inline=inline) if None in by else "")
    for g in sorted(by):
        out += f"{g.n3(used)} {{\n{_turtle_body(by[g], used, pad='    ', inline=inline)}}}\n"
    return out


def n3_document(rows, prefixes, inline: bool = True) -> str:
    """Turtle, with graphs named by blank nodes as formulae."""
    used = _used(rows, prefixes)
    inner: dict[Term, list] = {}
    for q in rows:
        if q[3] is not None:
            inner.setdefault(q[3], []).append(q)

    def slot(t: Term) -> str:
        return "{\n" + _turtle_body(inner[t], used, pad="    ") + "}" if t in inner else _turtle_term(t, used)

    lines = [f"{slot(s)} {'=>' if p.lex.endswith('/log#implies') else p.n3(used)} {slot(o)} .\n" for s, p, o, g in rows if g is None and (s in inner or o in inner)]
    plain = [q for q in rows if q[3] is None and q[0] not in inner and q[2] not in inner]
    return _prefix_lines(used) + _turtle_body(plain, used, inline=inline) + "".join(lines)


def trix(rows, prefixes) -> str:
    def value(t: Term) -> str:
        if t.k == IRI_KIND:
            return f"<uri>{escape(t.lex)}</uri>"
        if t.k == BNODE:
            return f"<id>{escape(t.lex)}</id>"
        if t.dt:
            return f"<typedLiteral datatype={quoteattr(t.dt)}>{escape(t.lex)}</typedLiteral>"
        return f"<plainLiteral{f' xml:lang={quoteattr(t.lang)}' if t.lang else ''}>{escape(t.lex)}</plainLiteral>"

    by: dict[Term | None, list] = {}
    for q in rows:
        by.setdefault(q[3], []).append(q)
    body = ""
    for g in sorted(by, key=lambda g: (g is not None, g or ())):
        body += "<graph>" + (value(g) if g else "") + "".join(f"<triple>{''.join(map(value, q[:3]))}</triple>\n" for q in by[g]) + "</graph>\n"
    return f'<?xml version="1.0" encoding="utf-8"?>\n<TriX xmlns="{TRIX}">\n{body}</TriX>\n'


def _xml_names(rows, prefixes) -> dict[str, str]:
    """Prefixes for the namespaces of all predicates and types."""
    known = {p: n for p, n in prefixes.items() if p}
    known["rdf"] = RDF
    for lex, predicate in dict.fromkeys((t.lex, t is p) for s, p, o, *_ in rows for t in ((p, o) if p == TYPE and o.k == IRI_KIND else (p,))):
        if shorten(lex, known) is None:
            cut = max(lex.rfind("#"), lex.rfind("/"), lex.rfind(":")) + 1
            while cut < len(lex) and not (lex[cut].isalpha() or lex[cut] == "_"):
                cut += 1
            if cut == len(lex):
                if predicate:
                    raise ValueError(f"{lex} can't be an XML name")
                continue
            known[f"ns{len(known)}"] = lex[:cut]
    return known


def _shortener(names: dict[str, str]) -> Callable[[str], str | None]:
    """Short names, each worked out once in a document."""
    return cache(lambda lex: shorten(lex, names))


def _xml_property(name: str, o: Term, inner: str | None = None) -> str:
    if inner is not None:
        return f"<{name}>{inner}</{name}>\n"
    if o.k == IRI_KIND:
        return f"<{name} rdf:resource={quoteattr(o.lex)}/>\n"
    if o.k == BNODE:
        return f'<{name} rdf:nodeID="{o.lex}"/>\n'
    if o.dt == RDF + "XMLLiteral":
        return f'<{name} rdf:parseType="Literal">{o.lex}</{name}>\n'
    kind = f" xml:lang={quoteattr(o.lang)}" if o.lang else f" rdf:datatype={quoteattr(o.dt)}" if o.dt else ""
    return f"<{name}{kind}>{escape(o.lex)}</{name}>\n"


def _xml_document(body: str, names) -> str:
    spaces = "".join(f"\n   xmlns:{p}={quoteattr(n)}" for p, n in sorted(names.items()))
    return f'<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF{spaces}\n>\n{body}</rdf:RDF>\n'


def rdfxml(rows, prefixes) -> str:
    names, by = _xml_names(rows, prefixes), _Tree(rows).by
    short = _shortener(names)
    body = ""
    for s in sorted(by):
        who = f"rdf:about={quoteattr(s.lex)}" if s.k == IRI_KIND else f'rdf:nodeID="{s.lex}"'
        body += f"<rdf:Description {who}>\n" + "".join(_xml_property(short(p.lex), o) for p in sorted(by[s]) for o in sorted(by[s][p])) + "</rdf:Description>\n"
    return _xml_document(body, names)


def rdfxml_nested(rows, prefixes, depth: int = 3, inline: bool = True) -> str:
    names, tree = _xml_names(rows, prefixes), _Tree(rows, inline)
    short = _shortener(names)
    held: set[Term] = set()

    def node(s: Term, level: int) -> str:
        d = tree.by[s]
        kind = next((o for o in sorted(d.get(TYPE, [])) if o.k == IRI_KIND and short(o.lex)), None)
        tag = short(kind.lex) if kind else "rdf:Description"
        who = f" rdf:about={quoteattr(s.lex)}" if s.k == IRI_KIND else "" if s in held else f' rdf:nodeID="{s.lex}"'
        body = ""
        for p in sorted(d):
            for o in sorted(d[p]):
                if p == TYPE and o == kind:
                    continue
                if o in tree.inline and level < depth:
                    held.add(o)
                    body += _xml_property(short(p.lex), o, node(o, level + 1))
                else:
                    body += _xml_property(short(p.lex), o)
        return f"<{tag}{who}>\n{body}</{tag}>\n"

    body = "".join(node(s, 1) for s in sorted(tree.heads()))
    while rest := sorted(n for n in tree.inline if n not in held):
        held_before = len(held)
        body += node(rest[0], depth)
        held.add(rest[0])
        if len(held) == held_before:
            break
    return _xml_document(body, names)


def jsonld(rows, prefixes, native: bool = True, inline: bool = True) -> str:
    by: dict[Term | None, list] = {}
    for q in rows:
        by.setdefault(q[3], []).append(q)
    name = lambda t: ("_:" if t.k == BNODE else "") + t.lex

    def nodes(quads) -> list:
        tree = _Tree(quads, inline)

        def value(o: Term):
            if o.k == LITERAL:
                if native and o.dt == XSD + "integer" and str(o.value()) == o.lex:
                    return {"@value": o.value()}
                if native and o.dt == XSD + "boolean" and o.lex in ("true", "false"):
                    return {"@value": o.lex == "true"}
                return {"@value": o.lex} | ({"@language": o.lang} if o.lang else {"@type": o.dt} if o.dt else {})
            items = tree.list_items(o) if o in tree.inline or o == NIL else None
            if items is not None:
                done.update(cells(o))
                return {"@list": [value(i) for i in items]}
            return {"@id": name(o)}

        def cells(o: Term):
            while o != NIL:
                yield o
                o = tree.by[o][REST][0]

        done: set[Term] = set()
        out = {}
        for s in sorted(tree.by):
            d = {"@id": name(s)}
            for p, os in sorted(tree.by[s].items()):
                if p == TYPE and all(o.k < LITERAL for o in os):
                    d["@type"] = [name(o) for o in sorted(os)]
                else:
                    d[p.lex] = [value(o) for o in sorted(os)]
            out[s] = d
        return [d for s, d in out.items() if s not in done]

    graph = nodes(by.pop(None, []))
    for g in sorted(by):
        graph.append({"@id": name(g), "@graph": nodes(by[g])})
    return json.dumps(graph, indent=2, ensure_ascii=False)


def dot(rows, prefixes) -> str:
    """A GraphViz drawing of the graph."""
    ids: dict[Term, str] = {}
    node = lambda t: ids.setdefault(t, f"n{len(ids)}")
    edges = "".join(f"  {node(s)} -> {node(o)} [label={json.dumps(p.n3(prefixes))}];\n" for s, p, o, *_ in rows)
    return "digraph {\n" + "".join(f"  {i} [label={json.dumps(t.n3(prefixes))}];\n" for t, i in ids.items()) + edges + "}\n"


TEXTS = {"turtle": turtle, "longturtle": long_turtle, "trig": trig, "n3": n3_document, "trix": trix, "rdfxml": rdfxml, "rdfxml-nested": rdfxml_nested, "jsonld": jsonld, "dot": dot}
#: Formats whose folders nest blank nodes, and those that name every one.
NESTED = ("n3", "rdfxml-nested")
PARTS = {f: partial(TEXTS[f], inline=False) for f in ("turtle", "longturtle", "trig", "jsonld")} | {f: TEXTS[f] for f in ("trix", "rdfxml")}
