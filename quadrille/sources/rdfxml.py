"""RDF/XML and TriX documents, from events of the standard library's parser."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from ..terms import RDF, BNode, IRI, Literal, Term, resolve
from .turtle import unused

XML = "http://www.w3.org/XML/1998/namespace"
XML_LITERAL = RDF + "XMLLiteral"
CORE = {RDF + n for n in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype")}
OLD = {RDF + n for n in ("aboutEach", "aboutEachPrefix", "bagID")}
NO_NODE = CORE | OLD | {RDF + "li"}
NO_PROPERTY = CORE | OLD | {RDF + "Description"}
TRIX = "http://www.w3.org/2004/03/trix/trix-1/"


class XmlSyntaxError(ValueError):
    pass


def _run(text: str, handler) -> None:
    """Events of a document; a name is its namespace and its local part with a space between, or the latter alone."""
    parser = expat.ParserCreate("utf-8", " ")
    parser.buffer_text = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_UNLESS_STANDALONE)
    parser.ExternalEntityRefHandler = lambda *_: 1  # passed over
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = handler.start, handler.end, handler.characters
    parser.StartNamespaceDeclHandler = handler.declare
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise XmlSyntaxError(str(e)) from e


def _parts(name: str) -> tuple[str | None, str]:
    space, _, local = name.rpartition(" ")
    return space or None, local


class Frame:
    """One open element: what it is, its base and language, and the node or predicate that it stands for."""

    node: Term | None = None
    predicate: Term | None = None
    subject: Term | None = None
    object: Term | None = None
    datatype: str | None = None
    reify: str | None = None
    items: list[Term] | None = None
    li = 0

    def __init__(self, kind: str, base: str, lang: str | None):
        self.kind, self.base, self.lang = kind, base, lang
        self.text: list[str] = []


class RdfXml:
    def __init__(self, base: str, scope: str, mark: str = "g", labels: str | None = None):
        self.base, self.scope, self.mark = base, scope, mark
        self.labels = scope if labels is None else labels
        self.out: list[tuple] = []
        self.stack: list[Frame] = []
        self.count = itertools.count()
        self.ids: set[str] = set()
        self.literal = 0  # depth inside parseType="Literal"
        self.spaces: list[dict] = [{}]
        self.pending: dict[str | None, str] = {}
        self.declared: list[set] = []

    def fresh(self) -> Term:
        return BNode(f"{self.scope}{self.mark}{next(self.count)}")

    def emit(self, s, p, o) -> None:
        self.out.append((s, p, o, None))

    def declare(self, prefix, uri):
        self.pending[prefix] = uri

    def resolve(self, base: str, text: str) -> Term:
        return IRI(text, base)

    def identity(self, base: str, name: str) -> Term:
        iri = self.resolve(base, "#" + name)
        if iri.lex in self.ids:
            raise XmlSyntaxError(f"rdf:ID {name} occurs twice")
        self.ids.add(iri.lex)
        return iri

    def start(self, name: str, attrs: dict[str, str]) -> None:
        spaces = self.spaces[-1]
        if self.pending:
            spaces, self.pending = {**spaces, **self.pending}, {}
        self.spaces.append(spaces)
        if self.literal:
            self.literal += 1
            self._copy_start(*_parts(name), {_parts(k): v for k, v in attrs.items()})
            return
        parent = self.stack[-1] if self.stack else None
        base, lang = (parent.base, parent.lang) if parent else (self.base, None)
        values = attrs
        if attrs:
            space, _ = _parts(name)
            values = {}
            for k, v in attrs.items():
                k = k.replace(" ", "", 1)
                if not k.startswith((XML, "xml")):
                    values[k] = v
                elif k == XML + "base":
                    base = resolve(base, v).split("#")[0]
                elif k == XML + "lang":
                    lang = v or None
            if space == RDF:
                for short in ("about", "ID", "resource", "parseType", "type"):  # attributes without a namespace, as of old
                    if short in values:
                        values[RDF + short] = values.pop(short)
            if not OLD.isdisjoint(values):
                raise XmlSyntaxError(f"{min(OLD & set(values))} is not allowed")
        iri = name.replace(" ", "", 1)
        if parent is None and iri == RDF + "RDF":
            self.stack.append(Frame("root", base, lang))
        elif parent is None or parent.kind in ("root", "property", "collection"):
            self._node(iri, values, base, lang, parent)
        else:
            self._property(iri, values, base, lang, parent)

    def _node(self, iri, values, base, lang, parent) -> None:
        if iri in NO_NODE:
            raise XmlSyntaxError(f"{iri} is no node")
        frame = Frame("node", base, lang)
        given = [k for k in ("about", "ID", "nodeID") if RDF + k in values] if values else []
        if len(given) > 1:
            raise XmlSyntaxError("a node has one name")
        if not given:
            frame.node = self.fresh()
        elif given[0] == "about":
            frame.node = self.resolve(base, values.pop(RDF + "about"))
        elif given[0] == "ID":
            frame.node = self.identity(base, self._name(values.pop(RDF + "ID")))
        else:
            frame.node = BNode(self.labels + self._name(values.pop(RDF + "nodeID")))
        if iri != RDF + "Description":
            self.emit(frame.node, IRI(RDF + "type"), IRI(iri))
        if values:
            self._attributes(frame.node, values, base, lang)
        if parent is not None and parent.kind == "property":
            if parent.object is not None:
                raise XmlSyntaxError("a property has one node")
            parent.object = frame.node
        elif parent is not None and parent.kind == "collection":
            parent.items.append(frame.node)
        self.stack.append(frame)

    @staticmethod
    def _name(text: str) -> str:
        if not text or not (text[0].isalpha() or text[0] == "_") or any(not (c.isalnum() or c in "._-") for c in text):
            raise XmlSyntaxError(f"{text!r} is no name")
        return text

    def _attributes(self, node: Term, values: dict, base: str, lang) -> None:
        for k, v in values.items():
            if k == RDF + "type":
                self.emit(node, IRI(k), self.resolve(base, v))
            elif k in CORE | OLD | {RDF + "li", RDF + "Description"}:
                raise XmlSyntaxError(f"{k} is no property")
            elif ":" in k:
                self.emit(node, IRI(k), Literal(v, lang))

    def _property(self, iri, values, base, lang, parent) -> None:
        if iri in NO_PROPERTY:
            raise XmlSyntaxError(f"{iri} is no property")
        if iri == RDF + "li":
            parent.li += 1
            iri = f"{RDF}_{parent.li}"
        frame = Frame("property", base, lang)
        frame.subject, frame.predicate = parent.node, IRI(iri)
        if not values:
            self.stack.append(frame)
            return
        frame.reify = values.pop(RDF + "ID", None)
        if frame.reify is not None:
            frame.reify = self.identity(base, self._name(frame.reify)).lex
        how = values.pop(RDF + "parseType", None)
        if how is not None and (RDF + "resource" in values or RDF + "datatype" in values or values):
            raise XmlSyntaxError("rdf:parseType stands alone")
        if how == "Resource":
            frame.object = self.fresh()
            self.stack.append(frame)
            self._finish(frame, frame.object)
            inner = Frame("node", base, lang)
            inner.node = frame.object
            frame.kind = "done"
            self.stack[-1] = inner
            return
        if how == "Collection":
            frame.kind, frame.items = "collection", []
        elif how is not None:
            frame.kind, frame.datatype = "literal", XML_LITERAL
            self.literal = 1
            self.declared = [set()]
        else:
            frame.datatype = values.pop(RDF + "datatype", None)
            if frame.datatype:
                frame.datatype = self.resolve(base, frame.datatype).lex
            resource, node_id = values.pop(RDF + "resource", None), values.pop(RDF + "nodeID", None)
            if resource is not None and node_id is not None:
                raise XmlSyntaxError("a property has one object")
            if resource is not None:
                frame.object = self.resolve(base, resource)
            elif node_id is not None:
                frame.object = BNode(self.labels + self._name(node_id))
            elif values:
                frame.object = self.fresh()
            if values:
                self._attributes(frame.object, values, base, lang)
        self.stack.append(frame)

    def characters(self, content):
        frame = self.stack[-1] if self.stack else None
        if self.literal:
            frame.text.append(escape(content))
        elif frame and frame.kind == "property":
            frame.text.append(content)
        elif not content.isspace():
            raise XmlSyntaxError(f"text {content.strip()[:20]!r} in a node")

    def _copy_start(self, space, local, attrs) -> None:
        known = self.spaces[-1]
        prefix = lambda ns: next((p for p, u in known.items() if u == ns and p), None)
        p = prefix(space) if space else None
        if space and p is None and known.get(None) != space:
            p = "ns0"
        seen = self.declared[-1]
        extra = {}
        if space and (p, space) not in seen:
            extra[f"xmlns:{p}" if p else "xmlns"] = space
        text = f"<{p + ':' if p else ''}{local}"
        for k, v in sorted(extra.items()):
            text += f" {k}={quoteattr(v)}"
        for (ns, n), v in attrs.items():
            q = prefix(ns) if ns else None
            text += f" {('xml:' if ns == XML else q + ':' if q else '') + n}={quoteattr(v)}"
        self.declared.append(seen | ({(p, space)} if space else set()))
        self.stack[-1].text.append(text + ">")

    def end(self, name: str) -> None:
        spaces = self.spaces.pop()
        if self.literal > 1:
            self.literal -= 1
            self.declared.pop()
            space, local = _parts(name)
            p = next((p for p, u in spaces.items() if u == space and p), None) if space else None
            self.stack[-1].text.append(f"</{p + ':' if p else ''}{local}>")
            return
        self.literal = 0
        frame = self.stack.pop()
        if frame.kind == "property":
            if frame.object is None:
                self._finish(frame, Literal("".join(frame.text), None if frame.datatype else frame.lang, frame.datatype))
            elif "".join(frame.text).strip():
                raise XmlSyntaxError("text beside a node")
            else:
                self._finish(frame, frame.object)
        elif frame.kind == "literal":
            self._finish(frame, Literal("".join(frame.text), datatype=XML_LITERAL))
        elif frame.kind == "collection":
            rest = IRI(RDF + "nil")
            for item in reversed(frame.items):
                node = self.fresh()
                self.emit(node, IRI(RDF + "first"), item)
                self.emit(node, IRI(RDF + "rest"), rest)
                rest = node
            self._finish(frame, rest)

    def _finish(self, frame: Frame, obj: Term) -> None:
        self.emit(frame.subject, frame.predicate, obj)
        if frame.reify is not None:
            s = IRI(frame.reify)
            for n, o in (("subject", frame.subject), ("predicate", frame.predicate), ("object", obj)):
                self.emit(s, IRI(RDF + n), o)
            self.emit(s, IRI(RDF + "type"), IRI(RDF + "Statement"))


def parse_rdfxml(text: str, base: str = "", scope: str = "", labels: str | None = None) -> Iterator[tuple]:
    handler = RdfXml(base, scope, unused("g", 'nodeID="', text.replace("'", '"')), labels)
    _run(text, handler)
    yield from handler.out


class Trix:
    def __init__(self, base: str, scope: str, labels: str | None = None):
        self.base, self.scope = base, scope
        self.labels = scope if labels is None else labels
        self.out: list[tuple] = []
        self.graph: Term | None = None
        self.terms: list[Term] | None = None
        self.text: list[str] = []
        self.attrs: dict = {}

    def declare(self, prefix, uri):
        pass

    def start(self, name: str, attrs: dict[str, str]) -> None:
        space, local = _parts(name)
        if space != TRIX:
            raise XmlSyntaxError(f"{local} is not of TriX")
        self.text, self.attrs = [], {_parts(k)[1]: v for k, v in attrs.items()}
        if local == "triple":
            self.terms = []
        elif local == "graph":
            self.graph = None
            asked = {k.replace(" ", "", 1): v for k, v in attrs.items()}
            if asked.get("asserted") == "false":
                self.graph = BNode(self.scope + "quoted")

    def characters(self, content):
        self.text.append(content)

    def end(self, name: str) -> None:
        text, local = "".join(self.text), _parts(name)[1]
        term = None
        if local == "uri":
            term = IRI(text.strip(), self.base or None)
        elif local == "id":
            term = BNode(self.labels + text.strip())
        elif local == "plainLiteral":
            term = Literal(text, self.attrs.get("lang"))
        elif local == "typedLiteral":
            term = Literal(text, datatype=self.attrs["datatype"])
        elif local == "triple":
            if len(self.terms) != 3:
                raise XmlSyntaxError("a triple has three terms")
            self.out.append((*self.terms, self.graph))
            self.terms = None
        if term is not None:
            if self.terms is not None:
                self.terms.append(term)
            else:
                self.graph = term


def parse_trix(text: str, base: str = "", scope: str = "", labels: str | None = None) -> Iterator[tuple]:
    handler = Trix(base, scope, labels)
    _run(text, handler)
    yield from handler.out
