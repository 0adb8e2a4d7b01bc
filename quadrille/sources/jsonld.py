"""JSON-LD 1.1 to quads: contexts are processed and nodes turned into quads in one walk. Remote contexts need a loader."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

from ..terms import RDF, XSD, BNode, IRI, Literal, Term, resolve
from .turtle import unused

KEYWORDS = {"@base", "@container", "@context", "@direction", "@graph", "@id", "@import", "@included", "@index", "@json", "@language", "@list", "@nest", "@none", "@prefix", "@propagate", "@protected", "@reverse", "@set", "@type", "@value", "@version", "@vocab"}


class JsonLdError(ValueError):
    pass


@dataclass(frozen=True)
class TermDef:
    iri: str | None
    reverse: bool = False
    type: str | None = None
    language: str | None = ""  # "" for none given
    container: frozenset[str] = frozenset()
    context: object = ...  # a scoped context; ... for none
    nest: str | None = None
    prefix: bool = False
    index: str | None = None


@dataclass(frozen=True)
class Context:
    base: str | None = None
    vocab: str | None = None
    language: str | None = None
    terms: dict[str, TermDef | None] = field(default_factory=dict)
    previous: Context | None = None  # to which nodes without this context's types go back
    loader: Callable[[str], object] | None = None  # of remote contexts; None refuses them
    source: str | None = None  # the remote context that is being read
    chain: list[str] = field(default_factory=list)  # and those that led to it

    def fetched(self, iri: str) -> tuple[object, str]:
        """The context of a remote document, and where it is."""
        if self.loader is None:
            raise JsonLdError(f"remote context {iri} is refused")
        at = resolve(self.source or self.base, iri)
        doc = self.loader(at)
        if not isinstance(doc, dict) or "@context" not in doc:
            raise JsonLdError(f"{at} has no context")
        return doc["@context"], at

    def remote(self, iri: str) -> Context:
        """With a remote context; its own references are relative to it, and it may go on to others up to a bound."""
        given, at = self.fetched(iri)
        chain = [*self.chain, at]
        if at in self.chain or len(chain) > 16:
            raise JsonLdError(f"remote contexts go round: {' '.join(chain)}")
        out = replace(self, source=at, chain=chain).extend(given)
        return replace(out, source=self.source, chain=self.chain)

    def extend(self, given, propagate: bool = True) -> Context:
        out = self
        for c in given if isinstance(given, list) else [given]:
            if c is None:
                out = Context(base=self.base, loader=self.loader)
                continue
            if isinstance(c, str):
                out = out.remote(c)
                continue
            if not isinstance(c, dict):
                raise JsonLdError("a context is an object")
            if "@import" in c:
                given_by, at = self.fetched(c["@import"])
                if not isinstance(given_by, dict) or "@import" in given_by:
                    raise JsonLdError(f"{at} is no context to import")
                c = {**given_by, **{k: v for k, v in c.items() if k != "@import"}}
            if c.get("@propagate", propagate) is False and out.previous is None:
                out = replace(out, previous=self)
            if "@base" in c:
                out = replace(out, base=None if c["@base"] is None else resolve(out.base, c["@base"]))
            if "@vocab" in c:
                v = c["@vocab"]
                out = replace(out, vocab=None if v is None else out.expand(v, vocab=True, relative=True))
            if "@language" in c:
                out = replace(out, language=c["@language"])
            terms = dict(out.terms)
            out = replace(out, terms=terms)
            done: dict[str, bool] = {}
            for name in c:
                if not name.startswith("@") or (name == "@type" and isinstance(c[name], dict)):
                    out._define(name, c, done)
        return out

    def _define(self, name: str, local: dict, done: dict[str, bool]) -> None:
        if name in done:
            if not done[name]:
                raise JsonLdError(f"{name} is defined by itself")
            return
        done[name] = False
        spec = local[name]
        self.terms.pop(name, None)
        if spec is None or (isinstance(spec, dict) and "@id" in spec and spec["@id"] is None):
            self.terms[name] = TermDef(None)
            done[name] = True
            return
        simple = isinstance(spec, str)
        d = {"@id": spec} if simple else spec
        if not isinstance(d, dict):
            raise JsonLdError(f"{name} has no definition")
        reverse = "@reverse" in d
        given = d["@reverse"] if reverse else d.get("@id")
        if given is not None and given != name:
            if given in local and given not in KEYWORDS:
                self._define(given, local, done)
            elif ":" in given and (p := given.split(":", 1)[0]) in local and p != name:
                self._define(p, local, done)
            iri = given if given in KEYWORDS else self.expand(given, vocab=True)
        elif ":" in name[1:]:
            p = name.split(":", 1)[0]
            if p in local:
                self._define(p, local, done)
            iri = self.expand(name, vocab=True)
        elif "/" in name:
            iri = self.expand(name, relative=True)
        elif name == "@type":
            iri = "@type"
        else:
            iri = self.vocab + name if self.vocab is not None else None
        kind = d.get("@type")
        if kind is not None and kind not in ("@id", "@vocab", "@json", "@none"):
            if kind in local:
                self._define(kind, local, done)
            elif ":" in kind and kind.split(":", 1)[0] in local:
                self._define(kind.split(":", 1)[0], local, done)
            kind = self.expand(kind, vocab=True)
        container = d.get("@container")
        container = frozenset([container] if isinstance(container, str) else container or ())
        prefix = d.get("@prefix", bool(simple and iri and iri[-1:] in ":/?#[]@"))
        self.terms[name] = TermDef(iri, reverse, kind, d.get("@language", ""), container, d.get("@context", ...), d.get("@nest"), prefix, d.get("@index"))
        done[name] = True

    def expand(self, value: str, vocab: bool = False, relative: bool = False) -> str | None:
        if value in KEYWORDS:
            return value
        if re.fullmatch(r"@[A-Za-z]+", value):
            return None
        if vocab and value in self.terms:
            return self.terms[value].iri
        if ":" in value[1:]:
            prefix, _, suffix = value.partition(":")
            if prefix == "_" or suffix.startswith("//"):
                return value
            d = self.terms.get(prefix)
            if d is not None and d.iri is not None:
                return d.iri + suffix
            return value
        if vocab and self.vocab is not None:
            return self.vocab + value
        if relative:
            return resolve(self.base, value)
        return value

    def term(self, name: str) -> TermDef:
        return self.terms.get(name) or TermDef(self.expand(name, vocab=True))


class Scripts(HTMLParser):
    """JSON-LD scripts of an HTML page."""

    def __init__(self) -> None:
        super().__init__()
        self.inside, self.found = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "script" and (dict(attrs).get("type") or "").split(";")[0] == "application/ld+json":
            self.inside = True
            self.found.append("")

    def handle_endtag(self, tag):
        if tag == "script":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


class Walker:
    def __init__(self, base: str, scope: str, mark: str = "j", labels: str | None = None):
        self.base, self.scope, self.mark = base, scope, mark
        self.labels = scope if labels is None else labels
        self.count = itertools.count()
        self.out: list[tuple] = []

    def fresh(self) -> Term:
        return BNode(f"{self.scope}{self.mark}{next(self.count)}")

    def name(self, iri: str | None) -> Term | None:
        """A node's name; None for what is neither an absolute IRI nor a blank node."""
        if iri is None:
            return None
        if iri.startswith("_:"):
            return BNode(self.labels + iri[2:])
        return IRI(iri) if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|^`\\]*$", iri) else None

    def emit(self, s, p, o, g) -> None:
        if None not in (s, p, o) and p.k == 2:
            self.out.append((s, p, o, g))

    def document(self, doc, context: Context) -> list[tuple]:
        for item in doc if isinstance(doc, list) else [doc]:
            if isinstance(item, dict):
                self.top(item, context)
        return self.out

    def top(self, item: dict, context: Context) -> None:
        inner = context.extend(item["@context"]) if "@context" in item else context
        keys = {inner.expand(k, vocab=True) for k in item}
        if keys <= {"@context", "@graph"}:
            for k, v in item.items():
                if inner.expand(k, vocab=True) == "@graph":
                    self.nodes(v, inner, None)
        else:
            self.node(item, context, None)

    def nodes(self, value, context: Context, graph) -> None:
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, dict):
                self.node(v, context, graph)

    def node(self, item: dict, context: Context, graph, name: Term | None = None, typed: str | None = None) -> Term | None:
        if context.previous is not None and not any(context.expand(k, vocab=True) in ("@value", "@id") and len(item) == 1 for k in item):
            context = replace(context.previous, base=context.base)
        if "@context" in item:
            context = context.extend(item["@context"])
        aliases = {k: context.expand(k, vocab=True) for k in item}
        by = {v: item[k] for k, v in aliases.items() if v in KEYWORDS}
        types = [t for k, v in aliases.items() if v == "@type" for t in (item[k] if isinstance(item[k], list) else [item[k]])]
        outer = context
        for t in sorted(t for t in types if isinstance(t, str)):
            d = outer.terms.get(t)
            if d is not None and d.context is not ...:
                context = context.extend(d.context, propagate=False)
        given = by.get("@id")
        if name is None:
            name = self.name(context.expand(given, relative=True)) if isinstance(given, str) else self.fresh()
            if isinstance(given, str) and name is None:
                return None
        for t in types + ([typed] if typed else []):
            self.emit(name, IRI(RDF + "type"), self.name(outer.expand(t, vocab=True, relative=True)), graph)
        self.properties(item, aliases, context, graph, name)
        return name

    def properties(self, item: dict, aliases: dict, context: Context, graph, name: Term) -> None:
        for key, value in item.items():
            iri = aliases[key]
            if iri == "@graph":
                self.nodes(value, context, name)
            elif iri == "@included":
                self.nodes(value, context, graph)
            elif iri == "@reverse":
                for k, vs in value.items():
                    self.values(context.term(k), k, vs, context, graph, name, True)
            elif iri == "@nest":
                for part in value if isinstance(value, list) else [value]:
                    self.properties(part, {k: context.expand(k, vocab=True) for k in part}, context, graph, name)
            elif iri is not None and iri not in KEYWORDS:
                d = context.term(key)
                self.values(d, key, value, context, graph, name, d.reverse)

    def values(self, d: TermDef, key: str, value, context: Context, graph, name: Term, reverse: bool) -> None:
        if d.context is not ...:
            context = context.extend(d.context)
        p = self.name(d.iri)
        for o in self.objects(d, value, context, graph):
            if o is not None:
                self.emit(*((o, p, name) if reverse else (name, p, o)), graph)

    def objects(self, d: TermDef, value, context: Context, graph) -> Iterator[Term | None]:
        box = d.container
        if d.type == "@json":
            yield Literal(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), datatype=RDF + "JSON")
        elif "@list" in box and not (isinstance(value, dict) and "@list" in value):
            yield self.list(value if isinstance(value, list) else [value], d, context, graph)
        elif isinstance(value, list):
            for v in value:
                yield from self.objects(d, v, context, graph)
        elif value is None:
            return
        elif isinstance(value, dict) and box & {"@language", "@index", "@id", "@type"} and not any(context.expand(k, vocab=True) in ("@value", "@list", "@set") for k in value):
            yield from self.mapped(d, value, context, graph)
        elif "@graph" in box and isinstance(value, dict):
            yield self.graph(value, context)
        else:
            yield from self.one(d, value, context, graph)

    def graph(self, value: dict, context: Context, name: Term | None = None) -> Term:
        aliases = {context.expand(k, vocab=True): k for k in value}
        if "@graph" in aliases:
            given = value.get(aliases.get("@id"))
            name = name or (self.name(context.expand(given, relative=True)) if given else self.fresh())
            self.nodes(value[aliases["@graph"]], context, name)
        else:
            name = name or self.fresh()
            self.node(value, context, name)
        return name

    def mapped(self, d: TermDef, value: dict, context: Context, graph) -> Iterator[Term | None]:
        plain = replace(d, container=frozenset())
        for key, vs in value.items():
            none = context.expand(key, vocab=True) == "@none"
            for v in vs if isinstance(vs, list) else [vs]:
                if v is None:
                    continue
                if "@language" in d.container:
                    yield Literal(v, None if none else key)
                elif "@graph" in d.container:
                    yield self.graph(v, context, None if none or "@id" not in d.container else self.name(context.expand(key, relative=True)))
                elif "@id" in d.container:
                    yield self.node(v, context, graph, None if none else self.name(context.expand(key, relative=True)))
                elif "@type" in d.container:
                    inner = context
                    t = context.terms.get(key)
                    if t is not None and t.context is not ...:
                        inner = context.extend(t.context)
                    if isinstance(v, str):
                        v = {"@id": v}
                    yield self.node(v, inner, graph, typed=None if none else key)
                elif d.index and isinstance(v, dict) and d.index != "@index":
                    o = self.node(v, context, graph)
                    self.emit(o, self.name(context.expand(d.index, vocab=True)), Literal(key), graph)
                    yield o
                else:
                    yield from self.one(plain, v, context, graph)

    def list(self, values: list, d: TermDef, context: Context, graph) -> Term:
        plain = replace(d, container=frozenset())
        items = []
        for v in values:
            if isinstance(v, list):
                items.append(self.list(v, plain, context, graph))
            else:
                items += [o for o in self.one(plain, v, context, graph) if o is not None]
        head = IRI(RDF + "nil")
        for o in reversed(items):
            node = self.fresh()
            self.emit(node, IRI(RDF + "first"), o, graph)
            self.emit(node, IRI(RDF + "rest"), head, graph)
            head = node
        return head

    def one(self, d: TermDef, value, context: Context, graph) -> Iterator[Term | None]:
        if isinstance(value, dict):
            if "@context" in value and "@value" not in value:
                inner = context.extend(value["@context"])
            else:
                inner = context
            aliases = {inner.expand(k, vocab=True): k for k in value}
            if "@value" in aliases:
                get = lambda k: value.get(aliases.get(k))
                yield self.literal(get("@value"), inner.expand(get("@type"), vocab=True) if get("@type") else None, get("@language"))
            elif "@list" in aliases:
                vs = value[aliases["@list"]]
                yield self.list(vs if isinstance(vs, list) else [vs], d, context, graph)
            elif "@set" in aliases:
                yield from self.objects(replace(d, container=frozenset()), value[aliases["@set"]], context, graph)
            else:
                yield self.node(value, context, graph)
        elif value is None:
            return
        elif d.type in ("@id", "@vocab") and isinstance(value, str):
            yield self.name(context.expand(value, vocab=d.type == "@vocab", relative=True))
        elif d.type not in (None, "@none", "@id", "@vocab"):
            yield self.literal(value, d.type, None)
        else:
            language = context.language if d.language == "" else d.language
            yield self.literal(value, None, language if isinstance(value, str) else None)

    @staticmethod
    def literal(value, dt: str | None, language: str | None) -> Term | None:
        if dt == "@json":
            return Literal(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), datatype=RDF + "JSON")
        if value is None:
            return None
        if isinstance(value, bool):
            return Literal(str(value).lower(), datatype=dt or XSD + "boolean")
        if isinstance(value, (int, float)):
            if isinstance(value, float) and (not value.is_integer() or abs(value) >= 1e21) or dt == XSD + "double":
                mantissa, _, exponent = f"{float(value):.15E}".partition("E")
                mantissa = mantissa.rstrip("0")
                return Literal(f"{mantissa + '0' if mantissa.endswith('.') else mantissa}E{int(exponent)}", datatype=dt or XSD + "double")
            return Literal(str(int(value)), datatype=dt or XSD + "integer")
        if language:
            return Literal(value, language)
        return Literal(value, datatype=dt)


def parse_jsonld(text: str, base: str = "", scope: str = "", loader: Callable[[str], object] | None = None, labels: str | None = None) -> Iterator[tuple]:
    """Quads of a JSON-LD document, or of the JSON-LD scripts of an HTML page."""
    if text.lstrip().startswith("<"):
        page = Scripts()
        page.feed(text)
        docs = [json.loads(t) for t in page.found]
    else:
        docs = [json.loads(text)]
    walker = Walker(base, scope, unused("j", "_:", text), labels)
    for doc in docs:
        walker.document(doc, Context(base=base or None, loader=loader))
    yield from walker.out
