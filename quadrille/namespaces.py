"""Namespaces, prefixes and the splitting of IRIs; all on the driver."""

from __future__ import annotations

import re
import string

from .terms import IRI, OWL, RDF, RDFS, XSD, Term, resolve, shorten

NAME = re.compile(r"[^\W\d][\w.\-]*$")


class Namespace(str):
    """A start of IRIs: ``ns.name`` and ``ns["name"]`` are IRIs in it."""

    def __getattr__(self, name: str) -> Term:
        if name.startswith("__"):
            raise AttributeError(name)
        return IRI(self + name)

    def __getitem__(self, name) -> Term:
        return IRI(self + name) if isinstance(name, str) else str.__getitem__(self, name)

    def __contains__(self, iri) -> bool:
        return (iri.lex if isinstance(iri, Term) else iri).startswith(self)


class ClosedNamespace(Namespace):
    """A namespace of known names; others are errors."""

    def __new__(cls, base: str, names):
        out = super().__new__(cls, base)
        out.__dict__["names"] = frozenset(names)
        return out

    def __getattr__(self, name: str) -> Term:
        if name not in self.__dict__.get("names", ()):
            raise AttributeError(f"{name} is not in {self}")
        return IRI(self + name)

    def __getitem__(self, name) -> Term:
        if name not in self.names:
            raise KeyError(name)
        return IRI(self + name)


class URIPattern(str):
    """A pattern of IRIs with {} or {name} places."""

    def format(self, *args, **kwargs) -> Term:
        return IRI(string.Formatter().vformat(self, args, kwargs))


def split_iri(iri: str) -> tuple[str, str]:
    """(namespace, local name), the local name being the longest that can be a name."""
    at = len(iri)
    while at > 0 and re.match(r"[\w.\-]", iri[at - 1]):
        at -= 1
    while at < len(iri) and not NAME.match(iri[at:]):
        at += 1
    if at == len(iri):
        raise ValueError(f"{iri} ends in no name")
    return iri[:at], iri[at:]


class Prefixes:
    """Prefixes and their namespaces, one to one."""

    def __init__(self, bindings: dict[str, str] | None = None):
        self.by: dict[str, str] = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, **(bindings or {})}

    def bind(self, prefix: str, namespace: str, override: bool = True, replace: bool = False) -> str:
        """Bind, and give the prefix that was used.

        A prefix of another namespace is taken over with ``replace``, and else numbered; a namespace that
        has a prefix gets the new one only with ``override``.
        """
        if " " in prefix:
            raise ValueError("a prefix has no blanks")
        old = next((p for p, n in self.by.items() if n == namespace), None)
        if self.by.get(prefix) not in (None, namespace):
            if replace:
                self.by.pop(old, None)
                self.by[prefix] = namespace
                return prefix
            n = 1
            while self.by.get(f"{prefix}{n}") not in (None, namespace):
                n += 1
            prefix = f"{prefix}{n}"
        if old is not None and not override:
            return old
        self.by.pop(old, None)
        self.by[prefix] = namespace
        return prefix

    def curie(self, iri: str, generate: bool = True) -> str:
        """prefix:local; a namespace without a prefix gets ns1, ns2, ... unless that is refused."""
        found = shorten(iri, self.by)
        if found is not None:
            return found
        if not generate:
            raise KeyError(iri)
        namespace, local = split_iri(iri)
        return f"{self.bind('ns1' if 'ns1' not in self.by else 'ns', namespace)}:{local}"

    def expand(self, curie: str) -> Term:
        prefix, colon, local = curie.partition(":")
        if not colon or prefix not in self.by:
            raise KeyError(curie)
        return IRI(self.by[prefix] + local)

    def normalize(self, term: Term) -> str:
        """The short form of an IRI where it has one, else its Turtle form."""
        return term.n3(self.by)

    def absolutize(self, iri: str, base: str, defrag: bool = True) -> Term:
        out = resolve(base, iri)
        return IRI(out.split("#")[0] if defrag else out)


def fragment(iri: Term) -> str:
    return iri.lex.partition("#")[2]


def defrag(iri: Term) -> Term:
    return IRI(iri.lex.partition("#")[0])
