"""Turtle, TriG and the parts of Notation3 that are plain graphs or formulae, one document at a time."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from ..plans.syntax import LOCAL_NAME, PN, PN_U, PREFIX
from ..terms import LITERAL, OWL, RDF, XSD, BNode, IRI, Literal, Term, resolve, unescape

SCAN = re.compile(
    "|".join(
        f"(?P<{n}>{p})"
        for n, p in [
            ("skip", r"(?:[ \t\r\n]+|#[^\r\n]*)+"),
            ("arrow", r"=>|<="),
            ("iri", r"<(?:[^<>\"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
            ("string", r'"""(?:"{0,2}(?:[^"\\]|\\[tbnrf"\'\\uU]))*"""' + r"|'''(?:'{0,2}(?:[^'\\]|\\[tbnrf\"'\\uU]))*'''" + r'|"(?:[^"\\\r\n]|\\[tbnrf"\'\\uU])*"' + r"|'(?:[^'\\\r\n]|\\[tbnrf\"'\\uU])*'"),
            ("bnode", rf"_:[{PN_U}0-9](?:[{PN}.]*[{PN}])?"),
            ("directive", r"@(?:prefix|base|forAll|forSome|keywords)\b"),
            ("lang", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
            ("double", r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+"),
            ("decimal", r"[+-]?[0-9]*\.[0-9]+"),
            ("integer", r"[+-]?[0-9]+"),
            ("pname", rf"{PREFIX}:(?:{LOCAL_NAME})?"),
            ("var", rf"\?[{PN_U}0-9]+"),
            ("word", r"[A-Za-z]+"),
            ("op", r"\^\^|[{}()\[\].;,=!^]"),
        ]
    ),
    re.S,
)


def unused(mark: str, before: str, text: str) -> str:
    """A start of labels that no label in the text has."""
    while before + mark in text:
        mark += mark[0]
    return mark


class TurtleSyntaxError(ValueError):
    pass


class TurtleParser:
    """Quads of a document. Blank nodes get ``scope``, so that documents keep theirs apart; ``labels``, if
    given, is what the labels in the text get instead."""

    def __init__(self, text: str, base: str = "", scope: str = "", form: str = "turtle", labels: str | None = None):
        self.text, self.base, self.scope, self.form = text, base, scope, form
        self.labels = scope if labels is None else labels
        self.prefixes: dict[str, str] = {"": "#"} if form == "n3" else {}
        self.count, self.mark = itertools.count(), unused("g", "_:", text)
        self.graph: Term | None = None
        self.out: list[tuple] = []
        self.at = 0
        self.next()

    def next(self) -> tuple[str, str]:
        old = getattr(self, "token", ("", ""))
        while True:
            if self.at >= len(self.text):
                self.token = ("end", "")
                return old
            m = SCAN.match(self.text, self.at)
            if not m:
                self.fail("a token")
            self.at = m.end()
            if m.lastgroup != "skip":
                self.token = (m.lastgroup, m[0])
                return old

    def fail(self, what: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise TurtleSyntaxError(f"expected {what} near {self.text[self.at:self.at + 20]!r}, line {line}")

    def op(self, value: str) -> bool:
        if self.token == ("op", value):
            self.next()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.op(value):
            self.fail(value)

    def word(self, *values: str) -> str | None:
        if self.token[0] == "word" and self.token[1].lower() in values:
            return self.next()[1].lower()
        return None

    def fresh(self) -> Term:
        return BNode(f"{self.scope}{self.mark}{next(self.count)}")

    def emit(self, s: Term, p: Term, o: Term) -> None:
        self.out.append((s, p, o, self.graph))

    def resolve(self, text: str) -> str:
        return resolve(self.base, unescape(text))

    def parse(self) -> Iterator[tuple]:
        while self.token[0] != "end":
            self.statement()
            yield from self.out
            self.out = []

    def statement(self) -> None:
        kind, value = self.token
        if kind == "directive":
            self.next()
            if value == "@prefix":
                self.prefix()
            elif value == "@base":
                self.base = self.iri_text()
            else:  # names of n3's quantifiers
                while not self.token == ("op", "."):
                    self.next()
            self.need(".")
        elif self.word("prefix"):
            self.prefix()
        elif self.word("base"):
            self.base = self.iri_text()
        elif self.form == "trig" and (self.token == ("op", "{") or self.word("graph")):
            self.block(None if self.token == ("op", "{") else self.label())
        else:
            subject, alone = self.subject()
            if self.form == "trig" and self.token == ("op", "{") and not (alone and self.out):
                self.block(subject)
                return
            self.triples(subject, alone)
            self.need(".")

    def label(self) -> Term:
        if self.token == ("op", "["):
            self.next()
            self.need("]")
            return self.fresh()
        return self.term() or self.fail("a graph's name")

    def block(self, name: Term | None) -> None:
        self.need("{")
        outer, self.graph = self.graph, name
        self.statements_until_brace()
        self.graph = outer

    def statements_until_brace(self) -> None:
        while not self.op("}"):
            self.triples(*self.subject())
            if not self.op("."):
                self.need("}")
                return

    def prefix(self) -> None:
        kind, name = self.next()
        if kind != "pname" or not name.endswith(":"):
            self.fail("a prefix")
        self.prefixes[name[:-1]] = self.iri_text()

    def iri_text(self) -> str:
        if self.token[0] != "iri":
            self.fail("an IRI")
        return self.resolve(self.next()[1][1:-1])

    def subject(self) -> tuple[Term, bool]:
        term, alone = self.node()
        if term is None or (term.k == LITERAL and self.form != "n3"):
            self.fail("a subject")
        return term, alone

    def triples(self, subject: Term, alone: bool) -> None:
        if not (alone and self.token in (("op", "."), ("op", "}"))):
            self.properties(subject)

    def properties(self, subject: Term) -> None:
        while True:
            verb, inverse = self.verb()
            while True:
                obj, _ = self.node()
                if obj is None:
                    self.fail("an object")
                self.emit(*((obj, verb, subject) if inverse else (subject, verb, obj)))
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.token in (("op", "."), ("op", "]"), ("op", "}")) or self.token[0] == "end":
                return

    def verb(self) -> tuple[Term, bool]:
        if self.token == ("word", "a"):
            self.next()
            return IRI(RDF + "type"), False
        if self.form == "n3":
            if self.op("="):
                return IRI(OWL + "sameAs"), False
            if self.token[0] == "arrow":
                return IRI("http://www.w3.org/2000/10/swap/log#implies"), self.next()[1] == "<="
            if self.word("has"):
                return self.verb()
            if self.word("is"):
                verb, _ = self.verb()
                self.word("of") or self.fail("of")
                return verb, True
        term = self.term()
        if term is None or (term.k != 2 and self.form != "n3"):
            self.fail("a predicate")
        return term, False

    def node(self) -> tuple[Term | None, bool]:
        """A term; whether it was a bracketed form, which may stand alone."""
        if self.op("["):
            node = self.fresh()
            if self.op("]"):
                return node, False
            self.properties(node)
            self.need("]")
            return self.path(node), True
        if self.op("("):
            items = []
            while not self.op(")"):
                item, _ = self.node()
                items.append(item or self.fail("an item"))
            head = rest = IRI(RDF + "nil")
            for item in reversed(items):
                head = self.fresh()
                self.emit(head, IRI(RDF + "first"), item)
                self.emit(head, IRI(RDF + "rest"), rest)
                rest = head
            return self.path(head), bool(items)
        if self.form == "n3" and self.op("{"):
            node = self.fresh()
            outer, self.graph = self.graph, node
            self.statements_until_brace()
            self.graph = outer
            return node, True
        term = self.term()
        return (self.path(term) if term else None), False

    def path(self, node: Term) -> Term:
        """n3's forward and backward path steps."""
        while self.form == "n3" and self.token in (("op", "!"), ("op", "^")):
            back = self.next()[1] == "^"
            verb, other = self.term(), self.fresh()
            self.emit(*((other, verb, node) if back else (node, verb, other)))
            node = other
        return node

    def term(self) -> Term | None:
        kind, value = self.token
        if kind == "iri":
            return IRI(self.iri_text())
        if kind == "pname":
            self.next()
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleSyntaxError(f"unknown prefix {prefix!r}")
            space = self.prefixes[prefix]
            return IRI((resolve(self.base, space) if space.startswith("#") else space) + re.sub(r"\\(.)", r"\1", local))
        if kind == "bnode":
            self.next()
            return BNode(self.labels + value[2:])
        if kind == "var" and self.form == "n3":
            self.next()
            return BNode(f"{self.scope}var_{value[1:]}")
        if kind == "string":
            self.next()
            text = unescape(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.token[0] == "lang":
                return Literal(text, self.next()[1][1:])
            if self.op("^^"):
                return Literal(text, datatype=self.term() or self.fail("a datatype"))
            return Literal(text)
        if kind in ("integer", "decimal", "double"):
            self.next()
            return Literal(value, datatype=XSD + kind)
        if kind == "word" and value in ("true", "false"):
            self.next()
            return Literal(value, datatype=XSD + "boolean")
        return None
