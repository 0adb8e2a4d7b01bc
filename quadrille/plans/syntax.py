"""SPARQL 1.1 Query and Update: tokens, recursive descent, and translation to the algebra."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from typing import Any

from ..terms import RDF, XSD, BNode, IRI, Literal, Term, Var, unescape
from . import nodes as N


class SparqlSyntaxError(ValueError):
    pass


PN_BASE = "A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
PN_U = PN_BASE + "_"
PN = PN_U + r"\-0-9·̀-ͯ‿-⁀"
PREFIX = rf"(?:[{PN_BASE}](?:[{PN}.]*[{PN}])?)?"
PLX = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
LOCAL_NAME = rf"(?:[{PN_U}:0-9]|{PLX})(?:(?:[{PN}.:]|{PLX})*(?:[{PN}:]|{PLX}))?"
TOKENS = [
    ("skip", r"(?:[ \t\r\n]+|#[^\r\n]*)+"),
    ("iri", r"<[^<>\"{}|^`\\\x00-\x20]*>"),
    ("string", r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""' + r"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''" + r'|"(?:[^"\\\r\n]|\\.)*"' + r"|'(?:[^'\\\r\n]|\\.)*'"),
    ("bnode", rf"_:[{PN_U}0-9](?:[{PN}.]*[{PN}])?"),
    ("pname", rf"{PREFIX}:(?:{LOCAL_NAME})?"),
    ("var", rf"[?$][{PN_U}0-9][{PN_U}0-9·̀-ͯ‿-⁀]*"),
    ("lang", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
    ("double", r"(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+"),
    ("decimal", r"[0-9]*\.[0-9]+"),
    ("integer", r"[0-9]+"),
    ("word", r"[A-Za-z_][A-Za-z_0-9]*"),
    ("op", r"\^\^|\|\||&&|!=|<=|>=|[{}()\[\].;,=<>!|/^*?+\-]"),
]
SCAN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in TOKENS), re.S)

AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
#: Built-in functions and the numbers of arguments they take.
BUILTINS = {
    "STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "IRI": (1, 1), "URI": (1, 1), "BNODE": (0, 1), "RAND": (0, 0), "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 1),
    "CONCAT": (0, 99), "STRLEN": (1, 1), "UCASE": (1, 1), "LCASE": (1, 1), "ENCODE_FOR_URI": (1, 1), "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "STRBEFORE": (2, 2), "STRAFTER": (2, 2),
    "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "HOURS": (1, 1), "MINUTES": (1, 1), "SECONDS": (1, 1), "TIMEZONE": (1, 1), "TZ": (1, 1), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0),
    "MD5": (1, 1), "SHA1": (1, 1), "SHA256": (1, 1), "SHA384": (1, 1), "SHA512": (1, 1), "COALESCE": (0, 99), "IF": (3, 3), "STRLANG": (2, 2), "STRDT": (2, 2), "SAMETERM": (2, 2),
    "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "ISNUMERIC": (1, 1), "REGEX": (2, 3), "SUBSTR": (2, 3), "REPLACE": (3, 4),
}


def tokenize(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = SCAN.match(text, at)
        if not m:
            raise SparqlSyntaxError(f"unexpected {text[at:at + 20]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    out.append(("end", "", at))
    return out


@dataclass
class Operation:
    """One update operation; what each field holds depends on the name."""

    name: str
    silent: bool = False
    source: Any = None
    target: Any = None
    delete: list[tuple] = field(default_factory=list)
    insert: list[tuple] = field(default_factory=list)
    where: Any = None
    with_graph: Term | None = None
    using: list[Term] = field(default_factory=list)
    using_named: list[Term] = field(default_factory=list)


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str | None = None):
        text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)
        self.text, self.tokens, self.at = text, tokenize(text), 0
        self.prefixes, self.base = dict(prefixes or {}), base
        self.fresh = itertools.count()
        self.labels: set[str] = set()  # of the current pattern group
        self.used_labels: set[str] = set()  # of groups that ended
        self.template = False
        self.aggregates: list[N.Aggregate] | None = None

    # Tokens

    def peek(self, *values: str, kind: str | None = None, ahead: int = 0) -> bool:
        k, v, _ = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        if kind is not None:
            return k == kind
        return (k == "op" and v in values) or (k == "word" and v.upper() in values)

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, *values: str) -> str:
        if (v := self.take(*values)) is None:
            k, v, at = self.tokens[self.at]
            raise SparqlSyntaxError(f"expected {' or '.join(values)}, found {v or 'the end'!r} at {at}")
        return v

    def kind(self, kind: str) -> str | None:
        if self.tokens[self.at][0] == kind:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def fail(self, what: str):
        _, v, at = self.tokens[self.at]
        raise SparqlSyntaxError(f"expected {what}, found {v or 'the end'!r} at {at}")

    # Terms

    def iri(self) -> Term | None:
        if v := self.kind("iri"):
            return IRI(v[1:-1], self.base)
        if self.peek(kind="pname"):
            prefix, _, local = self.kind("pname").partition(":")
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        return None

    def need_iri(self) -> Term:
        return self.iri() or self.fail("an IRI")

    def var(self) -> Var | None:
        return Var(v[1:]) if (v := self.kind("var")) else None

    def string(self) -> str | None:
        if v := self.kind("string"):
            return unescape(v[3:-3] if v[:3] in ('"""', "'''") else v[1:-1])
        return None

    def literal(self) -> Term | None:
        text = self.string()
        if text is not None:
            if lang := self.kind("lang"):
                return Literal(text, lang[1:])
            return Literal(text, datatype=self.need_iri()) if self.take("^^") else Literal(text)
        sign = ""
        if self.peek("+", "-") and self.tokens[self.at + 1][0] in ("integer", "decimal", "double") and self.tokens[self.at][2] + 1 == self.tokens[self.at + 1][2]:
            sign = self.need("+", "-")
        for kind in ("integer", "decimal", "double"):
            if v := self.kind(kind):
                return Literal(sign + v, datatype=XSD + kind)
        if v := self.take("TRUE", "FALSE"):
            return Literal(v.lower(), datatype=XSD + "boolean")
        return None

    def bnode(self) -> Term | Var | None:
        if v := self.kind("bnode"):
            if v in self.used_labels:
                raise SparqlSyntaxError(f"{v} is used in two pattern groups")
            self.labels.add(v)
            return BNode(v[2:]) if self.template else Var(v)
        if self.peek("[") and self.peek("]", ahead=1):
            self.at += 2
            return self.new_bnode()
        return None

    def new_bnode(self):
        return BNode(f"g{next(self.fresh)}") if self.template else Var(f"_:g{next(self.fresh)}")

    def var_or_term(self):
        if self.peek("(") and self.peek(")", ahead=1):
            self.at += 2
            return IRI(RDF + "nil")
        return self.var() or self.iri() or self.literal() or self.bnode()

    # Prologue and forms

    def prologue(self) -> None:
        while True:
            if self.take("BASE"):
                self.base = IRI(self.kind("iri")[1:-1] if self.peek(kind="iri") else self.fail("an IRI"), self.base).lex
            elif self.take("PREFIX"):
                name = self.kind("pname") or self.fail("a prefix")
                if not name.endswith(":") or not self.peek(kind="iri"):
                    self.fail("a prefix and its IRI")
                self.prefixes[name[:-1]] = IRI(self.kind("iri")[1:-1], self.base).lex
            else:
                return

    def query(self) -> N.Query:
        self.prologue()
        form = self.need("SELECT", "CONSTRUCT", "DESCRIBE", "ASK")
        q = getattr(self, form.lower())()
        q.base = self.base
        if not self.peek(kind="end"):
            self.fail("the end")
        return q

    def datasets(self, q: N.Query) -> None:
        while self.take("FROM"):
            named = self.take("NAMED")
            (q.named_graphs if named else q.default_graphs).append(self.need_iri())

    def select_clause(self):
        modifier = self.take("DISTINCT", "REDUCED")
        if self.take("*"):
            return modifier, None
        items: list[tuple[str, Any]] = []
        outer, self.aggregates = self.aggregates, []
        while True:
            if v := self.var():
                items.append((v.name, None))
            elif self.take("("):
                expr = self.expression()
                self.need("AS")
                items.append(((self.var() or self.fail("a variable")).name, expr))
                self.need(")")
            else:
                break
        self.aggregates = outer
        if not items:
            self.fail("a variable, an expression or *")
        return modifier, items

    def select(self) -> N.Query:
        modifier, items = self.select_clause()
        q = N.Query("SELECT", None, [])
        self.datasets(q)
        self.take("WHERE")
        p = self.group()
        q.p, q.names = self.modifiers(p, modifier, items)
        return q

    def sub_select(self):
        modifier, items = self.select_clause()
        self.take("WHERE")
        p, _ = self.modifiers(self.group(), modifier, items)
        return p

    def ask(self) -> N.Query:
        q = N.Query("ASK", None, [])
        self.datasets(q)
        self.take("WHERE")
        q.p, q.names = self.modifiers(self.group(), None, None)
        return q

    def construct(self) -> N.Query:
        q = N.Query("CONSTRUCT", None, [])
        if self.peek("{"):
            q.template = self.triples_template()
            self.datasets(q)
            self.take("WHERE")
            p = self.group()
        else:
            self.datasets(q)
            self.need("WHERE")
            start = self.at
            q.template = self.triples_template()
            end, self.at = self.at, start
            p = self.group()
            if self.at != end or not isinstance(p, N.BGP):
                raise SparqlSyntaxError("CONSTRUCT WHERE takes triples only")
        q.p, q.names = self.modifiers(p, None, None)
        return q

    def describe(self) -> N.Query:
        q = N.Query("DESCRIBE", None, [])
        every = self.take("*")
        while not every and (t := self.var() or self.iri()):
            q.describe.append(t)
        self.datasets(q)
        p = self.group() if self.take("WHERE") or self.peek("{") else N.BGP()
        q.p, q.names = self.modifiers(p, None, None)
        if every:
            q.describe = [Var(n) for n in q.names]
        return q

    def triples_template(self) -> list[tuple]:
        self.template, self.labels = True, set()
        self.need("{")
        out = self.triples() if not self.peek("}") else []
        self.need("}")
        self.template = False
        return out

    # Solution modifiers

    def modifiers(self, p, modifier: str | None, items):
        keys: list[tuple[str, Any]] = []
        having: list[Any] = []
        order: list[tuple[Any, bool]] = []
        inner = visible(p)
        grouped = False
        if self.take("GROUP"):
            self.need("BY")
            grouped = True
            while True:
                if v := self.var():
                    keys.append((v.name, v))
                elif self.take("("):
                    expr = self.expression()
                    name = (self.var() or self.fail("a variable")).name if self.take("AS") else f"_:k{next(self.fresh)}"
                    keys.append((name, expr))
                    self.need(")")
                elif (expr := self.call_or_none()) is not None:
                    keys.append((f"_:k{next(self.fresh)}", expr))
                else:
                    break
            if not keys:
                self.fail("a grouping condition")
        if self.take("HAVING"):
            while (expr := self.constraint_or_none()) is not None:
                having.append(expr)
            if not having:
                self.fail("a condition")
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if way := self.take("ASC", "DESC"):
                    self.need("(")
                    order.append((self.expression(), way == "DESC"))
                    self.need(")")
                elif v := self.var():
                    order.append((v, False))
                elif (expr := self.constraint_or_none()) is not None:
                    order.append((expr, False))
                else:
                    break
            if not order:
                self.fail("an ordering condition")
        limit, offset = None, 0
        while way := self.take("LIMIT", "OFFSET"):
            n = int(self.kind("integer") or self.fail("a number"))
            limit, offset = (n, offset) if way == "LIMIT" else (limit, n)
        if self.take("VALUES"):
            p = N.Join(p, self.data_block())
            inner = visible(p)

        aggregates: list[tuple[str, N.Aggregate]] = []

        def lift(expr):
            def one(node):
                if isinstance(node, N.Aggregate):
                    for name, a in aggregates:
                        if a == node:
                            return Var(name)
                    aggregates.append((f"_:a{len(aggregates)}_{next(self.fresh)}", node))
                    return Var(aggregates[-1][0])
                return node

            return _replace_aggregates(expr, one)

        items = None if items is None else [(n, None if e is None else lift(e)) for n, e in items]
        having, order = [lift(e) for e in having], [(lift(e), d) for e, d in order]
        if aggregates or grouped:
            if items is None:
                raise SparqlSyntaxError("SELECT * with grouping")
            allowed = {n for n, _ in keys} | {n for n, _ in aggregates}
            named = set(allowed)
            for n, e in items:
                free = {n} if e is None else set(expression_vars(e))
                if free - named:
                    raise SparqlSyntaxError(f"?{min(free - named)} is neither grouped nor aggregated")
                named.add(n)
            p = N.Group(p, keys, aggregates, not grouped)
        for e in having:
            p = N.Filter(e, p)
        if items is None:
            names = sorted(n for n in inner if not n.startswith("_:"))
        else:
            names = [n for n, _ in items]
            if len(set(names)) != len(names) and any(e is not None for _, e in items):
                raise SparqlSyntaxError("a variable is selected twice")
            for n, e in items:
                if e is not None:
                    if n in visible(p):
                        raise SparqlSyntaxError(f"?{n} is bound already")
                    p = N.Extend(p, n, e)
            names = list(dict.fromkeys(names))
        if order:
            p = N.OrderBy(p, order)
        p = N.Project(p, names)
        if modifier:
            p = N.Distinct(p) if modifier == "DISTINCT" else N.Reduced(p)
        if limit is not None or offset:
            p = N.Slice(p, offset, limit)
        return p, names

    # Group graph patterns

    def group(self):
        self.need("{")
        if self.take("SELECT"):
            p = self.sub_select()
            self.need("}")
            return p
        p, filters, fresh = N.BGP(), [], True  # fresh: the next triples join the last block
        outer, self.labels = self.labels, set()
        while not self.take("}"):
            if self.take("FILTER"):
                filters.append(self.constraint_or_none() or self.fail("a condition"))
            elif self.take("OPTIONAL"):
                right = self.sub_group()
                p = N.LeftJoin(p, right.p, right.expr) if isinstance(right, N.Filter) else N.LeftJoin(p, right)
                fresh = False
            elif self.take("MINUS"):
                p, fresh = N.Minus(p, self.sub_group()), False
            elif self.take("BIND"):
                self.need("(")
                expr = self.expression()
                self.need("AS")
                name = (self.var() or self.fail("a variable")).name
                self.need(")")
                if name in visible(p):
                    raise SparqlSyntaxError(f"?{name} is bound already")
                p, fresh = N.Extend(p, name, expr), False
            elif self.take("VALUES"):
                p, fresh = _join(p, self.data_block()), False
            elif self.take("GRAPH"):
                term = self.var() or self.need_iri()
                p, fresh = _join(p, N.Graph(term, self.sub_group())), False
            elif self.take("SERVICE"):
                silent, term = bool(self.take("SILENT")), self.var() or self.need_iri()
                start = self.tokens[self.at][2]
                inner = self.sub_group()
                p, fresh = _join(p, N.Service(term, inner, silent, self.text[start : self.tokens[self.at - 1][2] + 1])), False
            elif self.peek("{"):
                inner = self.sub_group()
                while self.take("UNION"):
                    inner = N.Union(inner, self.sub_group())
                if isinstance(inner, N.Filter):  # its filter belongs to the inner braces
                    inner = N.Join(N.BGP(), inner)
                p, fresh = _join(p, inner), False
            else:
                if not fresh:
                    self.used_labels |= self.labels
                    self.labels = set()
                block = N.BGP(self.triples())
                if isinstance(p, N.BGP):
                    p = N.BGP(p.patterns + block.patterns)
                else:
                    p = _join(p, block)
                fresh = True
                continue
            self.take(".")
        self.used_labels |= self.labels
        self.labels = outer
        for i, f in enumerate(filters):
            p = N.Filter(f, p) if i == 0 else N.Filter(N.Call("&&", [p.expr, f]), p.p)
        return p

    def sub_group(self):
        self.used_labels |= self.labels
        self.labels = set()
        return self.group()

    def data_block(self) -> N.Values:
        if v := self.var():
            names, one = [v.name], True
        else:
            self.need("(")
            names, one = [], False
            while v := self.var():
                names.append(v.name)
            self.need(")")
        rows = []
        self.need("{")
        while not self.take("}"):
            if one:
                rows.append((self.data_value(),))
                continue
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(self.data_value())
            if len(row) != len(names):
                raise SparqlSyntaxError("a row of VALUES has another length than its variables")
            rows.append(tuple(row))
        return N.Values(names, rows)

    def data_value(self) -> Term | None:
        return None if self.take("UNDEF") else self.iri() or self.literal() or self.fail("a value")

    # Triples

    def triples(self) -> list[tuple]:
        out: list[tuple] = []
        while True:
            subject, alone = self.node(out)
            if subject is None:
                self.fail("a triple")
            if not (alone and (self.peek(".", "}") or self.at_group_part())):
                self.properties(subject, out)
            if not self.take("."):
                return out
            if self.peek("}") or self.at_group_part():
                return out

    def at_group_part(self) -> bool:
        return self.peek("{", "FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE")

    def node(self, out: list[tuple]):
        """A term, or a collection or bracketed bnode; the latter may stand alone."""
        if self.peek("(") and not self.peek(")", ahead=1):
            self.need("(")
            head = at = self.new_bnode()
            while True:
                item, _ = self.node(out)
                if item is None:
                    self.fail("an item")
                out.append((at, IRI(RDF + "first"), item))
                if self.take(")"):
                    out.append((at, IRI(RDF + "rest"), IRI(RDF + "nil")))
                    return head, True
                rest = self.new_bnode()
                out.append((at, IRI(RDF + "rest"), rest))
                at = rest
        if self.peek("[") and not self.peek("]", ahead=1):
            self.need("[")
            node = self.new_bnode()
            self.properties(node, out)
            self.need("]")
            return node, True
        return self.var_or_term(), False

    def properties(self, subject, out: list[tuple]) -> None:
        while True:
            verb = self.verb()
            while True:
                obj, _ = self.node(out)
                if obj is None:
                    self.fail("an object")
                out.append((subject, verb, obj))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek(".", "]", "}") or self.at_group_part():
                return

    def verb(self):
        if v := self.var():
            return v
        if self.template:
            return IRI(RDF + "type") if self.take_a() else self.need_iri()
        path = self.path()
        return path.iri if isinstance(path, N.Link) else path

    def take_a(self) -> bool:
        if self.tokens[self.at][:2] == ("word", "a"):
            self.at += 1
            return True
        return False

    # Paths

    def path(self) -> N.Path:
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else N.Alt(tuple(parts))

    def path_sequence(self) -> N.Path:
        parts = [self.path_step()]
        while self.take("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else N.Seq(tuple(parts))

    def path_step(self) -> N.Path:
        if self.take("^"):
            return N.Inv(self.path_step())
        if self.take("("):
            path = self.path()
            self.need(")")
        elif self.take("!"):
            members = []
            if self.take("("):
                while not self.take(")"):
                    if members:
                        self.need("|")
                    members.append(self.path_member())
            else:
                members.append(self.path_member())
            path = N.negated(members)
        else:
            path = N.Link(IRI(RDF + "type") if self.take_a() else self.need_iri())
        return N.Mul(path, m) if (m := self.take("*", "+", "?")) else path

    def path_member(self) -> N.Path:
        inverse = self.take("^")
        link = N.Link(IRI(RDF + "type") if self.take_a() else self.need_iri())
        return N.Inv(link) if inverse else link

    # Expressions

    def constraint_or_none(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        return self.call_or_none()

    def expression(self):
        e = self.conjunction()
        while self.take("||"):
            e = N.Call("||", [e, self.conjunction()])
        return e

    def conjunction(self):
        e = self.relation()
        while self.take("&&"):
            e = N.Call("&&", [e, self.relation()])
        return e

    def relation(self):
        e = self.sum()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            return N.Call(op, [e, self.sum()])
        if self.peek("IN") or (self.peek("NOT") and self.peek("IN", ahead=1)):
            negated = bool(self.take("NOT"))
            self.need("IN")
            return N.Call("NOT IN" if negated else "IN", [e, *self.arguments()])
        return e

    def arguments(self) -> list:
        self.need("(")
        args = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.expression())
        return args

    def sum(self):
        e = self.product()
        while True:
            # "?a -1": the sign belongs to the number's token, and still subtracts.
            if op := self.take("+", "-"):
                e = N.Call(op, [e, self.product()])
            else:
                return e

    def product(self):
        e = self.unary()
        while op := self.take("*", "/"):
            e = N.Call(op, [e, self.unary()])
        return e

    def unary(self):
        if self.take("!"):
            return N.Call("!", [self.unary()])
        if self.peek("+", "-"):
            number = self.literal()
            if number is not None:
                return number
            return N.Call("u" + self.need("+", "-"), [self.unary()])
        return self.primary()

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        e = self.call_or_none()
        if e is not None:
            return e
        return self.var() or self.literal() or self.fail("an expression")

    def call_or_none(self):
        if self.peek("EXISTS") or (self.peek("NOT") and self.peek("EXISTS", ahead=1)):
            negated = bool(self.take("NOT"))
            self.need("EXISTS")
            return N.Exists(self.sub_group(), negated)
        if self.peek(kind="word"):
            name = self.tokens[self.at][1].upper()
            if name in AGGREGATES:
                return self.aggregate()
            if name in BUILTINS:
                self.at += 1
                args = self.arguments()
                low, high = BUILTINS[name]
                if not low <= len(args) <= high:
                    self.fail(f"{low} to {high} arguments of {name}")
                if name == "BOUND" and not isinstance(args[0], Var):
                    self.fail("a variable in BOUND")
                return N.Call(name, args)
            return None
        iri = self.iri()
        if iri is None:
            return None
        if not self.peek("("):
            return iri
        self.need("(")
        distinct, args = bool(self.take("DISTINCT")), []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.expression())
        return N.Call(iri, args, distinct)

    def aggregate(self) -> N.Aggregate:
        name = self.need(*AGGREGATES)
        self.need("(")
        distinct = bool(self.take("DISTINCT"))
        expr = None if name == "COUNT" and self.take("*") else self.expression()
        if any(isinstance(n, N.Aggregate) for n in N.walk(expr)):
            raise SparqlSyntaxError("an aggregate within an aggregate")
        separator = " "
        if name == "GROUP_CONCAT" and self.take(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.string()
        self.need(")")
        return N.Aggregate(name, expr, distinct, separator)

    # Update

    def update(self) -> list[Operation]:
        out = []
        while True:
            self.prologue()
            if self.peek(kind="end"):
                return out
            self.used_labels = set()
            out.append(self.operation())
            if not self.take(";"):
                if not self.peek(kind="end"):
                    self.fail("; or the end")
                return out

    def graph_or_default(self):
        if self.take("DEFAULT"):
            return "DEFAULT"
        self.take("GRAPH")
        return self.need_iri()

    def operation(self) -> Operation:
        name = self.need("LOAD", "CLEAR", "DROP", "CREATE", "ADD", "MOVE", "COPY", "INSERT", "DELETE", "WITH")
        if name == "LOAD":
            op = Operation(name, bool(self.take("SILENT")), self.need_iri())
            if self.take("INTO"):
                self.need("GRAPH")
                op.target = self.need_iri()
            return op
        if name in ("CLEAR", "DROP"):
            silent = bool(self.take("SILENT"))
            which = self.take("DEFAULT", "NAMED", "ALL")
            if not which:
                self.need("GRAPH")
            return Operation(name, silent, target=which or self.need_iri())
        if name == "CREATE":
            silent = bool(self.take("SILENT"))
            self.need("GRAPH")
            return Operation(name, silent, target=self.need_iri())
        if name in ("ADD", "MOVE", "COPY"):
            op = Operation(name, bool(self.take("SILENT")), self.graph_or_default())
            self.need("TO")
            op.target = self.graph_or_default()
            return op
        if name == "INSERT" and self.take("DATA"):
            return Operation("INSERT DATA", insert=self.quads(data=True))
        if name == "DELETE" and self.take("DATA"):
            return Operation("DELETE DATA", delete=self.quads(data=True, bnodes=False))
        if name == "DELETE" and self.take("WHERE"):
            start = self.at
            op = Operation("MODIFY", delete=self.quads(bnodes=False))
            self.at = start
            op.where = self.quads_as_pattern()
            return op
        op = Operation("MODIFY")
        if name == "WITH":
            op.with_graph = self.need_iri()
            name = self.need("DELETE", "INSERT")
        if name == "DELETE":
            op.delete = self.quads(bnodes=False)
            name = self.take("INSERT")
        if name == "INSERT":
            op.insert = self.quads()
        while self.take("USING"):
            named = self.take("NAMED")
            (op.using_named if named else op.using).append(self.need_iri())
        self.need("WHERE")
        op.where = self.group()
        return op

    def quads(self, data: bool = False, bnodes: bool = True) -> list[tuple]:
        """(s, p, o, graph or None) of a quad template."""
        self.template, self.labels = True, set()
        out: list[tuple] = []
        self.need("{")
        while not self.take("}"):
            if self.take("GRAPH"):
                g = self.var() or self.need_iri()
                self.need("{")
                if not self.peek("}"):
                    out += [(*t, g) for t in self.triples()]
                self.need("}")
                self.take(".")
            else:
                out += [(*t, None) for t in self.triples()]
        self.template = False
        if data and any(isinstance(t, Var) for q in out for t in q):
            raise SparqlSyntaxError("a variable in data")
        if not bnodes and any(isinstance(t, Term) and t.k == 1 for q in out for t in q):
            raise SparqlSyntaxError("a blank node in what is deleted")
        return out

    def quads_as_pattern(self):
        p = N.BGP()
        for s, pr, o, g in self.quads():
            block = N.BGP([(s, pr, o)])
            if g is not None:
                p = _join(p, N.Graph(g, block))
            else:
                p = N.BGP(p.patterns + block.patterns) if isinstance(p, N.BGP) else _join(p, block)
        return p


def _join(left, right):
    if isinstance(left, N.BGP) and not left.patterns:
        return right
    if isinstance(right, N.BGP) and not right.patterns:
        return left
    return N.Join(left, right)


def _replace_aggregates(expr, f):
    if isinstance(expr, N.Aggregate):
        return f(expr)
    if isinstance(expr, N.Call):
        return N.Call(expr.name, [_replace_aggregates(a, f) for a in expr.args], expr.distinct)
    return expr


def expression_vars(expr) -> set[str]:
    """Variables that an expression itself reads, those inside EXISTS and aggregates left out."""
    if isinstance(expr, Var):
        return {expr.name}
    if isinstance(expr, N.Call):
        return set().union(*map(expression_vars, expr.args))
    return set()


def path_vars(pattern) -> set[str]:
    return {t.name for t in pattern if isinstance(t, Var)}


def visible(p) -> set[str]:
    """Variables that an operator's solutions may bind."""
    match p:
        case N.BGP(patterns):
            return set().union(*map(path_vars, patterns)) if patterns else set()
        case N.Join(a, b) | N.Union(a, b) | N.LeftJoin(a, b, _):
            return visible(a) | visible(b)
        case N.Minus(a, _):
            return visible(a)
        case N.Filter(_, q) | N.OrderBy(q, _) | N.Distinct(q) | N.Reduced(q) | N.Slice(q, _, _):
            return visible(q)
        case N.Extend(q, var, _):
            return visible(q) | {var}
        case N.Graph(t, q) | N.Service(t, q, _, _):
            return visible(q) | ({t.name} if isinstance(t, Var) else set())
        case N.Values(names, _):
            return set(names)
        case N.Group(_, keys, aggregates, _):
            return {n for n, _ in keys} | {n for n, _ in aggregates}
        case N.Project(_, names):
            return set(names)
    raise TypeError(type(p))


def parse_query(text: str, prefixes: dict[str, str] | None = None, base: str | None = None) -> N.Query:
    return Parser(text, prefixes, base).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None, base: str | None = None) -> list[Operation]:
    return Parser(text, prefixes, base).update()
