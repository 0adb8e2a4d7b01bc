"""Algebra back to SPARQL text."""

from __future__ import annotations

from ..terms import Term, Var
from . import nodes as N

INFIX = {"||", "&&", "=", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/"}


class Writer:
    def __init__(self) -> None:
        self.named: dict[str, str] = {}  # hidden variables of aggregates and keys, as expressions

    def slot(self, t) -> str:
        if isinstance(t, Var):
            return self.named.get(t.name) or (t.name if t.name.startswith("_:") and t.name[2:].isalnum() else f"?{t.name.replace('_:', '_b_')}")
        return self.path(t) if isinstance(t, N.Path) else t.n3()

    def path(self, p: N.Path) -> str:
        match p:
            case N.Link(iri):
                return iri.n3()
            case N.Inv(q):
                return f"^({self.path(q)})"
            case N.Seq(parts):
                return "(" + "/".join(map(self.path, parts)) + ")"
            case N.Alt(parts):
                return "(" + "|".join(map(self.path, parts)) + ")"
            case N.Mul(q, m):
                return f"({self.path(q)}){m}"
            case N.Neg(forward, backward):
                return "!(" + "|".join([*(i.n3() for i in forward), *("^" + i.n3() for i in backward)]) + ")"
        raise TypeError(type(p))

    def expr(self, e) -> str:
        match e:
            case Var() | Term():
                return self.slot(e)
            case N.Exists(group, negated):
                return f"{'NOT ' if negated else ''}EXISTS {{ {self.group(group)} }}"
            case N.Aggregate(name, inner, distinct, separator):
                tail = f'; SEPARATOR={Term(3, separator).n3()}' if name == "GROUP_CONCAT" else ""
                return f"{name}({'DISTINCT ' if distinct else ''}{'*' if inner is None else self.expr(inner)}{tail})"
            case N.Call(name, args, distinct):
                texts = [self.expr(a) for a in args]
                if isinstance(name, Term):
                    return f"{name.n3()}({'DISTINCT ' if distinct else ''}{', '.join(texts)})"
                if name in INFIX:
                    return f"({texts[0]} {name} {texts[1]})"
                if name in ("!", "u-", "u+"):
                    return f"({name[-1]}{texts[0]})"
                if name in ("IN", "NOT IN"):
                    return f"({texts[0]} {name} ({', '.join(texts[1:])}))"
                return f"{name}({', '.join(texts)})"
        raise TypeError(type(e))

    def group(self, node) -> str:
        """The inside of a group graph pattern."""
        match node:
            case N.BGP(patterns):
                return " ".join(f"{self.slot(s)} {self.slot(p)} {self.slot(o)} ." for s, p, o in patterns)
            case N.Join(a, b):
                return f"{{ {self.group(a)} }} {{ {self.group(b)} }}"
            case N.LeftJoin(a, b, e):
                on = f" FILTER({self.expr(e)})" if e is not None else ""
                inner = self.group(b) if on else f"{{ {self.group(b)} }}"  # a filter inside stays inside
                return f"{{ {self.group(a)} }} OPTIONAL {{ {inner}{on} }}"
            case N.Union(a, b):
                return f"{{ {self.group(a)} }} UNION {{ {self.group(b)} }}"
            case N.Minus(a, b):
                return f"{{ {self.group(a)} }} MINUS {{ {self.group(b)} }}"
            case N.Filter(e, p):
                return f"{{ {self.group(p)} }} FILTER({self.expr(e)})"
            case N.Extend(p, var, e):
                return f"{{ {self.group(p)} }} BIND({self.expr(e)} AS {self.slot(Var(var))})"
            case N.Graph(t, p):
                return f"GRAPH {self.slot(t)} {{ {self.group(p)} }}"
            case N.Service(t, _, silent, text):
                return f"SERVICE {'SILENT ' if silent else ''}{self.slot(t)} {text}"
            case N.Values(names, rows):
                body = " ".join("(" + " ".join("UNDEF" if t is None else t.n3() for t in row) + ")" for row in rows)
                return f"VALUES ({' '.join(f'?{n}' for n in names)}) {{ {body} }}"
        return f"{{ {self.select(node)} }}"

    def select(self, node) -> str:
        """A SELECT of a node with solution modifiers."""
        modifier, tail = "", ""
        if isinstance(node, N.Slice):
            tail = (f" LIMIT {node.limit}" if node.limit is not None else "") + (f" OFFSET {node.offset}" if node.offset else "")
            node = node.p
        if isinstance(node, (N.Distinct, N.Reduced)):
            modifier, node = type(node).__name__.upper() + " ", node.p
        names, node = (node.names, node.p) if isinstance(node, N.Project) else (None, node)
        order = None
        if isinstance(node, N.OrderBy):
            order, node = node.conditions, node.p
        made: dict[str, object] = {}
        at = node
        while isinstance(at, N.Extend) and names is not None and at.var in names:
            made[at.var] = at.expr
            at = at.p
        having = []
        while isinstance(at, N.Filter) and _grouped(at):
            having.insert(0, at.expr)
            at = at.p
        keys = ""
        if isinstance(at, N.Group):
            node = at.p
            for name, e in at.keys:
                if name.startswith("_:"):
                    self.named[name] = self.expr(e)
            for name, e in at.aggregates:
                self.named[name] = self.expr(e)
            if not at.implicit:
                keys = " GROUP BY " + " ".join(f"({self.expr(e)})" if n.startswith("_:") else f"?{n}" if isinstance(e, Var) and e.name == n else f"({self.expr(e)} AS ?{n})" for n, e in at.keys)
        else:
            made, having = {}, []
        shown = " ".join(f"({self.expr(made[n])} AS ?{n})" if n in made else f"?{n}" for n in names) if names else "*"
        out = f"SELECT {modifier}{shown} WHERE {{ {self.group(node)} }}{keys}"
        if having:
            out += " HAVING " + " ".join(f"({self.expr(e)})" for e in having)
        if order:
            out += " ORDER BY " + " ".join(f"{'DESC' if d else 'ASC'}({self.expr(e)})" for e, d in order)
        return out + tail


def _grouped(node) -> bool:
    while isinstance(node, N.Filter):
        node = node.p
    return isinstance(node, N.Group)


def to_sparql(query: N.Query) -> str:
    """SPARQL text of a query; parsed again it gives the same solutions."""
    w = Writer()
    base = "".join(f"FROM {t.n3()} " for t in query.default_graphs) + "".join(f"FROM NAMED {t.n3()} " for t in query.named_graphs)
    body = w.select(query.p)
    if query.form == "SELECT":
        return body.replace(" WHERE ", f" {base}WHERE ", 1) if base else body
    inner = f"{base}WHERE {{ {{ {body} }} }}"
    if query.form == "ASK":
        return f"ASK {inner}"
    if query.form == "CONSTRUCT":
        return f"CONSTRUCT {{ {' '.join(' '.join(t.n3() for t in q) + ' .' for q in query.template)} }} {inner}"
    return f"DESCRIBE {' '.join(w.slot(t) for t in query.describe)} {inner}"
