"""Random algebra over a small graph, against an evaluator written from the definitions of the W3C."""

import random
from collections import Counter

import pytest

from quadrille.graph import Dataset, Literal
from quadrille.plans import nodes as N
from quadrille.plans.compiler import compile_pattern
from quadrille.plans.syntax import visible
from quadrille.functions import values as V
from quadrille.sources.quads import QuadFrame
from quadrille.terms import IRI, Term, Var

E = "http://e/"
NODES = [IRI(E + n) for n in "abcde"]
LINKS = [IRI(E + n) for n in "pqr"]
VARS = [Var(n) for n in "xyzw"]


def triples(rng):
    return {(rng.choice(NODES), rng.choice(LINKS), rng.choice([*NODES, Literal(1), Literal(2), Literal("s")])) for _ in range(18)}


def tree(rng, depth):
    if depth == 0:
        return N.BGP([(rng.choice([*VARS[:3], *VARS[:3], rng.choice(NODES)]), rng.choice(LINKS), rng.choice([*VARS, *VARS, rng.choice(NODES)])) for _ in range(rng.randint(1, 2))])
    kind = rng.choice(["join", "union", "optional", "optional", "minus", "filter", "values", "exists", "path"])
    a = tree(rng, depth - 1)
    if kind == "filter":
        v, w = rng.sample(VARS, 2)
        return N.Filter(rng.choice([N.Call("BOUND", [v]), N.Call("!", [N.Call("BOUND", [w])]), N.Call("=", [v, w]), N.Call("!=", [v, w]), N.Call(">", [v, Literal(1)])]), a)
    if kind == "values":
        return N.Join(a, N.Values(["x", "y"], [tuple(rng.choice([None, *NODES]) for _ in "xy") for _ in range(3)]))
    if kind == "exists":
        return N.Filter(N.Exists(tree(rng, 0), rng.random() < 0.5), a)
    if kind == "path":
        return N.Join(a, N.BGP([(rng.choice(VARS), N.Mul(N.Link(rng.choice(LINKS)), rng.choice("+*?")), rng.choice([*VARS, *NODES]))]))
    b = tree(rng, depth - 1)
    return {"join": N.Join, "union": N.Union, "minus": N.Minus, "optional": N.LeftJoin}[kind](a, b)


def agree(m, n):
    return all(n[k] == v for k, v in m.items() if k in n)


def number(t):
    return t.value() if isinstance(t, Term) and t.dt and isinstance(t.value(), int) else None


def true(e, m):
    """The truth of a filter, None for an error."""
    if e.name == "BOUND":
        return e.args[0].name in m
    if e.name == "!":
        return not true(e.args[0], m)
    a, b = (m.get(x.name) if isinstance(x, Var) else x for x in e.args)
    if a is None or b is None:
        return None
    if e.name == ">":
        return None if number(a) is None or number(b) is None else number(a) > number(b)
    if a == b:
        same = True
    elif a.k < 3 or b.k < 3:
        same = False
    elif number(a) is not None and number(b) is not None:
        same = number(a) == number(b)
    elif (a.dt is None) == (b.dt is None):
        same = False
    else:
        return None
    return same if e.name == "=" else not same


def reached(graph, path, start):
    out, todo = set(), [start]
    while todo:
        for s, p, o in graph:
            if (s, p) == (todo[0], path) and o not in out:
                out.add(o)
                todo.append(o)
        todo.pop(0)
    return out


def match(pattern, graph):
    s, p, o = pattern
    if isinstance(p, N.Mul):
        link, ends = p.path.iri, {t for s, _, o in graph for t in (s, o)} | {t for t in (s, o) if isinstance(t, Term)}
        if p.modifier == "?":
            pairs = {(a, c) for a, b, c in graph if b == link}
        else:
            pairs = {(a, c) for a in ends for c in reached(graph, link, a)}
        if p.modifier in "*?":
            pairs |= {(t, t) for t in ({t for a, _, c in graph for t in (a, c)} | {t for t in (s, o) if isinstance(t, Term)})}
    else:
        pairs = {(a, c) for a, b, c in graph if b == p}
    for a, c in pairs:
        m = {}
        if all(t == v if isinstance(t, Term) else m.setdefault(t.name, v) == v for t, v in ((s, a), (o, c))):
            yield m


def evaluate(node, graph):
    match_ = lambda ms, ns: [{**m, **n} for m in ms for n in ns if agree(m, n)]
    if isinstance(node, N.BGP):
        out = [{}]
        for t in node.patterns:
            out = match_(out, list(match(t, graph)))
        return out
    if isinstance(node, N.Values):
        return [{n: t for n, t in zip(node.names, row) if t is not None} for row in node.rows]
    if isinstance(node, N.Filter):
        rows = evaluate(node.p, graph)
        if isinstance(node.expr, N.Exists):
            inner = evaluate(node.expr.group, graph)
            return [m for m in rows if any(agree(m, n) for n in inner) != node.expr.negated]
        return [m for m in rows if true(node.expr, m)]
    a, b = evaluate(node.left, graph), evaluate(node.right, graph)
    if isinstance(node, N.Join):
        return match_(a, b)
    if isinstance(node, N.Union):
        return a + b
    if isinstance(node, N.Minus):
        return [m for m in a if not any(agree(m, n) and m.keys() & n.keys() for n in b)]
    return [r for m in a for r in (match_([m], b) or [m])]


@pytest.mark.parametrize("seed", range(24))
def test_random_algebra(spark, seed):
    rng = random.Random(seed)
    graph, node = triples(rng), tree(rng, rng.randint(1, 3))
    plan = compile_pattern(spark, QuadFrame(Dataset.of(spark, graph).quads, single=True), node)
    names = sorted(visible(node))
    plan = plan.project(names)
    got = Counter(tuple(None if c is None else Term(*c) for c in r) for r in plan.df.select(*[V.term_of(plan.vars[n]).alias(n) for n in names]).collect())
    want = Counter(tuple(m.get(n) for n in names) for m in evaluate(node, graph))
    assert got == want, node
