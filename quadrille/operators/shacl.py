"""Property paths described in a graph, as shapes do, and back."""

from __future__ import annotations

from ..plans import nodes as N
from ..terms import BNODE, RDF, BNode, IRI, Term
from .collections import list_triples

SH = "http://www.w3.org/ns/shacl#"
MODIFIERS = {SH + "zeroOrMorePath": "*", SH + "oneOrMorePath": "+", SH + "zeroOrOnePath": "?"}


def parse_path(graph, node: Term) -> N.Path:
    """The path that a node of a graph describes."""
    if node.k != BNODE:
        if node.k != 2 or node.lex == RDF + "nil":
            raise ValueError(f"{node.n3()} is no path")
        return N.Link(node)
    described = {Term(*r.p).lex: Term(*r.o) for r in graph.predicate_objects(node).collect()}
    if RDF + "first" in described:
        parts = [parse_path(graph, t) for t in graph.items(node)]
        if len(parts) < 2:
            raise ValueError("a sequence has two steps or more")
        return N.Seq(tuple(parts))
    for iri, target in described.items():
        if iri == SH + "inversePath":
            return N.Inv(parse_path(graph, target))
        if iri == SH + "alternativePath":
            return N.Alt(tuple(parse_path(graph, t) for t in graph.items(target)))
        if iri in MODIFIERS:
            return N.Mul(parse_path(graph, target), MODIFIERS[iri])
    raise ValueError(f"{node.n3()} describes no path")


def build_path(path: N.Path) -> tuple[Term, list[tuple]]:
    """A node that describes the path, and the triples that do."""
    if isinstance(path, N.Link):
        return path.iri, []
    if isinstance(path, (N.Seq, N.Alt)):
        nodes, out = [], []
        for part in path.parts:
            node, more = build_path(part)
            nodes.append(node)
            out += more
        head, cells = list_triples(nodes)
        if isinstance(path, N.Seq):
            return head, out + cells
        node = BNode()
        return node, [*out, *cells, (node, IRI(SH + "alternativePath"), head)]
    if isinstance(path, N.Inv):
        inner, out, iri = *build_path(path.path), SH + "inversePath"
    elif isinstance(path, N.Mul):
        inner, out, iri = *build_path(path.path), next(i for i, m in MODIFIERS.items() if m == path.modifier)
    else:
        raise ValueError("a negated set has no description")
    node = BNode()
    return node, [*out, (node, IRI(iri), inner)]
