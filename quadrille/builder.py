"""A small language for writing down a graph: subjects, values, and links that nest."""

from __future__ import annotations

from contextlib import contextmanager

from .graph import Graph, term
from .terms import RDF, BNode, IRI, Term


class Builder:
    """Collects triples about a current subject; ``graph(spark)`` makes them a graph."""

    def __init__(self, about: Term | str | None = None):
        self.triples: list[tuple] = []
        self.subjects = [self._node(about)]

    @staticmethod
    def _node(x) -> Term:
        return BNode() if x is None else IRI(x) if isinstance(x, str) else x

    def about(self, subject: Term | str | None) -> None:
        self.subjects[-1] = self._node(subject)

    def value(self, p: Term, o) -> None:
        if o is not None:
            self.triples.append((self.subjects[-1], p, term(o)))

    def rdftype(self, t: Term) -> None:
        self.value(IRI(RDF + "type"), t)

    @contextmanager
    def _inside(self, node: Term):
        self.subjects.append(node)
        try:
            yield node
        finally:
            self.subjects.pop()

    def rel(self, p: Term, o: Term | str | None = None):
        """Link to a node, which is the subject inside ``with``."""
        node = self._node(o)
        self.triples.append((self.subjects[-1], p, node))
        return self._inside(node)

    def rev(self, p: Term, s: Term | str | None = None):
        """Link from a node, which is the subject inside ``with``."""
        node = self._node(s)
        self.triples.append((node, p, self.subjects[-1]))
        return self._inside(node)

    def graph(self, spark) -> Graph:
        return Graph.of(spark, self.triples)
