"""Lists and containers: the triples that make them, and their changes."""

from __future__ import annotations

from ..terms import RDF, BNode, IRI, Term

FIRST, REST, NIL = (IRI(RDF + n) for n in ("first", "rest", "nil"))


def list_triples(items: list[Term], head: Term | None = None) -> tuple[Term, list[tuple]]:
    """The head of an rdf:List of the items, and its triples."""
    if not items:
        return NIL, []
    cells = [head or BNode(), *(BNode() for _ in items[1:])]
    out = []
    for cell, item, rest in zip(cells, items, [*cells[1:], NIL]):
        out += [(cell, FIRST, item), (cell, REST, rest)]
    return cells[0], out


class Collection:
    """An rdf:List in a graph; each change gives a new collection in a new graph."""

    def __init__(self, graph, head: Term):
        self.graph, self.head = graph, head

    def items(self) -> list[Term]:
        return self.graph.items(self.head)

    def __len__(self) -> int:
        return len(self.items())

    def __getitem__(self, n: int) -> Term:
        return self.items()[n]

    def index(self, item: Term) -> int:
        return self.items().index(item)

    def _replaced(self, items: list[Term]) -> Collection:
        graph = self.clear().graph
        head, triples = list_triples(items, self.head if self.head != NIL else None)
        return Collection(graph.add(*triples) if triples else graph, head)

    def append(self, *items: Term) -> Collection:
        return self._replaced(self.items() + list(items))

    def set(self, n: int, item: Term) -> Collection:
        items = self.items()
        items[n] = item
        return self._replaced(items)

    def delete(self, n: int) -> Collection:
        items = self.items()
        del items[n]
        return self._replaced(items)

    def clear(self) -> Collection:
        """Without the cells of the list."""
        cells, at = [], self.head
        while at not in (None, NIL) and at not in cells:
            cells.append(at)
            at = self.graph.value(at, REST)
        graph = self.graph
        for p in (FIRST, REST):
            graph = graph.remove((cells, p, None)) if cells else graph
        return Collection(graph, NIL)


class Container:
    """A Bag, Seq or Alt: members numbered rdf:_1, rdf:_2, ..."""

    def __init__(self, graph, node: Term, kind: str = "Bag"):
        self.graph, self.node, self.kind = graph, node, kind

    @classmethod
    def of(cls, graph, node: Term, items: list[Term], kind: str = "Bag") -> Container:
        return cls(graph.add((node, IRI(RDF + "type"), IRI(RDF + kind))), node, kind).append(*items)

    def items(self) -> list[Term]:
        return self.graph.members(self.node)

    def __len__(self) -> int:
        return len(self.items())

    def index(self, item: Term) -> int:
        """Its number, from 1."""
        return self.items().index(item) + 1

    def append(self, *items: Term) -> Container:
        n = len(self)
        return Container(self.graph.add(*[(self.node, IRI(f"{RDF}_{n + i}"), t) for i, t in enumerate(items, 1)]) if items else self.graph, self.node, self.kind)

    def _renumbered(self, items: list[Term]) -> Container:
        old = [IRI(f"{RDF}_{i}") for i in range(1, len(self) + 1)]
        graph = self.graph.remove((self.node, old, None)) if old else self.graph
        return Container(graph, self.node, self.kind).append(*items)

    def insert(self, n: int, item: Term) -> Container:
        """At number ``n``; those behind move up."""
        items = self.items()
        return self._renumbered(items[: n - 1] + [item] + items[n - 1 :])

    def delete(self, n: int) -> Container:
        items = self.items()
        return self._renumbered(items[: n - 1] + items[n:])

    def clear(self) -> Container:
        return self._renumbered([])
