"""The logical algebra: patterns, paths, operators and expressions as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from ..terms import Term, Var

# Paths


@dataclass(frozen=True)
class Path:
    """Base of property paths; ``/ | ~ -`` and ``*`` with a modifier build larger ones."""

    def __truediv__(self, other):
        return Seq((self, as_path(other)))

    def __or__(self, other):
        return Alt((self, as_path(other)))

    def __invert__(self):
        return Inv(self)

    def __mul__(self, modifier: str):
        return Mul(self, modifier)

    def __neg__(self):
        return negated([self])


@dataclass(frozen=True)
class Link(Path):
    iri: Term


@dataclass(frozen=True)
class Inv(Path):
    path: Path


@dataclass(frozen=True)
class Seq(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Alt(Path):
    parts: tuple[Path, ...]


@dataclass(frozen=True)
class Mul(Path):
    path: Path
    modifier: str  # * + ?


@dataclass(frozen=True)
class Neg(Path):
    forward: tuple[Term, ...]
    backward: tuple[Term, ...]


def as_path(x) -> Path:
    return x if isinstance(x, Path) else Link(x)


def negated(members: list[Path]) -> Neg:
    members = [m for x in members for m in (x.parts if isinstance(x, Alt) else (x,))]
    return Neg(tuple(m.iri for m in members if isinstance(m, Link)), tuple(m.path.iri for m in members if isinstance(m, Inv)))


# Operators


@dataclass
class BGP:
    patterns: list[tuple[Any, Any, Any]] = field(default_factory=list)


@dataclass
class Join:
    left: Any
    right: Any


@dataclass
class LeftJoin:
    left: Any
    right: Any
    expr: Any = None


@dataclass
class Union:
    left: Any
    right: Any


@dataclass
class Minus:
    left: Any
    right: Any


@dataclass
class Filter:
    expr: Any
    p: Any


@dataclass
class Extend:
    p: Any
    var: str
    expr: Any


@dataclass
class Graph:
    term: Term | Var
    p: Any


@dataclass
class Service:
    term: Term | Var
    p: Any
    silent: bool
    text: str


@dataclass
class Values:
    names: list[str]
    rows: list[tuple[Term | None, ...]]


@dataclass
class Group:
    p: Any
    keys: list[tuple[str, Any]]
    aggregates: list[tuple[str, Any]]
    implicit: bool = False


@dataclass
class OrderBy:
    p: Any
    conditions: list[tuple[Any, bool]]  # expression, descending


@dataclass
class Project:
    p: Any
    names: list[str]


@dataclass
class Distinct:
    p: Any


@dataclass
class Reduced:
    p: Any


@dataclass
class Slice:
    p: Any
    offset: int
    limit: int | None


@dataclass
class Query:
    form: str  # SELECT ASK CONSTRUCT DESCRIBE
    p: Any
    names: list[str]
    template: list[tuple] = field(default_factory=list)
    describe: list[Term | Var] = field(default_factory=list)
    default_graphs: list[Term] = field(default_factory=list)
    named_graphs: list[Term] = field(default_factory=list)
    base: str | None = None


# Expressions


@dataclass
class Call:
    """An operator or built-in by name, or a function by IRI (``name`` is then a Term)."""

    name: Any
    args: list[Any]
    distinct: bool = False


@dataclass
class Exists:
    group: Any  # algebra
    negated: bool


@dataclass
class Aggregate:
    name: str
    expr: Any  # None for COUNT(*)
    distinct: bool = False
    separator: str = " "


def transform(node, f):
    """Rebuild a tree bottom up, ``f`` applied to each dataclass in it."""
    if isinstance(node, (Term, Var)) or not (is_dataclass(node) or isinstance(node, (list, tuple))):
        return node
    if isinstance(node, (list, tuple)):
        return type(node)(transform(x, f) for x in node)
    return f(replace(node, **{x.name: transform(getattr(node, x.name), f) for x in fields(node)}))


def walk(node):
    """Every dataclass below and including ``node``."""
    if isinstance(node, (Term, Var)):
        return
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node):
        yield node
        for x in fields(node):
            yield from walk(getattr(node, x.name))


def pretty(node, depth: int = 0) -> str:
    """The algebra as indented text."""
    pad = "  " * depth
    if is_dataclass(node) and not isinstance(node, Path):
        inner = [x for x in fields(node) if is_dataclass(getattr(node, x.name)) and not isinstance(getattr(node, x.name), Path)]
        flat = ", ".join(f"{x.name}={getattr(node, x.name)!r}" for x in fields(node) if x not in inner)
        return "\n".join([f"{pad}{type(node).__name__}({flat})", *(pretty(getattr(node, x.name), depth + 1) for x in inner)])
    return f"{pad}{node!r}"
