"""SPARQL Update: each operation makes a new snapshot of the quads, and leaves the old one as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import nodes as N
from ..plans.compiler import compile_pattern
from ..plans.plan import Plan
from ..plans.syntax import Operation
from ..session import materialize
from ..sources.quads import QuadFrame
from ..terms import Term, equal, lit, term_schema

SLOTS = ["s", "p", "o", "g"]


def _without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Quads that are not in ``gone``; a NULL graph equals a NULL graph."""
    same = F.lit(True)
    for c in SLOTS:
        same &= F.col(f"q.{c}").eqNullSafe(F.col(f"x.{c}"))
    return quads.alias("q").join(gone.alias("x"), same, "left_anti").select(*SLOTS)


def _in(name: Term | str | None) -> Column:
    """Whether a quad is in a graph, DEFAULT being the unnamed one."""
    g = F.col("g")
    return g.isNull() if name in (None, "DEFAULT") else F.coalesce(equal(g, name), F.lit(False))


def _graph(name: Term | str | None) -> Column:
    return lit(None if name in (None, "DEFAULT") else name)


def _ground(dataset, template: list[tuple], graph: Term | None = None) -> DataFrame:
    rows = [tuple(None if t is None else tuple(t) for t in (*q[:3], q[3] if q[3] is not None else graph)) for q in template]
    return dataset.spark.createDataFrame(rows, term_schema(*SLOTS)).distinct()


def run(dataset, op: Operation, bindings=None) -> QuadFrame:
    """The source after one operation."""
    old = dataset.source if isinstance(dataset.source, QuadFrame) else QuadFrame(dataset.quads, dataset.union)
    quads, known = old.quads, old.known

    def new(rows: DataFrame, graphs: DataFrame | None = known) -> QuadFrame:
        return QuadFrame(materialize(rows), old.union, graphs=graphs)

    def exists(name) -> bool:
        if name == "DEFAULT":
            return True
        return not quads.where(_in(name)).isEmpty() or (known is not None and not known.where(_in(name)).isEmpty())

    def with_name(name: Term) -> DataFrame:
        one = dataset.spark.createDataFrame([(tuple(name),)], term_schema("g"))
        return one if known is None else known.union(one).distinct()

    match op.name:
        case "LOAD":
            from ..sources.readers import read

            more = read(dataset.spark, op.source.lex.removeprefix("file://"))
            if op.target is not None:
                more = more.withColumn("g", lit(op.target))
            return new(quads.unionByName(more).distinct())
        case "CREATE":
            if exists(op.target):
                raise ValueError(f"graph {op.target.lex} exists")
            return new(quads, with_name(op.target))
        case "CLEAR" | "DROP":
            named = F.col("g").isNotNull()
            gone = {"ALL": F.lit(True), "NAMED": named, "DEFAULT": ~named}.get(op.target) if isinstance(op.target, str) else _in(op.target)
            if isinstance(op.target, Term) and not exists(op.target):
                raise ValueError(f"no graph {op.target.lex}")
            graphs = known
            if op.name == "DROP" and known is not None:
                graphs = known.where(~_in(op.target)) if isinstance(op.target, Term) else known if op.target == "DEFAULT" else None
            elif op.name == "CLEAR" and isinstance(op.target, Term):
                graphs = with_name(op.target)
            return new(quads.where(~gone), graphs)
        case "ADD" | "MOVE" | "COPY":
            if op.source == op.target:
                return old
            if not exists(op.source):
                raise ValueError(f"no graph {op.source.lex}")
            moved = quads.where(_in(op.source)).withColumn("g", _graph(op.target))
            kept = quads if op.name == "ADD" else quads.where(~_in(op.target))
            if op.name == "MOVE":
                kept = kept.where(~_in(op.source))
                if known is not None and isinstance(op.source, Term):
                    return new(kept.unionByName(moved).distinct(), known.where(~_in(op.source)))
            return new(kept.unionByName(moved).distinct())
        case "INSERT DATA":
            return new(quads.unionByName(_ground(dataset, op.insert)).distinct())
        case "DELETE DATA":
            return new(_without(quads, _ground(dataset, op.delete)))
        case "MODIFY":
            return new(_modify(dataset, old, op, bindings))
    raise ValueError(op.name)


def _modify(dataset, old: QuadFrame, op: Operation, bindings) -> DataFrame:
    """All deletions, then all insertions, of the solutions before either."""
    from ..graph import instantiate

    if op.using or op.using_named:
        source = old.scoped(op.using, op.using_named)
        if not op.using:
            source = QuadFrame(source.quads, union=False)
    elif op.with_graph is not None:
        g = F.col("g")
        own = old.quads.where(_in(op.with_graph)).withColumn("g", lit(None))
        source = QuadFrame(own.unionByName(old.quads.where(g.isNotNull())), union=False, graphs=old.known)
    else:
        source = old
    plan = compile_pattern(dataset.spark, source, op.where if op.where is not None else N.BGP(), dataset.base, bindings)
    plan = Plan(materialize(plan.df), plan.vars, plan.certain)
    place = lambda template: [(*q[:3], q[3] if q[3] is not None else op.with_graph) for q in template]
    quads = old.quads
    if op.delete:
        quads = _without(quads, instantiate(plan, place(op.delete)))
    if op.insert:
        quads = quads.unionByName(instantiate(plan, place(op.insert))).distinct()
    return quads

