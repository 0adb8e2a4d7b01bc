"""Property paths as plans of start and end; closures as rounds of joins that double what they reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans import nodes as N
from ..plans import plan as P
from ..plans.plan import Plan, fresh
from ..session import materialize
from ..terms import Term, Var


def expand(s, path, o) -> list[tuple] | None:
    """The path as plain triple patterns, where it is one; sequences get fresh variables."""
    if isinstance(path, Term):
        return [(s, path, o)]
    if isinstance(path, N.Link):
        return [(s, path.iri, o)]
    if isinstance(path, N.Inv):
        return expand(o, path.path, s)
    if isinstance(path, N.Seq):
        ends = [s, *(Var("_:" + fresh("p")) for _ in path.parts[1:]), o]
        steps = [expand(a, part, b) or [(a, part, b)] for a, part, b in zip(ends, path.parts, ends[1:])]
        return [x for step in steps for x in step]
    return None


def path_plan(source, s, path, o, graph) -> Plan:
    """Solutions of one pattern whose predicate is not a plain sequence."""
    if isinstance(path, N.Inv):
        return path_plan(source, o, path.path, s, graph)
    if isinstance(path, N.Alt):
        return reduce(P.union, [pattern_plan(source, s, part, o, graph) for part in path.parts])
    if isinstance(path, N.Neg):
        parts = []
        if path.forward or not path.backward:
            parts.append(_other_links(source, s, path.forward, o, graph))
        if path.backward:
            parts.append(_other_links(source, o, path.backward, s, graph))
        return reduce(P.union, parts)
    if isinstance(path, N.Mul):
        return closure(source, s, path, o, graph)
    raise TypeError(type(path))


def pattern_plan(source, s, path, o, graph) -> Plan:
    """Solutions of any pattern."""
    patterns = expand(s, path, o)
    if patterns is None:
        return path_plan(source, s, path, o, graph)
    simple = [p for p in patterns if isinstance(p[1], (Term, Var))]
    plans = [source.match(simple, graph)] if simple else []
    plans += [path_plan(source, *p, graph) for p in patterns if not isinstance(p[1], (Term, Var))]
    kept = {t.name for t in (s, o, graph) if isinstance(t, Var)}
    return reduce(P.join, plans).project(sorted(kept))


def _other_links(source, s, excluded, o, graph) -> Plan:
    p = Var("_:" + fresh("p"))
    plan = source.match([(s, p, o)], graph)
    term = V.term_of(plan.vars[p.name])
    for iri in excluded:
        plan = plan.where(term["lex"] != iri.lex)
    return plan.project([n for n in plan.vars if n != p.name])


def closure(source, s, path: N.Mul, o, graph) -> Plan:
    """``p*``, ``p+`` and ``p?``: pairs, once each, from the end that is given, if one is."""
    a, b = Var("_:" + fresh("a")), Var("_:" + fresh("b"))
    g = [graph.name] if isinstance(graph, Var) else []
    steps = pattern_plan(source, a, path.path, b, graph).project([a.name, b.name, *g])
    ends = [steps.vars[n] for n in (a.name, b.name)]
    native = path.modifier == "+" and isinstance(s, Var) and isinstance(o, Var) and ends[0].kind == "iri" and ends[0].same_form(ends[1])
    if native:  # nodes of one table are told by their keys alone, if these are of one type
        native = len({t for _, t in steps.df.select(ends[0].col.alias("a"), ends[1].col.alias("b")).dtypes}) == 1
    steps = steps.as_terms(g if native else [a.name, b.name, *g])
    cols = [steps.vars[n].col for n in (a.name, b.name, *g)]
    edges = steps.df.select(*[c.alias(n) for c, n in zip(cols, ("a", "b", "g"))]).distinct()
    backward = isinstance(s, Var) and isinstance(o, Term)
    if backward:
        edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *edges.columns[2:])
        s, o = o, s
    keys = edges.columns
    pairs = _pairs(source, s, path.modifier, edges, graph, o)
    names = {x: fresh(x) for x in keys}
    df = pairs.select(*[F.col(x).alias(names[x]) for x in keys])
    val = {x: V.Val("term", F.col(names[x])) for x in keys}
    if native:
        val |= {x: end.named(names[x]) for x, end in zip("ab", ends)}
    plan = Plan(df)
    for term, x in ((s, "a"), (o, "b"), *(((graph, "g"),) if g else ())):
        if isinstance(term, Term):
            plan = plan.where(V.equal_terms(val[x], V.constant(term)))
        elif term.name in plan.vars:
            plan = plan.where(plan.vars[term.name].col == val[x].col)
        else:
            plan = Plan(plan.df, {**plan.vars, term.name: val[x]}, plan.certain | {term.name})
    return plan


def _pairs(source, s, modifier: str, edges: DataFrame, graph, o) -> DataFrame:
    g = edges.columns[2:]
    if isinstance(s, Term):
        if g:  # the start in every graph
            named = source.graphs(graph.name).as_terms([graph.name])
            seeds = named.df.select(V.lit(s).alias("a"), named.vars[graph.name].col.alias("g"))
        else:
            seeds = edges.sparkSession.range(1).select(V.lit(s).alias("a"))
        first = edges.where((F.col("a") == V.lit(s)))
    else:
        seeds, first = None, edges
        if modifier in "*?":
            nodes = source.nodes("n", graph)
            nodes = nodes.as_terms(list(nodes.vars))
            seeds = nodes.df.select(nodes.vars["n"].col.alias("a"), *[nodes.vars[graph.name].col.alias("g") for _ in g])
            if isinstance(o, Term) and not g:
                seeds = seeds.union(seeds.sparkSession.range(1).select(V.lit(o).alias("a")))
    found = first.distinct() if modifier == "?" else all_pairs(edges) if first is edges else reach(first, edges)
    if modifier in "*?":
        same = seeds.select("a", F.col("a").alias("b"), *g)
        found = found.union(same).distinct()
    return found


#: Rounds of one step before runs of single links are skipped.
PLAIN_ROUNDS = 8


def _steps(edges: DataFrame) -> DataFrame:
    """The links under names that pairs don't have: m, n and, in graphs, h."""
    return edges.select(F.col("a").alias("m"), F.col("b").alias("n"), *[F.col(k).alias("h") for k in edges.columns[2:]])


def _goes_on(steps: DataFrame):
    on = F.col("b") == F.col("m")
    return on & (F.col("g") == F.col("h")) if "h" in steps.columns else on


def _unseen(pairs: DataFrame, seen: list[DataFrame]) -> DataFrame:
    return materialize(pairs.distinct().join(reduce(DataFrame.unionAll, seen), pairs.columns, "left_anti"))


def reach(first: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b[, g]) reached by one step of ``first`` and any number of ``edges``, once each.

    Each round joins only the pairs that were new, and drops those that were seen. Where that takes more
    than ``PLAIN_ROUNDS`` rounds, runs of nodes with a single link are passed over by pointers that double
    their reach: a run of n nodes takes about log n joins, and the other rounds are as many as a path has
    branches. The pairs of every round are cut from their lineage in the shared checkpoint folder.
    """
    keys = edges.columns
    edges = materialize(edges)
    new = materialize(first.distinct())
    seen, rounds, pointers, steps = [new], 0, [], _steps(edges)
    while not new.isEmpty():
        if rounds == PLAIN_ROUNDS:
            pointers, steps = _passing(edges)
        along = new
        for pointer in pointers:  # from the first 2**k nodes of a run to the first 2**(k + 1)
            both = F.filter(F.array("b", "n"), lambda x: x.isNotNull())
            along = materialize(along.join(pointer, _goes_on(pointer), "left").select("a", F.explode(both).alias("b"), *keys[2:]).distinct())
        if pointers:
            seen.append(_unseen(along, seen))
        new = _unseen(along.join(steps, _goes_on(steps)).select("a", F.col("n").alias("b"), *keys[2:]), seen)
        seen.append(new)
        rounds += 1
    return reduce(DataFrame.unionAll, seen)


def _passing(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers over 1, 2, 4, ... links from nodes that have one link each, and the links of the other nodes."""
    start = edges.columns[0::2]  # a, and the graph
    single = edges.groupBy(*start).agg(F.count("*").alias("times"), F.min("b").alias("b")).where("times = 1")
    single = materialize(single.select(*edges.columns))
    most, pointers = single.count(), [_steps(single)]
    while 1 << len(pointers) <= most:
        further = pointers[-1].select(F.col("m").alias("b"), F.col("n").alias("c"), *[F.col("h").alias("g") for _ in start[1:]])
        on = F.col("n") == F.col("b")
        on = on & (F.col("h") == F.col("g")) if start[1:] else on
        longer = materialize(pointers[-1].join(further, on).select("m", F.col("c").alias("n"), *pointers[-1].columns[2:]))
        if longer.isEmpty():
            break
        pointers.append(longer)
    return pointers, materialize(_steps(edges.join(single.select(*start), start, "left_anti").select(*edges.columns)))


def all_pairs(edges: DataFrame) -> DataFrame:
    """Pairs (a, b[, g]) joined by one or more ``edges``, once each, in rounds that double the distance.

    With all pairs up to a distance of 2**k known, those further on, up to twice as far, have a node at just
    2**k on a shortest way, so only the furthest pairs are joined with all.
    """
    keys, distance = edges.columns, 1
    far = materialize(edges.distinct().withColumn("d", F.lit(1).cast("long")))
    parts = [far]
    while not far.isEmpty():
        known = reduce(DataFrame.unionAll, parts)
        after = known.select(F.col("a").alias("m"), F.col("b").alias("n"), *[F.col(k).alias("h") for k in keys[2:]], F.col("d").alias("e"))
        further = far.join(after, _goes_on(after)).select("a", F.col("n").alias("b"), *keys[2:], (F.col("d") + F.col("e")).alias("d"))
        new = materialize(further.groupBy(*keys).agg(F.min("d").alias("d")).join(known.select(*keys), keys, "left_anti").select(*keys, "d"))
        parts.append(new)
        distance *= 2
        far = new.where(F.col("d") == distance)
    return reduce(DataFrame.unionAll, parts).select(*keys)
