"""From algebra to DataFrames."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.expressions import Expressions, over, ratio
from ..functions.values import BIG, DEC, Val
from ..operators import paths
from ..session import materialize
from ..sources import remote
from ..sources.quads import unit
from ..terms import TERM, Term, Var, equal
from . import nodes as N
from . import plan as P
from .plan import Plan, fresh
from .syntax import expression_vars, visible

#: Rewrites of algebra nodes before compilation, the way to extend evaluation; each returns a node or None to decline.
REWRITES: list[Callable] = []
#: Evaluates a SERVICE node to a plan: ``f(spark, node, left) -> Plan``, ``left`` being the plan that it is joined to, if any; None refuses.
SERVICE: Callable | None = remote.service


def conjuncts(e) -> list:
    if isinstance(e, N.Call) and e.name == "&&":
        return [x for a in e.args for x in conjuncts(a)]
    return [e]


def has_exists(e) -> bool:
    return isinstance(e, N.Exists) or (isinstance(e, N.Call) and any(map(has_exists, e.args)))


#: Rows of a block of values that are also made a filter of what the block is joined with.
FEW = 64


def within(plan: Plan, node) -> Plan:
    """The rows that a block of a few plain terms can be joined with, so that the others are dropped in the scan."""
    if isinstance(node, N.Values) and len(node.rows) <= FEW:
        for n, terms in zip(node.names, zip(*node.rows)):
            if n in plan.certain and plan.vars[n].kind == "term" and all(t is not None and t.dt is None for t in terms):
                plan = plan.where(reduce(lambda a, b: a | b, [equal(plan.vars[n].col, t) for t in dict.fromkeys(terms)]))
    return plan


def connected(patterns: list) -> list[list]:
    """Patterns parted into groups without a common variable or subject, so that paths can join them before they would multiply."""
    groups: list[tuple[set, list]] = []
    for p in patterns:
        names = {t.name for t in p if isinstance(t, Var)} | {p[0]}
        near = [g for g in groups if g[0] & names]
        groups = [g for g in groups if not any(g is x for x in near)] + [(names.union(*(g[0] for g in near)), [*(x for g in near for x in g[1]), p])]
    return [g[1] for g in groups] or [[]]


def joined_texts(rows: DataFrame, keys: list[str], name: str, a: N.Aggregate) -> DataFrame:
    """GROUP_CONCAT in sorted order: equal texts are counted, ranges of a group's texts joined by separate tasks, then the pieces."""
    counted = rows.groupBy(*keys, "text").agg((F.lit(1) if a.distinct else F.count(F.lit(1))).cast("int").alias("times"))
    ranged = counted.repartitionByRange(*keys, "text").withColumn("part", F.spark_partition_id())
    texts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("text", "times"))))
    piece = F.array_join(F.transform(texts, lambda t: F.repeat(F.concat(F.lit(a.separator), t["text"]), t["times"])), "")
    pieces = ranged.groupBy(*keys, "part").agg(F.min("text").alias("first"), piece.alias("piece"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "piece"))), lambda p: p["piece"]), "")
    return pieces.groupBy(*keys).agg(whole.alias(name)).withColumn(name, F.expr(f"substring(`{name}`, {len(a.separator) + 1})"))


class Compiler:
    def __init__(self, spark: SparkSession, source, base: str | None = None, now: _dt.datetime | None = None):
        self.spark, self.source, self.base = spark, source, base
        self.now = now or _dt.datetime.now(_dt.timezone.utc)
        self.graph: Term | Var | None = None

    def expressions(self, scope: dict[str, Val], solution: set[str] | None = None) -> Expressions:
        return Expressions(scope, self.now, self.base, solution)

    def __call__(self, node) -> Plan:
        for rewrite in REWRITES:
            node = rewrite(node) or node
        name = type(node).__name__.lower()
        return getattr(self, "graph_" if name == "graph" else name)(node)

    # Patterns

    def bgp(self, node: N.BGP) -> Plan:
        simple, complex_ = [], []
        for s, p, o in node.patterns:
            for x in paths.expand(s, p, o) if not isinstance(p, Var) and paths.expand(s, p, o) else [(s, p, o)]:
                (simple if isinstance(x[1], (Term, Var)) else complex_).append(x)
        plans = [self.source.match(part, self.graph) for part in connected(simple)] if simple or not complex_ else []
        plans += [paths.path_plan(self.source, *x, self.graph) for x in complex_]
        plan, rest = plans[0], plans[1:]
        while rest:
            nearest = next((p for p in rest if P.shared(plan, p)), rest[0])
            rest.remove(nearest)
            plan = P.join(plan, nearest)
        hidden = [n for n in plan.vars if n.startswith("_:p_")]
        return plan.project([n for n in plan.vars if n not in hidden]) if hidden else plan

    def join(self, node: N.Join) -> Plan:
        left, right = (node.right, node.left) if isinstance(node.left, N.Service) else (node.left, node.right)
        before = self(left)
        after = self.service(right, before) if isinstance(right, N.Service) else self(right)
        return P.join(within(before, right), within(after, left))

    def union(self, node: N.Union) -> Plan:
        return P.union(self(node.left), self(node.right))

    def minus(self, node: N.Minus) -> Plan:
        return P.minus(self(node.left), self(node.right))

    def leftjoin(self, node: N.LeftJoin) -> Plan:
        left = self(node.left)
        right = self.service(node.right, left) if isinstance(node.right, N.Service) else self(node.right)
        if node.expr is None:
            return P.left_join(left, right)
        plain = [e for e in conjuncts(node.expr) if not has_exists(e)]
        inner = [e for e in conjuncts(node.expr) if has_exists(e)]
        for e in inner:
            right = self.filtered(right, e)
        return P.left_join(left, right, lambda scope: P.all_of(self.expressions(scope).truth(e) for e in plain)) if plain else P.left_join(left, right)

    def graph_(self, node: N.Graph) -> Plan:
        """A variable graph is read under a hidden name, so that inner uses of the variable stay their own."""
        var = isinstance(node.term, Var)
        outer, self.graph = self.graph, Var("_:" + fresh("graph")) if var else node.term
        hidden = self.graph.name if var else None
        try:
            plan = self(node.p)
            if var and hidden not in plan.certain:
                plan = P.join(plan, self.source.graphs(hidden))
        finally:
            self.graph = outer
        if not var:
            return plan
        name, graph = node.term.name, plan.vars[hidden]
        rest = [n for n in plan.vars if n != hidden]
        if name in plan.vars:
            own = plan.vars[name]
            plan = plan.where(own.col.isNull() | V.equal_terms(own, graph))
            rest.remove(name)
        vals = {**{n: plan.vars[n] for n in rest}, name: graph}
        return Plan(plan.df.select(*[v.col for v in vals.values()]), vals, plan.certain & set(rest) | {name})

    def service(self, node: N.Service, left: Plan | None = None) -> Plan:
        if SERVICE is None:
            if node.silent:
                return unit(self.spark)
            raise NotImplementedError("SERVICE is refused, as quadrille.plans.compiler.SERVICE is None")
        return SERVICE(self.spark, node, left)

    def values(self, node: N.Values) -> Plan:
        columns = list(zip(*node.rows)) if node.rows else [() for _ in node.names]
        if not node.names:
            return Plan(self.spark.range(len(node.rows)).select(F.lit(1).alias(fresh("one"))))
        names = {n: fresh(n) for n in node.names}
        schema, data, vals = [], [], {}
        for n, terms in zip(node.names, columns):
            kinds = {V.constant(t).kind for t in terms if t is not None}
            kind = kinds.pop() if len(kinds) == 1 else "term"
            native = {"int": "bigint", "str": "string", "dbl": "double"}.get(kind)  # of integers, those within a long
            schema.append(f"`{names[n]}` {native or TERM}")
            data.append([None if t is None else t.value() if native else tuple(t) for t in terms])
            vals[n] = Val(kind if native else "term", F.col(names[n]))
        df = self.spark.createDataFrame(list(zip(*data)), ", ".join(schema))
        # Spark takes such rows for large and would gather the other side's by these few values; the query's text holds them all.
        return Plan(F.broadcast(df), vals, frozenset(n for n, terms in zip(node.names, columns) if None not in terms))

    # Filters

    def filter(self, node: N.Filter) -> Plan:
        plan = self(node.p)
        for e in conjuncts(node.expr):
            plan = self.filtered(plan, e)
        return plan

    def filtered(self, plan: Plan, e) -> Plan:
        if isinstance(e, N.Call) and e.name == "!" and isinstance(e.args[0], N.Exists):
            e = N.Exists(e.args[0].group, not e.args[0].negated)
        if isinstance(e, N.Exists):
            inner, on = self.inner(plan, e.group)
            return P.semi_join(plan, inner, e.negated, on)
        kept = list(plan.vars)
        plan, e = self.marked(plan, e)
        plan = plan.where(self.expressions(plan.vars).truth(e))
        return plan.project(kept) if len(kept) != len(plan.vars) else plan

    def inner(self, outer: Plan, group) -> tuple[Plan, Callable | None]:
        """The plan of a pattern in EXISTS, and what its filters ask of variables that only the outside binds."""
        own, late = visible(group), []
        if isinstance(group, N.Filter):
            stay = []
            for e in conjuncts(group.expr):
                if has_exists(e) or expression_vars(e) <= visible(group.p) or not expression_vars(e) & set(outer.vars):
                    stay.append(e)
                else:
                    late.append(e)
            plan = self(group.p)
            needs = set().union(*(self.reads(e) for e in stay if has_exists(e))) if any(map(has_exists, stay)) else set()
            if given := sorted((needs - own) & set(outer.vars)):
                plan = P.join(plan, self._distinct(outer, given))
            for e in stay:
                plan = self.filtered(plan, e)
        else:
            plan = self(group)
        plan = plan.renewed()
        if not late:
            return plan, None
        return plan, lambda scope: P.all_of(self.expressions(scope).truth(e) for e in late)

    @staticmethod
    def _distinct(outer: Plan, names) -> Plan:
        p = outer.project(names).renewed()
        return Plan(p.df.distinct(), p.vars, p.certain)

    def reads(self, e) -> set[str]:
        """Variables that an expression reads, EXISTS included."""
        if isinstance(e, N.Exists):
            out = visible(e.group)
            for n in N.walk(e.group):
                if isinstance(n, N.Filter):
                    out = out | self.reads(n.expr)
            return out
        if isinstance(e, N.Call):
            return set().union(*map(self.reads, e.args))
        return expression_vars(e)

    def marked(self, plan: Plan, e) -> tuple[Plan, object]:
        """Replace EXISTS inside an expression by a variable that says whether there is a match."""
        if isinstance(e, N.Exists):
            inner, on = self.inner(plan, e.group)
            plan, found = P.exists(plan, inner, on)
            flag = "_:" + fresh("exists")
            return plan.bind(flag, Val("bool", ~found if e.negated else found), True), Var(flag)
        if isinstance(e, N.Call):
            args = []
            for a in e.args:
                plan, a = self.marked(plan, a)
                args.append(a)
            return plan, N.Call(e.name, args, e.distinct)
        return plan, e

    def extend(self, node: N.Extend) -> Plan:
        plan = self(node.p)
        kept = [*plan.vars, node.var]
        plan, e = self.marked(plan, node.expr)
        certain = isinstance(e, Term) or (isinstance(e, Var) and e.name in plan.certain)
        under = node.p
        while isinstance(under, N.Extend):
            under = under.p
        plan = plan.bind(node.var, self.expressions(plan.vars, visible(under))(e), certain)
        return plan.project(kept) if len(kept) != len(plan.vars) else plan

    # Aggregation

    def group(self, node: N.Group) -> Plan:
        plan = self(node.p)
        keys = list(node.keys)
        if isinstance(self.graph, Var) and self.graph.name in plan.vars and self.graph.name not in dict(keys):
            keys.append((self.graph.name, self.graph))
        seen = sorted(n for n in plan.vars if not n.startswith("_:"))
        x = self.expressions(plan.vars)
        vals = {n: x(e) for n, e in keys}
        vals = {n: V.as_term(v) if v.kind == "num" else v for n, v in vals.items()}
        columns = {n: fresh(n) for n in vals}
        parts, finish, texts = [], {}, []
        for n, a in node.aggregates:
            if a.name == "GROUP_CONCAT":
                texts.append((fresh(n), V.text_of(x(a.expr)), a))
                finish[n] = lambda c=F.col(texts[-1][0]): Val("str", c)
                continue
            got, finish[n] = self.aggregate(a, x, plan, seen)
            parts += got
        names = [v.col.alias(columns[n]) for n, v in vals.items()]
        rows = materialize(plan.df) if texts and len(node.aggregates) > 1 else plan.df  # read for each text
        df = None
        if parts or not texts:
            df = rows.groupBy(*names).agg(*parts or [F.count(F.lit(1)).alias(fresh("n"))])
        for name, text, a in texts:
            more = joined_texts(rows.select(*names, text.alias("text")), list(columns.values()), name, a)
            if df is None:
                df = more
            elif columns:
                keys_of = {c: fresh(c) for c in columns.values()}
                more = more.select(name, *[F.col(c).alias(k) for c, k in keys_of.items()])
                df = df.join(more, P.all_of([F.col(c).eqNullSafe(F.col(k)) for c, k in keys_of.items()])).drop(*keys_of.values())
            else:
                df = df.join(more)  # one row each
        certain = {n for n, e in keys if isinstance(e, Var) and e.name in plan.certain}
        out = Plan(df, {n: v.named(columns[n]) for n, v in vals.items()}, frozenset(certain))
        for n, a in node.aggregates:
            out = out.bind(n, finish[n](), a.name == "COUNT")
        return out

    def aggregate(self, a: N.Aggregate, x: Expressions, plan: Plan, seen) -> tuple[list[Column], Callable[[], Val]]:
        """Aggregated columns, and the value made of them."""
        cols: list[Column] = []

        def add(c: Column) -> Column:
            name = fresh("agg")
            cols.append(c.alias(name))
            return F.col(name)

        if a.expr is None:
            row = F.struct(*[plan.vars[n].col.alias(n) for n in seen]) if seen else F.lit(1)
            n = add(F.count_distinct(row) if a.distinct else F.count(F.lit(1)))
            return cols, lambda: Val("int", n)
        v = x(a.expr)
        if a.name == "COUNT":
            v = V.as_term(v) if v.kind == "num" else v
            n = add(F.count_distinct(v.col) if a.distinct else F.count(v.col))
            return cols, lambda: Val("int", n)
        if a.name in ("SUM", "AVG"):
            return cols, self._total(a, V.number(v), v, add)
        if a.name in ("MIN", "MAX"):
            if v.kind in ("term", "num", "iri"):
                native = v.kind == "iri"
                w = v if native else V.as_term(v)
                pick = (F.min_by if a.name == "MIN" else F.max_by)(w.col, V.sort_key(w))
                out = add(pick)
                return cols, lambda: Val(w.kind, out, w.prefix)
            out = add((F.min if a.name == "MIN" else F.max)(v.col))
            return cols, lambda: Val(v.kind, out, bits=v.bits)
        if a.name == "SAMPLE":
            w = V.as_term(v) if v.kind == "num" else v
            out = add(F.any_value(w.col, True))
            return cols, lambda: Val(w.kind, out, w.prefix)
        raise NotImplementedError(a.name)

    @staticmethod
    def _total(a: N.Aggregate, n: Val | None, v: Val, add) -> Callable[[], Val]:
        total = F.sum_distinct if a.distinct else F.try_sum
        count = F.count_distinct if a.distinct else F.count
        if n is None:
            bound = add(F.count(v.col))
            return lambda: Val("int", F.when(bound == 0, F.lit(0).cast("long")), bits=0)
        if n.kind == "dbl":
            out = add((F.sum_distinct if a.distinct else F.sum)(n.col) if a.name == "SUM" else F.try_divide(F.sum_distinct(n.col), F.count_distinct(n.col)) if a.distinct else F.avg(n.col))
            return lambda: Val("dbl", F.coalesce(out, F.lit(0.0)))
        if n.kind in ("int", "big", "dec"):
            wide = {"int": "decimal(28,0)", "big": BIG, "dec": DEC}[n.kind]  # 10**10 longs and more add up within 38 digits
            sums, rows = add(total(n.col.cast(wide))), add(count(n.col))
            kind, to = ("dec", DEC) if n.kind == "dec" else ("big", BIG)
            if a.name == "SUM":
                return lambda: Val(kind, F.when(rows == 0, F.lit(0).cast(to)).otherwise(sums.try_cast(to)))
            mean = over(sums, rows.cast("decimal(20,0)"))
            if kind == "big":
                mean = F.coalesce(mean, ratio(sums, rows))
            return lambda: Val("dec", F.when(rows == 0, F.lit(0).cast(DEC)).otherwise(mean))
        bound = V.term_of(v)
        wrong = add(F.count(F.when(bound.isNotNull() & n.rank.isNull(), 1)))
        rank = add(F.coalesce(F.max(n.rank), F.lit(0)))
        rows = add(count(n.col))
        # a number beyond its lane's digits leaves the lane's total unknown
        lost_whole, lost = add(F.count(F.when((n.rank == 0) & n.whole.isNull(), 1))), add(F.count(F.when((n.rank < 2) & n.dec.isNull(), 1)))
        dbl = add(F.coalesce((F.sum_distinct if a.distinct else F.sum)(n.col), F.lit(0.0)))
        whole_sum, dec_sum = add(total(n.whole)), add(total(n.dec))
        zero = lambda t: F.when(rows == 0, F.lit(0).cast(t))

        def finish() -> Val:
            ok = F.when(wrong == 0, rank)
            whole = zero(BIG).when((rank == 0) & (lost_whole == 0), whole_sum.try_cast(BIG))
            dec = zero(DEC).when((rank == 0), whole.try_cast(DEC)).when(lost == 0, dec_sum.try_cast(DEC))
            if a.name == "SUM":
                return Val("num", dbl, rank=ok, whole=whole, dec=dec)
            some = F.when(rows == 0, F.lit(0)).otherwise(F.greatest(rank, F.lit(1)))
            mean = F.coalesce(over(dec, rows.cast("decimal(20,0)")), F.when(rank == 0, ratio(whole, rows)))
            return Val("num", F.coalesce(F.try_divide(dbl, rows), F.lit(0.0)), rank=F.when(wrong == 0, some), whole=zero(BIG), dec=zero(DEC).otherwise(mean))

        return finish

    # Solution modifiers

    def _keys(self, plan: Plan, conditions) -> tuple[Plan, list[tuple[Column, bool]]]:
        keys = []
        for e, descending in conditions:
            plan, e = self.marked(plan, e)
            keys.append((V.sort_key(self.expressions(plan.vars)(e)), descending))
        return plan, keys

    @staticmethod
    def _order(keys) -> list[Column]:
        return [k.desc_nulls_last() if d else k.asc_nulls_first() for k, d in keys]

    def orderby(self, node: N.OrderBy) -> Plan:
        plan, keys = self._keys(self(node.p), node.conditions)
        return Plan(plan.df.orderBy(*self._order(keys)), plan.vars, plan.certain)

    def project(self, node: N.Project) -> Plan:
        plan = self(node.p)
        hidden = [self.graph.name] if isinstance(self.graph, Var) and self.graph.name in plan.vars else []
        return plan.project(list(dict.fromkeys([*node.names, *hidden])))

    def distinct(self, node: N.Distinct) -> Plan:
        if isinstance(node.p, N.Project) and isinstance(node.p.p, N.OrderBy):
            order = node.p.p
            plan, keys = self._keys(self(order.p), order.conditions)
            names = [fresh("key") for _ in keys]
            for name, (k, _) in zip(names, keys):
                plan = Plan(plan.df.withColumn(name, k), plan.vars, plan.certain)
            out = Plan(plan.df, plan.vars, plan.certain)
            for n in node.p.names:
                if n not in out.vars:
                    out = out.bind(n, V.null())
            kept = {n: out.vars[n] for n in node.p.names}
            aliases = {n: fresh(n) for n in kept}
            first = [(F.max if d else F.min)(name).alias(name) for name, (_, d) in zip(names, keys)]
            df = out.df.groupBy(*[v.col.alias(aliases[n]) for n, v in kept.items()]).agg(*first)
            df = df.orderBy(*self._order([(F.col(name), d) for name, (_, d) in zip(names, keys)]))
            return Plan(df, {n: v.named(aliases[n]) for n, v in kept.items()}, out.certain & set(kept)).project(list(kept))
        plan = self(node.p)
        return Plan(plan.df.distinct(), plan.vars, plan.certain)

    def reduced(self, node: N.Reduced) -> Plan:
        return self(node.p)

    def slice(self, node: N.Slice) -> Plan:
        plan = self(node.p)
        df = plan.df.offset(node.offset) if node.offset else plan.df
        return Plan(df if node.limit is None else df.limit(node.limit), plan.vars, plan.certain)


def compile_pattern(spark: SparkSession, source, node, base: str | None = None, bindings: dict[str, Term] | None = None, now=None) -> Plan:
    """The plan of an algebra tree; ``bindings`` are given to the whole of it as constants."""
    if bindings:
        node = bind_constants(node, bindings)
    plan = Compiler(spark, source, base, now)(node)
    for n, t in (bindings or {}).items():
        if n not in plan.vars:
            plan = plan.bind(n, V.constant(t), True)
    return plan


def bind_constants(node, bindings: dict[str, Term]):
    """Join the bindings, as one row, with every pattern that has one of their variables."""

    def one(n):
        if isinstance(n, N.BGP) and (names := sorted(visible(n) & set(bindings))):
            return N.Join(N.Values(names, [tuple(bindings[v] for v in names)]), n)
        return n

    return N.transform(node, one)
