"""A solution sequence: a DataFrame, the value that each variable has in it, and which are always bound."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val

_numbers = itertools.count()


def fresh(name: str) -> str:
    """A column name that no other plan has."""
    return f"{re.sub(r'[^A-Za-z0-9_]', '_', name)}_{next(_numbers)}"


def all_of(conditions) -> Column | None:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


@dataclass
class Plan:
    df: DataFrame
    vars: dict[str, Val] = field(default_factory=dict)
    certain: frozenset[str] = frozenset()

    def bind(self, name: str, val: Val, certain: bool = False) -> Plan:
        """With one more variable, in a column of its own."""
        val = V.as_term(val) if val.kind == "num" else val
        col = fresh(name)
        return Plan(self.df.withColumn(col, val.col), {**self.vars, name: val.named(col)}, self.certain | ({name} if certain else set()))

    def where(self, condition: Column) -> Plan:
        return Plan(self.df.where(condition), self.vars, self.certain)

    def project(self, names) -> Plan:
        """These variables only, those without a value as unbound ones."""
        p = self
        for n in names:
            if n not in p.vars:
                p = p.bind(n, V.null())
        kept = {n: p.vars[n] for n in names}
        return Plan(p.df.select(*[v.col for v in kept.values()]), kept, p.certain & set(names))

    def renewed(self) -> Plan:
        """The same rows under new column names, so that a plan can meet itself in a join."""
        names = {n: fresh(n) for n in self.vars}
        return Plan(self.df.select(*[v.col.alias(names[n]) for n, v in self.vars.items()]), {n: v.named(names[n]) for n, v in self.vars.items()}, self.certain)

    def as_terms(self, names) -> Plan:
        p = self
        for n in names:
            if p.vars[n].kind != "term":
                p = p.bind(n, V.as_term(p.vars[n]), n in p.certain)
        return p


def align(a: Plan, b: Plan, names) -> tuple[Plan, Plan]:
    """Both plans with the variables in one common form."""
    mixed = [n for n in names if not a.vars[n].same_form(b.vars[n])]
    return a.as_terms(mixed), b.as_terms(mixed)


def shared(a: Plan, b: Plan) -> list[str]:
    return [n for n in a.vars if n in b.vars]


def compatible(a: Plan, b: Plan, names) -> Column | None:
    """The condition that two rows agree on each shared variable that both bind."""
    conditions = []
    for n in names:
        p, q = a.vars[n].col, b.vars[n].col
        same = p == q
        for plan, c in ((a, p), (b, q)):
            if n not in plan.certain:
                same = c.isNull() | same
        conditions.append(same)
    return all_of(conditions)


def merged(a: Plan, b: Plan, names) -> dict[str, Val]:
    """Values after a join: shared variables take whichever side binds them."""
    out = {**b.vars, **a.vars}
    for n in names:
        if n not in a.certain:
            v = a.vars[n]
            out[n] = Val(v.kind, F.coalesce(v.col, b.vars[n].col), v.prefix, max(v.bits, b.vars[n].bits))
    return out


def _settle(df: DataFrame, vals: dict[str, Val], certain) -> Plan:
    """Give computed values columns of their own and drop what no variable needs."""
    names = {n: fresh(n) for n in vals}
    return Plan(df.select(*[v.col.alias(names[n]) for n, v in vals.items()]) if vals else df, {n: v.named(names[n]) for n, v in vals.items()}, frozenset(certain))


#: Parts that rows without a common variable are dealt over, as each meets every such row of the other side.
SALTS = 16


def together(*parts: Plan) -> Plan:
    return reduce(union, [p.renewed() for p in parts])


def unsure(a: Plan, b: Plan, names) -> bool:
    """Whether no shared variable is bound on both sides for certain, so that none is a key by itself."""
    return bool(names) and not any(n in a.certain and n in b.certain for n in names)


def masks(p: Plan, names) -> list[int]:
    """Which of the shared variables a row can bind, as bits."""
    sure = sum(1 << k for k, n in enumerate(names) if n in p.certain)
    free = [1 << k for k, n in enumerate(names) if n not in p.certain]
    return [sure + sum(c) for r in range(len(free) + 1) for c in itertools.combinations(free, r)]


def keys(p: Plan, other: Plan, names, first: bool, disjoint: bool) -> Column:
    """An array of a row's keys: two rows have one in common if they agree on what both bind, and else none.

    A key holds the masks of both rows and the values of what both masks have, so a row has one for each
    mask that the other side's rows can have. Masks without a common bit have a key only with
    ``disjoint``; it is dealt over ``SALTS`` parts, of which the first side's row is in one and the second's in all.
    """
    own = reduce(lambda x, y: x.bitwiseOR(y), [F.when(p.vars[n].col.isNotNull(), 1 << k).otherwise(0) for k, n in enumerate(names)])
    spread = F.pmod(F.xxhash64(*[v.col for v in p.vars.values()]), F.lit(SALTS)).cast("int")
    mine = masks(p, names)

    def of(mask: int) -> Column:
        values = [F.when(own.bitwiseAND(mask & 1 << k) != 0, p.vars[n].col).alias(n) for k, n in enumerate(names)]
        first_mask, second_mask = (own, F.lit(mask)) if first else (F.lit(mask), own)

        def key(salt: Column) -> Column:
            return F.struct(first_mask.alias("first"), second_mask.alias("second"), salt.alias("salt"), *values)

        near = F.array(key(F.lit(0)))
        if all(m & mask for m in mine):
            return near
        apart = F.slice(near, 1, 0) if not disjoint else F.array(key(spread)) if first else F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), key)
        return F.when(own.bitwiseAND(mask) != 0, near).otherwise(apart)

    found = [of(mask) for mask in masks(other, names)]
    return found[0] if len(found) == 1 else F.concat(*found)


def keyed(a: Plan, b: Plan, names, disjoint: bool, single: bool = False) -> tuple[Plan, Plan, str, str]:
    """Both sides with a column of keys that are equal for compatible rows; each is read once, whatever the number of variables.

    Rows come once for each key. With ``single``, those of ``a`` have one or none, as ``b`` binds all variables.
    Spark sizes a side by its rows before they are repeated, so these joins are never broadcast.
    """
    at_a, at_b = fresh("key"), fresh("key")
    own = keys(a, b, names, True, disjoint)
    left = a.df.withColumn(at_a, F.get(own, F.lit(0)) if single else F.explode_outer(own))
    return Plan(left, a.vars, a.certain), Plan(b.df.withColumn(at_b, F.explode(keys(b, a, names, False, disjoint))).hint("merge"), b.vars, b.certain), at_a, at_b


def settles(b: Plan, names) -> bool:
    return all(n in b.certain for n in names)


def meeting(a: Plan, b: Plan, names, disjoint: bool = True) -> tuple[Plan, Plan, Column | None]:
    """Both sides and the condition under which their rows are compatible, rows of ``a`` coming once, if ``b`` settles the shared variables or some are keys."""
    if not unsure(a, b, names):
        return a, b, compatible(a, b, names)
    a, b, at_a, at_b = keyed(a, b, names, disjoint, single=True)
    return a, b, F.col(at_a) == F.col(at_b)


def join(a: Plan, b: Plan, dealt: bool = False) -> Plan:
    """``dealt``: few values may be shared by very many rows of both sides, so each value's rows of ``a`` are dealt over ``SALTS`` parts, which all have those of ``b``."""
    names = shared(a, b)
    a, b = align(a, b, names)
    if unsure(a, b, names):
        a, b, at_a, at_b = keyed(a, b, names, True)
        condition = F.col(at_a) == F.col(at_b)
    else:
        condition = compatible(a, b, names)
        if dealt and condition is not None:
            at_a, at_b = fresh("salt"), fresh("salt")
            a = Plan(a.df.withColumn(at_a, F.pmod(F.xxhash64(*[v.col for v in a.vars.values()]), F.lit(SALTS)).cast("int")), a.vars, a.certain)
            b = Plan(b.df.withColumn(at_b, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), b.vars, b.certain)
            condition = condition & (F.col(at_a) == F.col(at_b))
    df = a.df.join(b.df, condition, "inner") if condition is not None else a.df.crossJoin(b.df)
    return _settle(df, merged(a, b, names), a.certain | b.certain)


def left_join(a: Plan, b: Plan, on=None) -> Plan:
    """``on`` gets the values of both sides and gives a condition."""
    names = shared(a, b)
    a, b = align(a, b, names)
    if unsure(a, b, names) and not settles(b, names):
        both = join(a.renewed(), b.renewed())
        return together(both if on is None else both.where(on(both.vars)), semi_join(a.renewed(), b.renewed(), True, on))
    a, b, condition = meeting(a, b, names)
    if on is not None:
        extra = on(merged(a, b, names))
        condition = extra if condition is None else condition & extra
    df = a.df.join(b.df, F.lit(True) if condition is None else condition, "left")
    return _settle(df, merged(a, b, names), a.certain)


def exists(a: Plan, b: Plan, on=None, disjoint: bool = True) -> tuple[Plan, Column]:
    """``a``, and whether a row of ``b`` is compatible with its row and meets ``on``; without ``disjoint``, one that also shares a bound variable.

    Spark joins it as an existence join, by key. Where a row of ``a`` has several keys, equal rows are
    counted and looked up once, and a row is found if one of its keys is.
    """
    names = shared(a, b)
    a, b = align(a, b, names)
    if not unsure(a, b, names) or settles(b, names):
        a, b, _ = meeting(a, b, names, disjoint)
        if not unsure(a, b, names):
            return a, _found(a, b, lambda outer: compatible(outer, b, names), on, names)
        at_a, at_b = a.df.columns[-1], b.df.columns[-1]
        return a, _found(a, b, lambda _: F.col(at_a).outer() == F.col(at_b), on, names)
    a = _settle(a.df, a.vars, a.certain)
    columns = [F.col(f"`{c}`") for c in a.df.columns]
    times, flag = fresh("times"), fresh("found")
    rows, b, at_a, at_b = keyed(Plan(a.df.groupBy(*columns).agg(F.count(F.lit(1)).alias(times)), a.vars, a.certain), b, names, disjoint)
    found = rows.df.withColumn(flag, _found(rows, b, lambda _: F.col(at_a).outer() == F.col(at_b), on, names))
    found = found.groupBy(*columns).agg(F.max(flag).alias(flag), F.max(times).alias(times))
    found = found.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return Plan(found, a.vars, a.certain), F.col(flag)


def _found(a: Plan, b: Plan, meets, on, names) -> Column:
    outer = Plan(a.df, {n: Val(v.kind, v.col.outer(), v.prefix, v.bits) for n, v in a.vars.items()}, a.certain)
    condition = meets(outer)
    if on is not None:
        extra = on(merged(outer, b, names))
        condition = extra if condition is None else condition & extra
    return (b.df if condition is None else b.df.where(condition)).exists()


def semi_join(a: Plan, b: Plan, anti: bool = False, on=None) -> Plan:
    names = shared(a, b)
    a, b = align(a, b, names)
    if unsure(a, b, names) and not settles(b, names):
        p, found = exists(a, b, on)
        return p.where(~found if anti else found)
    p, b, condition = meeting(a, b, names)
    if on is not None:
        extra = on(merged(p, b, names))
        condition = extra if condition is None else condition & extra
    if condition is None:  # any row will do
        return Plan(a.df.join(b.df.select(F.lit(1).alias(fresh("any"))).limit(1), F.lit(True), "left_anti" if anti else "left_semi"), a.vars, a.certain)
    return Plan(p.df.join(b.df, condition, "left_anti" if anti else "left_semi"), a.vars, a.certain)


def minus(a: Plan, b: Plan) -> Plan:
    names = shared(a, b)
    if not names:
        return a
    a, b = align(a, b, names)
    if unsure(a, b, names) and not settles(b, names):
        p, found = exists(a, b, disjoint=False)
        return p.where(~found)
    p, b, condition = meeting(a, b, names, disjoint=False)
    return Plan(p.df.join(b.df, condition, "left_anti"), a.vars, a.certain)


def union(a: Plan, b: Plan) -> Plan:
    a, b = align(a, b, shared(a, b))
    every = {**a.vars, **{n: v for n, v in b.vars.items() if n not in a.vars}}
    names = {n: fresh(n) for n in every}

    def columns(p: Plan, q: Plan):
        for n in every:
            col = p.vars[n].col if n in p.vars else F.lit(None).cast(q.df.schema[q.df.select(q.vars[n].col).columns[0]].dataType)
            yield col.alias(names[n])

    if not every:
        return Plan(a.df.select(F.lit(1).alias("one")).unionAll(b.df.select(F.lit(1).alias("one"))))
    df = a.df.select(*columns(a, b)).unionAll(b.df.select(*columns(b, a)))
    return Plan(df, {n: v.named(names[n]) for n, v in every.items()}, a.certain & b.certain)


