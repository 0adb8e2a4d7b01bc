"""SPARQL expressions as Spark columns. A type error is NULL, so SQL's logic of three values is SPARQL's."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import replace
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import nodes as N
from ..terms import LITERAL, RDF, XSD, Term, Var, lit, make
from . import values as V
from .registry import FUNCTIONS
from .values import BIG, DEC, Val

BUILT: dict[str, Callable] = {}


def built(*names: str):
    def keep(f):
        for n in names:
            BUILT[n] = f
        return f

    return keep


class Expressions:
    """Compiles expressions over the variables of one solution sequence."""

    def __init__(self, scope: dict[str, Val], now: _dt.datetime, base: str | None = None, solution: set[str] | None = None):
        """``solution``: the variables that tell solutions apart, for labelled blank nodes; all if None."""
        self.scope, self.now, self.base, self.solution = scope, now, base, solution

    def __call__(self, e) -> Val:
        if isinstance(e, Var):
            return self.scope.get(e.name, V.null())
        if isinstance(e, Term):
            return V.constant(e)
        if isinstance(e, N.Exists):
            raise NotImplementedError("EXISTS in this place")
        if isinstance(e, N.Call):
            out = self.function(e) if isinstance(e.name, Term) else self.builtin(e)
            return replace(out, deep=True) if out.kind == "term" and not out.missing else out
        raise TypeError(f"no expression: {e!r}")

    def builtin(self, e: N.Call) -> Val:
        """A built-in of arguments, each of which that is a computed term is named first."""
        args, given = list(e.args), {}
        for i, a in enumerate(args):
            if isinstance(a, N.Call):
                given[f"_:arg{i}"] = self(a)
                args[i] = Var(f"_:arg{i}")
        deep = [n for n, v in given.items() if v.deep]
        f, made = BUILT[e.name], []

        def body(*cols: Column) -> Column:
            named = {n: Val("term", c) for n, c in zip(deep, cols)}
            inner = Expressions({**self.scope, **given, **named}, self.now, self.base, self.solution if self.solution is not None else set(self.scope))
            out = f(inner, *args)
            made.append(V.as_term(out) if out.kind == "num" else out)
            return made[0].col

        if not deep:
            return f(Expressions({**self.scope, **given}, self.now, self.base, self.solution if self.solution is not None else set(self.scope)), *args)
        col = V.let([given[n].col for n in deep], body)
        return Val(made[0].kind, col, made[0].prefix)

    def truth(self, e) -> Column:
        return V.truth(self(e))

    def function(self, e: N.Call) -> Val:
        args = [self(a) for a in e.args]
        if e.name.lex in CASTS and len(args) == 1:
            return CASTS[e.name.lex](args[0])
        if e.name.lex in FUNCTIONS:
            out = FUNCTIONS[e.name.lex](*[V.term_of(a) for a in args])
            return out if isinstance(out, Val) else Val("term", out)
        raise ValueError(f"unknown function {e.name.lex}")


# Logic


@built("||")
def _or(x, a, b):
    return Val("bool", x.truth(a) | x.truth(b))


@built("&&")
def _and(x, a, b):
    return Val("bool", x.truth(a) & x.truth(b))


@built("!")
def _not(x, a):
    return Val("bool", ~x.truth(a))


@built("IF")
def _if(x, c, a, b):
    c, (a, b) = x.truth(c), V.unify([x(a), x(b)])
    return Val(a.kind, F.when(c, a.col).when(~c, b.col), a.prefix)


@built("COALESCE")
def _coalesce(x, *args):
    vals = V.unify([V.as_term(v) if v.kind == "num" else v for v in map(x, args)]) or [V.null()]
    return Val(vals[0].kind, F.coalesce(*[v.col for v in vals]), vals[0].prefix)


@built("BOUND")
def _bound(x, v):
    return Val("bool", x(v).col.isNotNull())


# Comparison


def compare(op: str, a: Val, b: Val) -> Column:
    apply = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
    if a.kind in V.NUMBERS and b.kind in V.NUMBERS:
        if {a.kind, b.kind} == {"big", "dec"}:  # beyond a decimal's digits, doubles tell
            p, q = (v.col.try_cast(DEC) for v in (a, b))
            return F.coalesce(apply(p, q), apply(V.double_of(a), V.double_of(b)))
        return apply(V.double_of(a), V.double_of(b)) if "dbl" in (a.kind, b.kind) else apply(a.col, b.col)
    if a.kind == b.kind and a.kind in ("str", "bool", "dtm"):
        return apply(a.col, b.col)
    if op == "!=":
        return ~compare("=", a, b)
    if a.deep or b.deep or "num" in (a.kind, b.kind):
        return V.let([V.term_of(a), V.term_of(b)], lambda p, q: compare(op, Val("term", p), Val("term", q)))
    m, n = V.number(a), V.number(b)
    numeric = None
    if m is not None and n is not None:
        m, n = V.widen(m), V.widen(n)
        numeric = F.when((m.rank == 0) & (n.rank == 0) & m.whole.isNotNull() & n.whole.isNotNull(), apply(m.whole, n.whole)).when((m.rank < 2) & (n.rank < 2) & m.dec.isNotNull() & n.dec.isNotNull(), apply(m.dec, n.dec)).otherwise(apply(m.col, n.col))
        both = m.rank.isNotNull() & n.rank.isNotNull()
    if op == "=" and a.kind == b.kind == "iri":
        return V.equal_terms(a, b)
    p, q = V.term_of(a), V.term_of(b)
    (t, tz, td), (u, uz, ud) = V.instant(a), V.instant(b)
    instants = F.when(td == ud, F.when(tz == uz, apply(t, u)).when(F.abs(t - u) > 14 * 3600 * 1_000_000, apply(t, u)))
    text = lambda v: F.when((v["k"] == LITERAL) & v["dt"].isNull(), v["lex"])
    boolean = lambda v: F.when(v["dt"] == XSD + "boolean", F.when(v["lex"].isin("true", "1"), True).when(v["lex"].isin("false", "0"), False))
    plain = text(p).isNotNull() & text(q).isNotNull()
    if op == "=":
        out = F.when(p == q, F.lit(True))
        if numeric is not None:
            out = F.when(both, numeric).when(p == q, F.lit(True))
        out = out.when(p.isNull() | q.isNull(), F.lit(None))
        out = out.when((p["k"] != LITERAL) | (q["k"] != LITERAL), F.lit(False)).when(plain, F.lit(False))
        out = out.when(p["lang"].isNotNull() | q["lang"].isNotNull() | (td != ud), F.lit(False))  # never one value
        return out.when(instants.isNotNull(), instants).when(boolean(p).isNotNull() & boolean(q).isNotNull(), boolean(p) == boolean(q))
    out = F.when(plain & p["lang"].eqNullSafe(q["lang"]), apply(text(p), text(q))).when(instants.isNotNull(), instants)
    out = out.when(boolean(p).isNotNull() & boolean(q).isNotNull(), apply(boolean(p), boolean(q)))
    return F.when(both, numeric).otherwise(out) if numeric is not None else out


MIRRORED = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _year_range(x, op: str, a, b) -> Column | None:
    """A native timestamp's YEAR against a constant, as a range of the timestamp itself."""
    if isinstance(a, Term):
        a, b, op = b, a, MIRRORED[op]
    if not (isinstance(a, N.Call) and a.name == "YEAR" and isinstance(b, Term) and b.dt == XSD + "integer" and b.lex.isdigit()):
        return None
    v, year = x(a.args[0]), int(b.lex)
    if v.kind != "dtm" or not 1 <= year < 9999:
        return None
    first, after = (F.lit(f"{y:04}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    within = (v.col >= first) & (v.col < after)
    return {"=": within, "!=": ~within, "<": v.col < first, "<=": v.col < after, ">": v.col >= after, ">=": v.col >= first}[op]


def _comparison(op: str):
    def f(x, a, b):
        years = _year_range(x, op, a, b)
        return Val("bool", compare(op, x(a), x(b)) if years is None else years)

    return f


BUILT |= {op: _comparison(op) for op in MIRRORED}


@built("IN")
def _in(x, a, *members):
    v, members = x(a), [x(m) for m in members]
    if members and v.kind in ("int", "str") and all(m.kind == v.kind for m in members):
        return Val("bool", v.col.isin([m.col for m in members]))
    out = F.lit(False)
    for m in members:
        out = out | compare("=", v, m)
    return Val("bool", out)


@built("NOT IN")
def _not_in(x, *args):
    return Val("bool", ~_in(x, *args).col)


@built("SAMETERM")
def _same_term(x, a, b):
    return Val("bool", V.equal_terms(x(a), x(b)))


# Arithmetic


def times(a: Column, b: Column) -> Column:
    """A product of decimals: as many digits after the point as the size of the factors leaves room for."""
    narrow = lambda t: F.try_multiply(a.try_cast(t), b.try_cast(t))
    exact = lambda c, t: F.when(c.try_cast(t) == c, c)
    fine = F.try_multiply(exact(a, "decimal(18,9)").cast("decimal(18,9)"), exact(b, "decimal(18,9)").cast("decimal(18,9)"))
    return F.coalesce(fine.try_cast(DEC), narrow("decimal(24,6)").try_cast(DEC))


def over(a: Column, b: Column) -> Column:
    return F.try_divide(a.try_cast("decimal(28,9)"), b.try_cast("decimal(28,9)")).try_cast(DEC)


def ratio(a: Column, b: Column) -> Column:
    """A quotient of integers; of those beyond 20 digits with 6 digits after the point."""
    divided = lambda t: F.try_divide(a.try_cast(t), b.try_cast(t)).try_cast(DEC)
    return F.coalesce(divided("decimal(20,0)"), divided(BIG))


def _integers(op: str, plain, a: Val, b: Val) -> Val:
    """Longs as far as their bounds tell that the result is one, else decimals of 38 digits."""
    if a.kind == b.kind == "int":
        bits = a.bits + b.bits if op == "*" else max(a.bits, b.bits) + 1
        if bits < 63:
            return Val("int", plain(a.col, b.col), bits=bits)
    return Val("big", plain(a.col.cast(BIG), b.col.cast(BIG)).try_cast(BIG))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if {a.kind, b.kind} & {"term", "dtm"}:
        rows = [v for v in (a, b) if not v.fixed]  # what a constant adds is folded

        def of_rows(*cols: Column) -> Column:
            named = iter(cols)
            return _of_terms(op, *[v if v.fixed else Val("term", next(named)) for v in (a, b)])

        return Val("term", V.let([V.term_of(v) for v in rows], of_rows) if rows else _of_terms(op, a, b), deep=True)
    a, b = V.number(a), V.number(b)
    if a is None or b is None:
        return V.null()
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    if a.kind in V.NUMBERS and b.kind in V.NUMBERS:
        if "dbl" in (a.kind, b.kind):
            p, q = V.double_of(a), V.double_of(b)
            return Val("dbl", F.when(q != 0, p / q) if op == "/" else {"+": p + q, "-": p - q, "*": p * q}[op])
        if {a.kind, b.kind} <= {"int", "big"}:
            return Val("dec", ratio(a.col, b.col)) if op == "/" else _integers(op, plain, a, b)
        p, q = a.col.try_cast(DEC), b.col.try_cast(DEC)
        return Val("dec", {"*": times, "/": over}.get(op, lambda p, q: plain(p, q).try_cast(DEC))(p, q))
    return _numbers(op, V.widen(a), V.widen(b))


def _numbers(op: str, a: Val, b: Val) -> Val:
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]
    rank = F.greatest(a.rank, b.rank, F.lit(1 if op == "/" else 0))
    rank = F.when(a.rank.isNotNull() & b.rank.isNotNull(), rank)
    if op == "/":
        rank = F.when((rank > 1) | (b.dec != 0) | (b.whole != 0), rank)
        dbl, dec = F.try_divide(a.col, b.col), F.coalesce(ratio(a.whole, b.whole), over(a.dec, b.dec))
    elif op == "*":
        dbl, dec = a.col * b.col, times(a.dec, b.dec)
    else:
        dbl, dec = (a.col + b.col if op == "+" else a.col - b.col), plain(a.dec, b.dec).try_cast(DEC)
    whole = F.lit(None).cast(BIG) if op == "/" else F.when(rank == 0, plain(a.whole, b.whole).try_cast(BIG))
    dec = F.when(rank == 1, dec).when(rank == 0, whole.try_cast(DEC))
    return Val("num", F.when(rank.isNotNull(), dbl), rank=rank, whole=whole, dec=dec)


DURATION = r"^(-)?P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"


def duration(v: Val) -> Column:
    """A struct of the months and microseconds of a duration literal, to be named before it is read; NULL for other terms."""
    lex, dt = v.col["lex"], v.col["dt"]
    ok = dt.isin(XSD + "duration", XSD + "dayTimeDuration", XSD + "yearMonthDuration") & lex.rlike(DURATION)

    def parts(texts: Column) -> Column:
        part = lambda n: F.coalesce(texts[n - 2].try_cast("decimal(28,6)"), F.lit(0))
        sign = F.when(lex.startswith("-"), -1).otherwise(1)
        micros = (((part(4) * 24 + part(5)) * 60 + part(6)) * 60 + part(7)) * 1_000_000
        return F.struct((sign * (part(2) * 12 + part(3))).cast("int").alias("months"), (sign * micros).cast("long").alias("micros"))

    texts = F.split(F.regexp_replace(lex, DURATION, "$2,$3,$4,$5,$6,$7"), ",")
    return F.when(ok, parts(texts) if v.fixed else V.let([texts], parts))


def duration_text(micros: Column) -> Column:
    """An ISO 8601 duration of days, hours, minutes and seconds."""
    return V.let([micros], _duration_text)


def _duration_text(micros: Column) -> Column:
    m = F.abs(micros)
    days, hours, minutes, rest = F.floor(m / 86_400_000_000), F.floor(m / 3_600_000_000) % 24, F.floor(m / 60_000_000) % 60, m % 60_000_000
    unit = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    seconds = F.when(rest > 0, F.concat(V.decimal_text((rest / 1_000_000).cast("decimal(12,6)")), F.lit("S"))).otherwise("")
    time = F.concat(unit(hours, "H"), unit(minutes, "M"), seconds)
    text = F.concat(F.when(micros < 0, "-").otherwise(""), F.lit("P"), unit(days, "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(micros == 0, "PT0S").otherwise(text)


def _of_terms(op: str, a: Val, b: Val) -> Column:
    """Arithmetic of terms whose types rows tell: numbers, differences of instants, instants moved by durations."""
    numbers = V.let([V.term_of(_numbers(op, V.widen(V.number(a)), V.widen(V.number(b))))], lambda c: c)
    if op not in "+-":
        return numbers

    def timed(t: Column, tz: Column, td: Column, u: Column, uz: Column, ud: Column, of_a: Column, of_b: Column) -> Column:
        months, micros, months_a, micros_a = of_b["months"], of_b["micros"], of_a["months"], of_a["micros"]
        out = F.when(F.lit(False), lit(None))
        if op == "-":
            out = out.when((td == ud) & (tz == uz), _made(duration_text(t - u)))
        sign = -1 if op == "-" else 1
        out = out.when(t.isNotNull() & micros.isNotNull(), _moved(a, t, td, sign * months, sign * micros))
        if op == "+":
            out = out.when(u.isNotNull() & micros_a.isNotNull(), _moved(b, u, ud, months_a, micros_a))
        total = micros_a + micros if op == "+" else micros_a - micros
        return out.when((months == 0) & (months_a == 0), _made(duration_text(total)))

    return F.when(V.number(a).rank.isNotNull(), numbers).otherwise(V.let([*V.instant(a), *V.instant(b), duration(a), duration(b)], timed))


def _made(text: Column, dt: Column | str = XSD + "dayTimeDuration") -> Column:
    return V.let([text], lambda t: make(3, t, dt))


def _moved(v: Val, micros: Column, dt: Column, months: Column, more: Column) -> Column:
    """An instant moved by months, then microseconds, in its own zone."""

    def moved(zone: Column) -> Column:
        offset = F.when(zone.isin("", "Z"), 0).otherwise(F.concat(zone.substr(1, 1), F.lit("1")).try_cast("int") * (zone.substr(2, 2).try_cast("int") * 60 + zone.substr(5, 2).try_cast("int"))).cast("long") * 60_000_000
        local = F.timestamp_micros(micros + offset)
        local = F.timestamp_micros(F.unix_micros(local + F.make_ym_interval(F.lit(0), months)) + more)
        return V.let([local], lambda at: _made(F.concat(text(at), zone), dt))

    def text(at: Column) -> Column:
        return F.when(dt == XSD + "date", F.date_format(at, "yyyy-MM-dd")).when(dt == XSD + "time", F.date_format(at, "HH:mm:ss")).otherwise(V.datetime_text(at))

    return V.let([F.regexp_extract(v.col["lex"], V.ZONED, 1)], moved)


for _op in "+-*/":
    BUILT[_op] = lambda x, a, b, op=_op: arithmetic(op, x(a), x(b))


def _map_number(v: Val, f: Callable[[Column, bool], Column], rounds: bool = False) -> Val:
    """A function of a number that keeps its type; ``f`` gets the column and whether it is a double, and leaves integers alone if it ``rounds``."""
    if v.deep:
        return Val("term", V.let([v.col], lambda c: V.term_of(_map_number(Val("term", c), f, rounds))), deep=True)
    n = V.number(v)
    if n is None:
        return V.null()
    if n.kind == "num":
        return Val("num", f(n.col, True), rank=n.rank, whole=n.whole if rounds else f(n.whole, False).try_cast(BIG), dec=f(n.dec, False).try_cast(DEC))
    if n.kind in ("int", "big"):
        if rounds:
            return n
        return Val("int", f(n.col, False), bits=n.bits) if n.kind == "int" and n.bits < 63 else Val("big", f(n.col.cast(BIG), False).cast(BIG))
    return Val(n.kind, f(n.col, n.kind == "dbl").cast(V.NATIVE[n.kind]))


@built("u-")
def _minus(x, a):
    return _map_number(x(a), lambda c, _: -c)


@built("u+")
def _plus(x, a):
    return _map_number(x(a), lambda c, _: c)


@built("ABS")
def _abs(x, a):
    return _map_number(x(a), lambda c, _: F.abs(c))


@built("CEIL")
def _ceil(x, a):
    return _map_number(x(a), lambda c, _: F.ceil(c), True)


@built("FLOOR")
def _floor(x, a):
    return _map_number(x(a), lambda c, _: F.floor(c), True)


@built("ROUND")
def _round(x, a):
    return _map_number(x(a), lambda c, dbl: F.floor(c + F.lit(0.5) if dbl else c.cast(DEC) + F.lit("0.5").cast("decimal(2,1)")), True)


@built("RAND")
def _rand(x):
    return Val("dbl", F.rand())


# Terms


@built("STR")
def _str(x, a):
    v = x(a)
    return Val("str", F.when(v.col["k"] != 1, V.text_of(v)) if v.kind == "term" else V.text_of(v))


@built("LANG")
def _lang(x, a):
    v = x(a)
    if v.kind == "term":
        return Val("str", F.when(v.col["k"] == LITERAL, F.coalesce(v.col["lang"], F.lit(""))))
    return Val("str", F.lit(None).cast("string") if v.kind == "iri" else F.when(v.col.isNotNull(), ""))


@built("LANGMATCHES")
def _lang_matches(x, tag, span):
    tag, span = F.lower(V.plain_text(x(tag))), F.lower(V.plain_text(x(span)))
    return Val("bool", F.when(span == "*", tag != "").otherwise((tag == span) | tag.startswith(F.concat(span, F.lit("-")))))


@built("DATATYPE")
def _datatype(x, a):
    v = x(a)
    if v.kind == "term":
        dt = F.when(v.col["lang"].isNotNull(), RDF + "langString").otherwise(F.coalesce(v.col["dt"], F.lit(XSD + "string")))
        return Val("term", make(2, F.when(v.col["k"] == LITERAL, dt)))
    if v.kind == "iri":
        return V.null()
    if v.kind == "num":
        return Val("term", make(2, V.term_of(v)["dt"]))
    return Val("term", make(2, F.when(v.col.isNotNull(), V.DATATYPES[v.kind])))


@built("IRI", "URI")
def _iri(x, a):
    v = x(a)
    if v.kind == "iri":
        return v
    text = V.plain_text(v)
    if x.base:
        text = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit(urljoin(x.base, ".")), text))
    return Val("term", F.when(v.col["k"] == 2, v.col).otherwise(make(2, text)) if v.kind == "term" else make(2, text))


@built("BNODE")
def _bnode(x, label=None):
    if label is None:
        return Val("term", make(1, F.concat(F.lit("u"), F.replace(F.uuid(), F.lit("-"), F.lit("")))))
    own = [v for n, v in sorted(x.scope.items()) if x.solution is None or n in x.solution]
    row = F.to_json(F.struct(*[V.term_of(v).alias(f"c{i}") for i, v in enumerate(own)])) if own else F.lit("")
    return Val("term", make(1, F.concat(F.lit("l"), F.md5(F.concat_ws("\t", V.plain_text(x(label)), row)))))


@built("STRDT")
def _strdt(x, a, dt):
    v, dt = x(a), x(dt)
    text = V.plain_text(v)
    iri = V.text_of(dt) if dt.kind == "iri" else F.when(dt.col["k"] == 2, dt.col["lex"]) if dt.kind == "term" else F.lit(None).cast("string")
    text = F.when(V.language(v).isNull() & iri.isNotNull(), text)
    return Val("term", make(3, text, F.when(iri != XSD + "string", iri)))


@built("STRLANG")
def _strlang(x, a, tag):
    v, tag = x(a), V.plain_text(x(tag))
    return Val("term", make(3, F.when(V.language(v).isNull() & tag.isNotNull(), V.plain_text(v)), None, F.lower(tag)))


@built("UUID")
def _uuid(x):
    return Val("term", make(2, F.concat(F.lit("urn:uuid:"), F.uuid())))


@built("STRUUID")
def _struuid(x):
    return Val("str", F.uuid())


def _is(*kinds: int):
    def f(x, a):
        v = x(a)
        if v.kind == "term":
            return Val("bool", v.col["k"].isin(*kinds))
        return Val("bool", F.when(v.col.isNotNull(), (2 if v.kind == "iri" else 3) in kinds))

    return f


BUILT |= {"ISIRI": _is(2), "ISURI": _is(2), "ISBLANK": _is(1), "ISLITERAL": _is(3)}


@built("ISNUMERIC")
def _is_numeric(x, a):
    v = x(a)
    if v.kind == "term":
        return Val("bool", F.when(v.col.isNotNull(), F.coalesce(V.number(v).rank.isNotNull(), F.lit(False))))
    return Val("bool", F.when(v.col.isNotNull(), v.kind in (*V.NUMBERS, "num")))


# Strings


def _compatible(a: Val, b: Val) -> Column:
    """Whether two strings may be compared: the second plain, or in the first one's language."""
    return V.language(b).isNull() | V.language(b).eqNullSafe(V.language(a))


@built("STRLEN")
def _strlen(x, a):
    return Val("int", F.length(V.plain_text(x(a))).cast("long"), bits=31)


@built("UCASE")
def _ucase(x, a):
    v = x(a)
    return V.string_like(v, F.upper(V.plain_text(v)))


@built("LCASE")
def _lcase(x, a):
    v = x(a)
    return V.string_like(v, F.lower(V.plain_text(v)))


def _two(f):
    def g(x, a, b):
        a, b = x(a), x(b)
        out = f(V.plain_text(a), V.plain_text(b))
        return Val("bool", out if a.kind == b.kind == "str" else F.when(_compatible(a, b), out))

    return g


BUILT |= {"CONTAINS": _two(lambda a, b: F.contains(a, b)), "STRSTARTS": _two(lambda a, b: F.startswith(a, b)), "STRENDS": _two(lambda a, b: F.endswith(a, b))}


def _around(before: bool):
    def g(x, a, b):
        a, b = x(a), x(b)
        s, t = V.plain_text(a), V.plain_text(b)
        at = F.call_function("locate", t, s)
        cut = s.substr(F.lit(1), at - 1) if before else s.substr(at + F.length(t), F.length(s))
        found = V.string_like(a, cut)
        if a.kind == "str":
            out = F.when(at > 0, cut).otherwise(F.when(at == 0, ""))
            return Val("str", out if b.kind == "str" else F.when(_compatible(a, b), out))
        return Val("term", F.when(_compatible(a, b), F.when(at > 0, found.col).when(at == 0, make(3, F.lit("")))))

    return g


BUILT |= {"STRBEFORE": _around(True), "STRAFTER": _around(False)}


@built("SUBSTR")
def _substr(x, a, start, length=None):
    v, s = x(a), V.double_of(V.number(x(start)) or V.null())
    text = V.plain_text(v)
    first = F.floor(s + 0.5)
    if length is None:
        out = text.substr(F.greatest(first, F.lit(1)).cast("int"), F.length(text))
    else:
        end = first + F.floor(V.double_of(V.number(x(length)) or V.null()) + 0.5)
        begin = F.greatest(first, F.lit(1))
        out = text.substr(begin.cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    return V.string_like(v, out)


@built("CONCAT")
def _concat(x, *args):
    vals = [x(a) for a in args]
    text = F.concat(*[V.plain_text(v) for v in vals]) if vals else F.lit("")
    if all(v.kind == "str" for v in vals):
        return Val("str", text)
    lang = V.language(vals[0])
    for v in vals[1:]:
        lang = F.when(V.language(v) == lang, lang)
    return Val("term", make(3, text, None, lang))


@built("ENCODE_FOR_URI")
def _encode(x, a):
    text = F.url_encode(V.plain_text(x(a)))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return Val("str", text)


def _unspaced(text: Column) -> Column:
    """A pattern without white space, but for that in character classes, as flag x has it."""
    return F.regexp_replace(text, r"(\[(?:[^\]\\]|\\.)*\])|[ \t\r\n]+", "$1")


def _quoted(text: Column) -> Column:
    """A pattern that matches the text itself, as flag q has it."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _pattern(x, p, flags) -> Column:
    """A pattern with its flags as an inline group; flags other than i, s, m, x and q are an error."""
    text = V.plain_text(x(p))
    if flags is None:
        return text
    if isinstance(flags, Term):
        given = set(flags.lex)
        if given - set("ismxq"):
            return F.lit(None).cast("string")
        text = _quoted(text) if "q" in given else _unspaced(text) if "x" in given else text
        keep = "".join(c for c in "ism" if c in given)
        return F.concat(F.lit(f"(?{keep})"), text) if keep else text
    given = V.plain_text(x(flags))
    text = F.when(given.contains("q"), _quoted(text)).when(given.contains("x"), _unspaced(text)).otherwise(text)
    keep = F.regexp_replace(given, "[^ism]", "")
    return F.when(given.rlike("^[ismxq]*$"), F.concat(F.when(keep == "", "").otherwise(F.concat(F.lit("(?"), keep, F.lit(")"))), text))


def _replacement(x, r, flags) -> Column:
    """What matches are replaced by: the text itself under flag q."""
    text = V.plain_text(x(r))
    if flags is None or (isinstance(flags, Term) and "q" not in flags.lex):
        return text
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return plain if isinstance(flags, Term) else F.when(V.plain_text(x(flags)).contains("q"), plain).otherwise(text)


@built("REGEX")
def _regex(x, a, p, flags=None):
    return Val("bool", F.regexp_like(V.plain_text(x(a)), _pattern(x, p, flags)))


@built("REPLACE")
def _replace(x, a, p, r, flags=None):
    v = x(a)
    return V.string_like(v, F.regexp_replace(V.plain_text(v), _pattern(x, p, flags), _replacement(x, r, flags)))


def _hash(f):
    def g(x, a):
        v = x(a)
        text = V.plain_text(v)
        return Val("str", f(F.when(V.language(v).isNull(), text).cast("binary") if v.kind == "term" else text.cast("binary")))

    return g


BUILT |= {"MD5": _hash(F.md5), "SHA1": _hash(F.sha1)} | {f"SHA{n}": _hash(lambda c, n=n: F.sha2(c, n)) for n in (256, 384, 512)}


# Dates


@built("NOW")
def _now(x):
    return Val("term", lit(Term(LITERAL, x.now.isoformat(), XSD + "dateTime")))


def _part(group: int, native, time: bool):
    pattern = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2}(?:\.[0-9]+)?))?(Z|[+-][0-9]{2}:[0-9]{2})?$"

    def g(x, a):
        v = x(a)
        if v.kind == "dtm":
            return Val("dec", native(v.col).cast(DEC)) if group == 6 else Val("int", native(v.col).cast("long"), bits=31)
        if v.kind != "term":
            return V.null()
        types = [XSD + "dateTime"] if time else [XSD + "dateTime", XSD + "date"]
        text = F.when(v.col["dt"].isin(types), F.regexp_extract(v.col["lex"], pattern, group))
        return Val("dec", text.try_cast(DEC)) if group == 6 else Val("int", text.try_cast("long"))

    return g


BUILT |= {
    "YEAR": _part(1, F.year, False),
    "MONTH": _part(2, F.month, False),
    "DAY": _part(3, F.dayofmonth, False),
    "HOURS": _part(4, F.hour, True),
    "MINUTES": _part(5, F.minute, True),
    "SECONDS": _part(6, lambda c: F.extract(F.lit("SECOND"), c), True),
}


@built("TZ")
def _tz(x, a):
    v = x(a)
    if v.kind == "dtm":
        return Val("str", F.when(v.col.isNotNull(), ""))
    return Val("str", F.when(v.col["dt"] == XSD + "dateTime", F.regexp_extract(v.col["lex"], V.ZONED, 1))) if v.kind == "term" else V.null()


@built("TIMEZONE")
def _timezone(x, a):
    v = x(a)
    if v.kind != "term":
        return V.null()
    zone = F.when(v.col["dt"] == XSD + "dateTime", F.regexp_extract(v.col["lex"], V.ZONED, 1))
    minutes = F.concat(zone.substr(1, 1), F.lit("1")).try_cast("int") * (zone.substr(2, 2).try_cast("int") * 60 + zone.substr(5, 2).try_cast("int"))
    return Val("term", make(3, F.when(zone == "Z", "PT0S").when(zone != "", duration_text(minutes.cast("long") * 60_000_000)), XSD + "dayTimeDuration"))


# Casts


def _cast_string(v: Val) -> Val:
    return Val("str", F.when(v.col["k"] != 1, v.col["lex"]) if v.kind == "term" else V.text_of(v))


def _truncated(c: Column) -> Column:
    """A decimal or double without what is after its point; doubles beyond a long have nothing there."""
    return F.coalesce(c.try_cast("long").cast(BIG), F.when(c < 0, F.ceil(c.try_cast(DEC))).otherwise(F.floor(c.try_cast(DEC))).cast(BIG), c.try_cast(BIG))


def _cast_number(kind: str):
    pattern = {"big": V.INTEGER_TEXT, "dec": V.DECIMAL_TEXT, "dbl": V.DOUBLE_TEXT}[kind]
    to = V.NATIVE[kind]
    narrow = _truncated if kind == "big" else lambda c: c.try_cast(to)

    def from_text(text: Column) -> Column:
        return F.when(text.rlike(pattern), F.regexp_replace(F.trim(text), "INF", "Infinity").try_cast(to))

    def g(v: Val) -> Val:
        if v.kind == "bool":
            return Val(kind, v.col.cast("int").cast(to))
        if v.kind == "str":
            return Val(kind, from_text(v.col))
        if v.kind in ("int", "big"):
            return v if kind == "big" else Val(kind, v.col.try_cast(to))
        if v.kind in V.NUMBERS:
            return Val(kind, narrow(v.col))
        if v.kind == "num":
            return Val(kind, F.coalesce(v.whole.try_cast(to), narrow(v.dec), narrow(v.col)))
        if v.kind != "term":
            return V.null()
        n, dt = V.number(v), v.col["dt"]
        boolean = F.when(v.col["lex"].isin("true", "1"), 1).when(v.col["lex"].isin("false", "0"), 0).cast(to)
        number = F.coalesce(n.whole.try_cast(to), narrow(n.dec), narrow(n.col))
        return Val(kind, F.when((v.col["k"] == LITERAL) & dt.isNull() & v.col["lang"].isNull(), from_text(v.col["lex"])).when(dt == XSD + "boolean", boolean).when(n.rank.isNotNull(), number))

    return g


def _cast_boolean(v: Val) -> Val:
    if v.kind == "bool":
        return v
    if v.kind in V.NUMBERS:
        return Val("bool", V.truth(v))
    t = V.as_term(v).col
    n = V.number(Val("term", t))
    known = (t["k"] == LITERAL) & (t["dt"].isNull() | (t["dt"] == XSD + "boolean")) & t["lang"].isNull()
    return Val("bool", F.when(known, F.when(t["lex"].isin("true", "1"), True).when(t["lex"].isin("false", "0"), False)).when(n.rank.isNotNull(), (n.col != 0) & ~F.isnan(n.col)))


def _cast_datetime(name: str, pattern: str):
    def g(v: Val) -> Val:
        if v.kind == "dtm" and name == "dateTime":
            return v
        t = V.as_term(v).col
        ok = (t["k"] == LITERAL) & t["lang"].isNull() & (t["dt"].isNull() | t["dt"].isin(XSD + "dateTime", XSD + name)) & t["lex"].rlike(pattern)
        text = F.regexp_extract(t["lex"], r"^[^T]*", 0) if name == "date" else t["lex"]
        return Val("term", make(3, F.when(ok, text), XSD + name))

    return g


CASTS = {
    XSD + "string": _cast_string,
    XSD + "integer": _cast_number("big"),
    XSD + "decimal": _cast_number("dec"),
    XSD + "double": _cast_number("dbl"),
    XSD + "float": lambda v: Val("term", make(3, V.text_of(_cast_number("dbl")(v)), XSD + "float")),
    XSD + "boolean": _cast_boolean,
    XSD + "dateTime": _cast_datetime("dateTime", r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"),
    XSD + "date": _cast_datetime("date", r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"),
}

