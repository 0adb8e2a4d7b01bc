"""Values of expressions and variables: a column, and what is known of it before any row is read.

A value of kind ``term`` is a term struct of any kind. The other kinds are native columns whose terms
have one datatype, so arithmetic, comparison, joins and sorts on them stay native: ``int`` (long),
``big`` (decimal(38,0), an integer that may not fit a long), ``dec`` (decimal(38,18)), ``dbl`` (double), ``str``, ``bool``, ``dtm`` (timestamp without zone) and ``iri``
(``prefix`` and a key column). ``num`` is a number whose type is known by row only: its rank (0 integer,
1 decimal, 2 float, 3 double) and an integer, a decimal and a double lane. NULL is unbound or, in expressions, an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import INTEGERS, LITERAL, XSD, Term, lit, make

DEC, BIG = "decimal(38,18)", "decimal(38,0)"
NATIVE = {"int": "long", "big": BIG, "dec": DEC, "dbl": "double"}
DATATYPES = {"int": XSD + "integer", "big": XSD + "integer", "dec": XSD + "decimal", "dbl": XSD + "double", "bool": XSD + "boolean", "dtm": XSD + "dateTime", "str": XSD + "string"}
NUMBERS = ("int", "big", "dec", "dbl")
INTEGER_TEXT, DECIMAL_TEXT = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"
DOUBLE_TEXT = r"^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)\s*$"


@dataclass
class Val:
    kind: str
    col: Column
    prefix: str = ""
    bits: int = 63  # of int: no value is beyond 2 to this power
    rank: Column | None = None  # of num
    whole: Column | None = None  # of num, where its rank is 0
    dec: Column | None = None  # of num; col is its double lane
    deep: bool = False  # a computed term, to be named before it is read many times
    missing: bool = False  # never bound
    fixed: bool = False  # a constant in term form

    def named(self, name: str) -> Val:
        return Val(self.kind, F.col(f"`{name}`"), self.prefix, self.bits)

    def same_form(self, other: Val) -> bool:
        return self.kind == other.kind and self.kind != "num" and self.prefix == other.prefix


def let(cols: list[Column], f) -> Column:
    """``f`` of named columns, so that long expressions appear once however often ``f`` reads them."""
    row = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cols)])
    return F.element_at(F.transform(F.array(row), lambda r: f(*[r[f"v{i}"] for i in range(len(cols))])), 1)


def null() -> Val:
    return Val("term", lit(None), missing=True)


def constant(t: Term) -> Val:
    """The value of a term; numbers, strings and booleans in native form where their text is the canonical one."""
    if t.k == LITERAL and not t.lang:
        v = t.value()
        if t.dt is None:
            return Val("str", F.lit(t.lex))
        if t.dt == XSD + "integer" and isinstance(v, int) and abs(v) < 10**38 and str(v) == t.lex:
            return Val("int", F.lit(v).cast("long"), bits=v.bit_length()) if abs(v) < 2**63 else Val("big", F.lit(t.lex).cast(BIG))
        if t.dt == XSD + "double" and isinstance(v, float):
            return Val("dbl", F.lit(v))
        if t.dt == XSD + "decimal" and isinstance(v, Decimal) and abs(v) < 10**18:
            return Val("dec", F.lit(t.lex).cast(DEC))
        if t.dt == XSD + "boolean" and t.lex in ("true", "false"):
            return Val("bool", F.lit(t.lex == "true"))
    return Val("term", lit(t), fixed=True)


def decimal_text(c: Column) -> Column:
    """A decimal without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def datetime_text(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""))


def double_text(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text == "Infinity", "INF").when(text == "-Infinity", "-INF").otherwise(text)


def text_of(v: Val) -> Column:
    """The lexical form, or the IRI."""
    match v.kind:
        case "term":
            return v.col["lex"]
        case "iri":
            return F.concat(F.lit(v.prefix), v.col.cast("string"))
        case "dbl":
            return double_text(v.col)
        case "dec":
            return decimal_text(v.col)
        case "dtm":
            return datetime_text(v.col)
        case "num":
            return F.when(v.rank == 0, v.whole.cast("string")).when(v.rank == 1, decimal_text(v.dec)).when(v.rank > 1, double_text(v.col))
    return v.col.cast("string")


def term_of(v: Val) -> Column:
    match v.kind:
        case "term":
            return v.col
        case "iri":
            return make(2, text_of(v))
        case "str":
            return make(3, v.col)
        case "num":
            names = F.array(*[F.lit(XSD + n) for n in ("integer", "decimal", "float", "double")])
            return make(3, text_of(v), F.element_at(names, v.rank + 1))
    return make(3, text_of(v), DATATYPES[v.kind])


def as_term(v: Val) -> Val:
    return v if v.kind == "term" else Val("term", term_of(v))


def unify(vals: list[Val]) -> list[Val]:
    """The values in one common form."""
    known = [v for v in vals if not v.missing]
    if known and all(v.same_form(known[0]) for v in known):
        return [Val(known[0].kind, F.lit(None), known[0].prefix) if v.missing else v for v in vals]
    if known and all(v.kind in ("int", "big") for v in known):
        return [Val("big", v.col.cast(BIG)) for v in vals]
    return [as_term(v) for v in vals]


def number(v: Val) -> Val | None:
    """The value as a number of kind int, dec, dbl or num; None if it can't be one."""
    if v.kind in (*NUMBERS, "num"):
        return v
    if v.kind != "term":
        return None
    lex, dt = v.col["lex"], v.col["dt"]
    rank = (
        F.when(dt.isin(INTEGERS) & lex.rlike(INTEGER_TEXT), 0)
        .when((dt == XSD + "decimal") & lex.rlike(DECIMAL_TEXT), 1)
        .when((dt == XSD + "float") & lex.rlike(DOUBLE_TEXT), 2)
        .when((dt == XSD + "double") & lex.rlike(DOUBLE_TEXT), 3)
    )
    text = F.regexp_replace(F.trim(lex), "INF", "Infinity")
    whole, dec = F.when(rank == 0, F.trim(lex).try_cast(BIG)), F.when(rank < 2, F.trim(lex).try_cast(DEC))
    return Val("num", F.when(rank.isNotNull(), text.try_cast("double")), rank=rank, whole=whole, dec=dec)


def widen(v: Val) -> Val:
    """A number as kind num."""
    if v.kind == "num":
        return v
    rank = F.lit({"int": 0, "big": 0, "dec": 1, "dbl": 3}[v.kind])
    none = F.lit(None)
    whole = v.col.cast(BIG) if v.kind in ("int", "big") else none.cast(BIG)
    return Val("num", v.col.cast("double"), rank=F.when(v.col.isNotNull(), rank), whole=whole, dec=none.cast(DEC) if v.kind == "dbl" else v.col.try_cast(DEC))


def double_of(v: Val) -> Column:
    return v.col if v.kind in ("dbl", "num") else v.col.cast("double")


def truth(v: Val) -> Column:
    """The effective boolean value; NULL is an error."""
    match v.kind:
        case "bool":
            return v.col
        case "str":
            return F.length(v.col) > 0
        case "int" | "big" | "dec":
            return v.col != 0
        case "dbl":
            return (v.col != 0) & ~F.isnan(v.col)
        case "num":
            return (v.col != 0) & ~F.isnan(v.col)
        case "term":
            if v.deep:
                return let([v.col], lambda c: truth(Val("term", c)))
            lex, dt, n = v.col["lex"], v.col["dt"], number(v)
            known = dt.isin([*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"])
            return F.when(v.col["k"] == LITERAL, F.when(dt.isNull(), F.length(lex) > 0).when(dt == XSD + "boolean", lex.isin("true", "1")).when(known, F.coalesce((n.col != 0) & ~F.isnan(n.col), F.lit(False))))
    return F.lit(None).cast("boolean")


def plain_text(v: Val) -> Column:
    """The text of a string literal, with a language or without; NULL for anything else."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == LITERAL) & v.col["dt"].isNull(), v.col["lex"])
    return F.lit(None).cast("string")


def language(v: Val) -> Column:
    return v.col["lang"] if v.kind == "term" else F.lit(None).cast("string")


def string_like(v: Val, text: Column) -> Val:
    """New text with the language of a string value."""
    return Val("str", text) if v.kind == "str" else Val("term", make(3, text, None, language(v)))


#: Datatypes whose values compare as instants.
INSTANTS = (XSD + "dateTime", XSD + "date", XSD + "time")
ZONED = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def instant(v: Val) -> tuple[Column, Column, Column]:
    """(microseconds, whether it has a zone, datatype) of a dateTime, date or time."""
    if v.kind == "dtm":
        return F.unix_micros(v.col.cast("timestamp")), F.lit(False), F.lit(XSD + "dateTime")
    if v.kind != "term":
        none = F.lit(None)
        return none.cast("long"), none.cast("boolean"), none.cast("string")
    lex, dt = v.col["lex"], v.col["dt"]
    text = F.when(dt == XSD + "dateTime", lex).when(dt == XSD + "date", F.regexp_replace(lex, r"^(-?[0-9]{4,}-[0-9]{2}-[0-9]{2})", "$1T00:00:00")).when(dt == XSD + "time", F.concat(F.lit("1970-01-01T"), lex))
    zoned = lex.rlike(ZONED)
    naive = F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(naive.try_cast("timestamp")), zoned, F.when(dt.isin(*INSTANTS), dt)


def sort_key(v: Val) -> Column:
    """A native column that sorts as ORDER BY and MIN want: unbound, blank nodes, IRIs, literals."""
    if v.kind == "iri":
        return F.concat(F.lit(v.prefix), v.col.cast("string"))
    if v.kind == "num":
        return v.col
    if v.kind != "term":
        return v.col
    if v.deep:
        return let([v.col], lambda c: sort_key(Val("term", c)))
    n, (micros, _, _) = number(v), instant(v)
    dt = F.when(n.rank.isNotNull(), "").otherwise(F.coalesce(v.col["dt"], F.lit(XSD + "string")))
    key = F.struct(v.col["k"].alias("k"), dt.alias("dt"), F.coalesce(v.col["lang"], F.lit("")).alias("lang"), n.col.alias("n"), n.dec.alias("dec"), n.whole.alias("whole"), micros.alias("t"), v.col["lex"].alias("lex"))
    return F.when(v.col.isNotNull(), key)


def equal_terms(a: Val, b: Val) -> Column:
    """Whether two values are the same term."""
    a, b = unify([a, b])
    return a.col == b.col


