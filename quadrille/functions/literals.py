"""Arithmetic and canonical forms of single literals on the driver."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from decimal import Decimal

from ..terms import LITERAL, XSD, Literal, Term, format_duration, parse_duration

DURATIONS = (XSD + "duration", XSD + "dayTimeDuration", XSD + "yearMonthDuration")
#: Parsers and formatters of further datatypes, by IRI.
DATATYPES: dict[str, tuple[Callable[[str], object], Callable[[object], str]]] = {}


def bind_datatype(iri: str, parse: Callable[[str], object], format: Callable[[object], str] = str) -> None:
    DATATYPES[iri] = parse, format


def reset_datatypes() -> None:
    DATATYPES.clear()


def value(t: Term):
    """The Python value, further datatypes included; durations are (months, microseconds)."""
    if t.dt in DATATYPES:
        return DATATYPES[t.dt][0](t.lex)
    if t.dt in DURATIONS:
        return parse_duration(t.lex)
    return t.value()


def normalize(t: Term) -> Term:
    """The literal with the canonical text of its value; ill-typed ones stay."""
    if t.k != LITERAL or t.dt is None:
        return t
    if t.dt in DATATYPES:
        parse, write = DATATYPES[t.dt]
        return t._replace(lex=write(parse(t.lex)))
    v = value(t)
    if isinstance(v, str):
        return t
    if t.dt in DURATIONS:
        return t._replace(lex=format_duration(*v))
    if isinstance(v, Decimal):
        text = format(v, "f")
        return t._replace(lex=text.rstrip("0").rstrip(".") if "." in text else text)
    return Literal(v, datatype=t.dt)


def _shift(when, months: int, micros: int):
    """A date or time moved by months, days clamped to the month's length, then by microseconds."""
    if months:
        year, month = divmod(when.year * 12 + when.month - 1 + months, 12)
        for day in range(when.day, 27, -1) if when.day > 28 else (when.day,):
            try:
                when = when.replace(year=year, month=month + 1, day=day)
                break
            except ValueError:
                continue
    return when + _dt.timedelta(microseconds=micros)


def add(a: Term, b: Term, sign: int = 1) -> Term:
    """a + b, or a - b: numbers, dates and durations; other literals of one type are joined as text."""
    x, y = value(a), value(b)
    numbers = (int, float, Decimal)
    if isinstance(x, numbers) and isinstance(y, numbers) and not isinstance(x, bool) and not isinstance(y, bool):
        if float in (type(x), type(y)):
            return Literal(float(x) + sign * float(y))
        return Literal(x + sign * y, datatype=a.dt if a.dt == b.dt else None)
    if b.dt in DURATIONS and isinstance(x, (_dt.date, _dt.datetime)):
        return Literal(_shift(x, sign * y[0], sign * y[1]), datatype=a.dt)
    if a.dt in DURATIONS and b.dt in DURATIONS:
        months, micros = x[0] + sign * y[0], x[1] + sign * y[1]
        return Literal(format_duration(months, micros), datatype=a.dt if a.dt == b.dt else XSD + "duration")
    if sign < 0:
        if isinstance(x, (_dt.date, _dt.datetime)) and type(x) is type(y):
            return Literal(x - y)
        raise TypeError(f"{a.n3()} - {b.n3()}")
    if isinstance(x, str) and isinstance(y, str) and a.dt == b.dt:
        return a._replace(lex=a.lex + b.lex)
    raise TypeError(f"{a.n3()} + {b.n3()}")


def subtract(a: Term, b: Term) -> Term:
    return add(a, b, -1)


def _number(t: Term):
    v = value(t)
    if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
        raise TypeError(f"{t.n3()} is no number")
    return v


def negate(t: Term) -> Term:
    return Literal(-_number(t), datatype=t.dt)


def absolute(t: Term) -> Term:
    return Literal(abs(_number(t)), datatype=t.dt)


def invert(t: Term) -> Term:
    return Literal(~_number(t), datatype=t.dt)
