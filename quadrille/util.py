"""Small helpers of the host language."""

from __future__ import annotations

import calendar
import time as _time
from collections.abc import Hashable, Iterable
from itertools import islice

from .sources.readers import guess_format
from .terms import BNode, IRI, Literal, Term, parse_term


def unique(items: Iterable[Hashable]) -> list:
    """Without repeats, in order."""
    return list(dict.fromkeys(items))


def more_than(items: Iterable, number: int) -> bool:
    """Whether there are more; looks at no more than it needs."""
    return len(list(islice(items, number + 1))) > number


def to_term(text: str | None, default: Term | None = None) -> Term | None:
    """``<iri>``, ``"literal"`` or ``_blank``; anything else is an error."""
    if not text:
        return default
    if text.startswith("<") and text.endswith(">"):
        return IRI(text[1:-1])
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return Literal(text[1:-1])
    if text.startswith("_"):
        return BNode(text.lstrip("_:"))
    raise ValueError(f"not a term: {text!r}")


def date_time(seconds: float | None = None, local: bool = False) -> str:
    """Epoch seconds as a W3C date and time, in UTC or the local zone."""
    seconds = _time.time() if seconds is None else seconds
    if not local:
        return _time.strftime("%Y-%m-%dT%H:%M:%SZ", _time.gmtime(seconds))
    at = _time.localtime(seconds)
    sign, minutes = "-" if at.tm_gmtoff < 0 else "+", abs(at.tm_gmtoff) // 60
    return f"{_time.strftime('%Y-%m-%dT%H:%M:%S', at)}{sign}{minutes // 60:02d}:{minutes % 60:02d}"


def parse_date_time(text: str) -> int:
    """Epoch seconds of a W3C date, or date and time; without a zone it is UTC."""
    day, _, clock = text.partition("T")
    clock, offset = clock or "00:00:00Z", 0
    if clock.endswith("Z"):
        clock = clock[:-1]
    elif (at := max(clock.rfind("+"), clock.rfind("-"))) > 0:
        hours, minutes = clock[at + 1 :].split(":")
        offset = (int(hours) * 3600 + int(minutes) * 60) * (-1 if clock[at] == "-" else 1)
        clock = clock[:at]
    year, month, date = (int(x) for x in (day.split("-") + ["1", "1"])[:3])
    hour, minute, second = (clock.split(":") + ["0", "0"])[:3]
    return calendar.timegm((year, month, date, int(hour), int(minute), int(float(second)))) - offset


__all__ = ["date_time", "guess_format", "more_than", "parse_date_time", "parse_term", "to_term", "unique"]
