"""RDF terms: plain Python values on the driver, structs of four fields in DataFrames.

A term column is ``struct<k tinyint, lex string, dt string, lang string>``; k is 1 for a blank node, 2
for an IRI, 3 for a literal. A literal without a datatype is an xsd:string (the two are one term), and
language tags are lower case. NULL stands for an unbound variable.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from decimal import Decimal
from typing import NamedTuple
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

BNODE, IRI_KIND, LITERAL = 1, 2, 3
TERM = "struct<k:tinyint,lex:string,dt:string,lang:string>"
QUAD = ", ".join(f"{c} {TERM}" for c in "spog")

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
GENID = "/.well-known/genid/"

#: Integer types in the order of the specification, with the range that each allows.
INTEGER_TYPES = {
    "integer": (None, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127),
    "nonNegativeInteger": (0, None),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 255),
    "positiveInteger": (1, None),
}
INTEGERS = [XSD + t for t in INTEGER_TYPES]
NUMERIC = [*INTEGERS, XSD + "decimal", XSD + "float", XSD + "double"]


class Term(NamedTuple):
    k: int
    lex: str
    dt: str | None = None
    lang: str | None = None

    def n3(self, prefixes: dict[str, str] | None = None) -> str:
        """The term in Turtle syntax, with a prefix where one fits."""
        if self.k == BNODE:
            return f"_:{self.lex}"
        if self.k == IRI_KIND:
            return shorten(self.lex, prefixes) or f"<{escape_iri(self.lex)}>"
        text = f'"{escape(self.lex)}"'
        if self.lang:
            return f"{text}@{self.lang}"
        return f"{text}^^{IRI(self.dt).n3(prefixes)}" if self.dt else text

    def value(self):
        """The Python value of a literal; the term's text if it has none."""
        if self.k != LITERAL or self.dt is None:
            return self.lex
        local = self.dt.removeprefix(XSD) if self.dt.startswith(XSD) else None
        try:
            if local in INTEGER_TYPES:
                return int(self.lex)
            if local == "decimal":
                return Decimal(self.lex)
            if local in ("double", "float"):
                return float(self.lex.replace("INF", "inf"))
            if local == "boolean":
                return {"true": True, "1": True, "false": False, "0": False}[self.lex.strip()]
            if local == "dateTime":
                return _dt.datetime.fromisoformat(self.lex)
            if local == "date":
                return _dt.date.fromisoformat(self.lex[:10])
            if local == "time":
                return _dt.time.fromisoformat(self.lex)
            if local == "hexBinary":
                return bytes.fromhex(self.lex)
        except (ValueError, KeyError, ArithmeticError):
            pass
        return self.lex

    def is_well_typed(self) -> bool:
        """Whether a literal's text is in its datatype's lexical space, ranges included."""
        if self.k != LITERAL or not (self.dt or "").startswith(XSD):
            return True
        local = self.dt.removeprefix(XSD)
        if local in INTEGER_TYPES:
            if not re.fullmatch(r"[+-]?[0-9]+", self.lex.strip()):
                return False
            low, high = INTEGER_TYPES[local]
            return (low is None or int(self.lex) >= low) and (high is None or int(self.lex) <= high)
        known = ("decimal", "double", "float", "boolean", "dateTime", "date", "time", "hexBinary")
        return local not in known or not isinstance(self.value(), str)


class Var(NamedTuple):
    name: str

    def n3(self, prefixes=None) -> str:
        return f"?{self.name}"


ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:").match


def resolve(base: str | None, text: str) -> str:
    """An IRI reference against a base; an absolute one stays as it is, an empty fragment is kept."""
    if not base or ABSOLUTE(text):
        return text
    out = urljoin(base, text)
    return out + "#" if text.endswith("#") and not out.endswith("#") else out


def IRI(text: str, base: str | None = None) -> Term:  # noqa: N802
    return Term(IRI_KIND, resolve(base, text))


def BNode(label: str | None = None) -> Term:  # noqa: N802
    return Term(BNODE, label or "b" + uuid.uuid4().hex)


def Literal(value, lang: str | None = None, datatype: str | Term | None = None) -> Term:  # noqa: N802
    """A literal of a Python value; the datatype follows the value unless one is given."""
    dt = datatype.lex if isinstance(datatype, Term) else datatype
    if isinstance(value, str):
        pass
    elif isinstance(value, bool):
        value, dt = str(value).lower(), dt or XSD + "boolean"
    elif isinstance(value, int):
        value, dt = str(value), dt or XSD + "integer"
    elif isinstance(value, float):
        value, dt = repr(value).replace("inf", "INF").replace("nan", "NaN"), dt or XSD + "double"
    elif isinstance(value, Decimal):
        value, dt = format(value, "f"), dt or XSD + "decimal"
    elif isinstance(value, _dt.datetime):
        value, dt = value.isoformat(), dt or XSD + "dateTime"
    elif isinstance(value, _dt.date):
        value, dt = value.isoformat(), dt or XSD + "date"
    elif isinstance(value, _dt.time):
        value, dt = value.isoformat(), dt or XSD + "time"
    elif isinstance(value, _dt.timedelta):
        value, dt = format_duration(0, value / _dt.timedelta(microseconds=1)), dt or XSD + "dayTimeDuration"
    elif isinstance(value, bytes):
        value, dt = value.hex().upper(), dt or XSD + "hexBinary"
    if dt == XSD + "normalizedString":
        value = re.sub(r"[\t\n\r]", " ", value)
    elif dt == XSD + "token":
        value = " ".join(value.split())
    if lang:
        return Term(LITERAL, value, None, lang.lower())
    return Term(LITERAL, value, None if dt in (None, XSD + "string") else dt)


def format_duration(months: int, micros: float) -> str:
    """An ISO 8601 duration of months and microseconds."""
    sign = "-" if months < 0 or micros < 0 else ""
    months, micros = abs(int(months)), abs(round(micros))
    years, months = divmod(months, 12)
    seconds, micros = divmod(micros, 1_000_000)
    days, seconds = divmod(seconds, 86_400)
    hours, seconds = divmod(seconds, 3600)
    minutes, seconds = divmod(seconds, 60)
    date = "".join(f"{n}{u}" for n, u in ((years, "Y"), (months, "M"), (days, "D")) if n)
    second = f"{seconds}.{micros:06d}".rstrip("0") if micros else str(seconds)
    time = "".join(f"{n}{u}" for n, u in ((hours, "H"), (minutes, "M")) if n) + (f"{second}S" if seconds or micros else "")
    return f"{sign}P{date}{'T' + time if time else ''}" if date or time else "PT0S"


def parse_duration(text: str) -> tuple[int, int]:
    """(months, microseconds) of an ISO 8601 duration."""
    m = re.fullmatch(r"(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m or text.endswith(("P", "T")):
        raise ValueError(f"not a duration: {text!r}")
    sign = -1 if m[1] else 1
    y, mo, w, d, h, mi = (int(x or 0) for x in m.groups()[1:7])
    micros = ((w * 7 + d) * 86_400 + h * 3600 + mi * 60) * 1_000_000 + int(Decimal(m[8] or 0) * 1_000_000)
    return sign * (12 * y + mo), sign * micros


ESCAPES = {"\t": "\\t", "\b": "\\b", "\n": "\\n", "\r": "\\r", "\f": "\\f", '"': '\\"', "\\": "\\\\"}


def escape(text: str) -> str:
    return re.sub(r'[\t\b\n\r\f"\\]', lambda m: ESCAPES[m[0]], text)


def escape_iri(text: str) -> str:
    return re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", text)


def unescape(text: str) -> str:
    """Decode the escapes of Turtle and SPARQL strings."""
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text) if "\\" in text else text


LOCAL = re.compile(r"[A-Za-z_0-9](?:[\w.\-]*[\w\-])?")


def shorten(iri: str, prefixes: dict[str, str] | None) -> str | None:
    """prefix:local by the longest namespace that fits, or None."""
    best = max((n for n in (prefixes or {}).values() if n and iri.startswith(n) and LOCAL.fullmatch(iri[len(n) :])), key=len, default=None)
    if best is None:
        return None
    return f"{next(p for p, n in prefixes.items() if n == best)}:{iri[len(best):]}"


def parse_term(text: str, prefixes: dict[str, str] | None = None) -> Term | None:
    """One term in Turtle syntax; empty text is None."""
    text = text.strip()
    if not text:
        return None
    if text[0] == "<":
        return IRI(unescape(text[1:-1]))
    if text.startswith("_:"):
        return BNode(text[2:])
    if text[0] in "\"'":
        m = re.fullmatch(r"""('''|\"\"\"|'|")(.*)\1(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^(.+))?""", text, re.S)
        if not m:
            raise ValueError(f"not a term: {text!r}")
        return Literal(unescape(m[2]), m[3], parse_term(m[4], prefixes) if m[4] else None)
    if text in ("true", "false"):
        return Literal(text, datatype=XSD + "boolean")
    if re.fullmatch(r"[+-]?\d+", text):
        return Literal(text, datatype=XSD + "integer")
    if re.fullmatch(r"[+-]?\d*\.\d+", text):
        return Literal(text, datatype=XSD + "decimal")
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+", text):
        return Literal(text, datatype=XSD + "double")
    prefix, colon, local = text.partition(":")
    if colon and prefix in (prefixes or {}):
        return IRI(prefixes[prefix] + local)
    raise ValueError(f"not a term: {text!r}")


# Columns


def lit(term: Term | None) -> Column:
    """A term column of one value."""
    if term is None:
        return F.lit(None).cast(TERM)
    return F.struct(F.lit(term.k).cast("tinyint").alias("k"), F.lit(term.lex).alias("lex"), F.lit(term.dt).cast("string").alias("dt"), F.lit(term.lang).cast("string").alias("lang"))


def make(k: int, lex: Column, dt: Column | str | None = None, lang: Column | None = None) -> Column:
    """A term column; NULL where the text is."""
    dt = F.lit(dt).cast("string") if dt is None or isinstance(dt, str) else dt
    lang = F.lit(None).cast("string") if lang is None else lang
    return F.when(lex.isNotNull(), F.struct(F.lit(k).cast("tinyint").alias("k"), lex.alias("lex"), dt.alias("dt"), lang.alias("lang")))


def equal(column: Column, term: Term) -> Column:
    """Whether a term column holds this very term, field by field so that scans can use it."""
    out = (column["k"] == term.k) & (column["lex"] == term.lex)
    if term.k == LITERAL:
        out &= (column["dt"] == term.dt) if term.dt else column["dt"].isNull()
        out &= (column["lang"] == term.lang) if term.lang else column["lang"].isNull()
    return out


def n3(column: Column) -> Column:
    """Term columns as N-Triples text."""
    text = column["lex"]
    for char in '\\"\n\r\t\b\f':
        text = F.replace(text, F.lit(char), F.lit(ESCAPES[char]))
    suffix = F.when(column["lang"].isNotNull(), F.concat(F.lit("@"), column["lang"])).when(column["dt"].isNotNull(), F.concat(F.lit("^^<"), column["dt"], F.lit(">"))).otherwise("")
    return F.when(column["k"] == IRI_KIND, F.concat(F.lit("<"), column["lex"], F.lit(">"))).when(column["k"] == BNODE, F.concat(F.lit("_:"), column["lex"])).otherwise(F.concat(F.lit('"'), text, F.lit('"'), suffix))


def term_schema(*names: str) -> str:
    """The schema of a DataFrame of term columns."""
    return ", ".join(f"{n} {TERM}" for n in names)
