"""Documents to quads. Line formats are read and parsed by the JVM in parallel, others a file to a task."""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..terms import LITERAL, RDF, XSD, Term, lit, make, term_schema
from .jsonld import parse_jsonld
from .rdfxml import parse_rdfxml, parse_trix
from .turtle import TurtleParser

NOTHING = (None,) * len(Term._fields)
#: Quads in a batch that a parser hands on.
ROWS = 10_000

#: Formats by file extension.
EXTENSIONS = {
    "nt": "nt", "ntriples": "nt", "nq": "nquads", "nquads": "nquads", "hext": "hext", "ndjson": "hext", "rdp": "patch", "patch": "patch",
    "ttl": "turtle", "turtle": "turtle", "trig": "trig", "n3": "n3", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "rdfs": "rdfxml", "trix": "trix", "jsonld": "jsonld", "json-ld": "jsonld", "json": "jsonld",
}
ALIASES = {
    "application/json": "jsonld", "application/xhtml+xml": "jsonld", "text/html": "jsonld",
    "nt11": "nt", "application/n-triples": "nt", "application/n-quads": "nquads", "text/turtle": "turtle", "ttl": "turtle", "longturtle": "turtle", "text/n3": "n3", "application/trig": "trig",
    "xml": "rdfxml", "pretty-xml": "rdfxml", "application/rdf+xml": "rdfxml", "application/trix": "trix", "json-ld": "jsonld", "application/ld+json": "jsonld", "application/x-ndjson": "hext",
}

#: Parsers of ``(text, base, scope of blank nodes, scope of labels or None)``.
DOCUMENTS: dict[str, Callable[..., Iterator[tuple]]] = {
    "turtle": lambda text, base, scope, labels=None: TurtleParser(text, base, scope, "turtle", labels).parse(),
    "trig": lambda text, base, scope, labels=None: TurtleParser(text, base, scope, "trig", labels).parse(),
    "n3": lambda text, base, scope, labels=None: TurtleParser(text, base, scope, "n3", labels).parse(),
    "rdfxml": lambda text, base, scope, labels=None: parse_rdfxml(text, base, scope, labels),
    "trix": lambda text, base, scope, labels=None: parse_trix(text, base, scope, labels),
    "jsonld": lambda text, base, scope, labels=None, loader=None: parse_jsonld(text, base, scope, loader, labels),
}
LINES: dict[str, Callable[[DataFrame, Column], DataFrame]] = {}


def guess_format(path: str, default: str = "turtle") -> str:
    return EXTENSIONS.get(os.path.splitext(path)[1].lstrip(".").lower(), default)


def read(spark: SparkSession, path: str, form: str | None = None, base: str | None = None, strict: bool = True, shared: bool = False) -> DataFrame:
    """Quads (s, p, o, g) of the files at a path, or of documents at http IRIs; blank node labels are kept apart by file.

    ``shared`` takes a label to mean one node in all files, as in the parts of a folder that ``write``
    made. ``strict`` raises on a line that is not of the format; without it such lines are left out.
    """
    from .web import is_web, read_web

    if is_web(path):
        return read_web(spark, path, form, base, strict)
    form = ALIASES.get(form, form) or guess_format(path)
    if form in LINES:
        name = F.lit("") if shared and form != "patch" else F.input_file_name()
        rows = spark.read.option("lineSep", "\n").text(path).select("value", name.alias("file"))
        return LINES[form](rows, F.col("file"), strict)
    parse = DOCUMENTS[form]

    def run(batches):
        for files in batches:
            for name, content in zip(*files.columns):
                scope = f"f{digest_of(name.as_py())}_"
                quads = iter(parse(content.as_py().decode("utf-8-sig"), base if base is not None else name.as_py(), scope, "" if shared else None))
                while rows := list(itertools.islice(quads, ROWS)):
                    yield quad_batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, term_schema(*"spog")).distinct()


def quad_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Quads, or triples, as columns s, p, o, g."""
    types = [pa.int8(), pa.string(), pa.string(), pa.string()]

    def column(terms: tuple) -> pa.Array:
        fields = zip(*[t or NOTHING for t in terms])
        arrays = [pa.array(f, kind) for f, kind in zip(fields, types)]
        return pa.StructArray.from_arrays(arrays, names=list(Term._fields), mask=pa.array([t is None for t in terms]))

    slots = list(zip(*rows))
    slots += [(None,) * len(rows)] * (4 - len(slots))
    return pa.RecordBatch.from_arrays([column(x) for x in slots[:4]], names=list("spog"))


def digest_of(name: str) -> str:
    """What keeps the blank nodes of a file apart from those of any other: 128 bits of its path's SHA-256."""
    import hashlib

    return hashlib.sha256(name.encode()).hexdigest()[:32]


def read_text(spark: SparkSession, text: str, form: str = "turtle", base: str = "", strict: bool = True) -> DataFrame:
    """Quads of one document given as text."""
    form = ALIASES.get(form, form)
    if form in LINES:
        lines = spark.createDataFrame([(x,) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")], "value string")
        return LINES[form](lines, F.lit(""), strict)
    rows = [tuple(None if t is None else tuple(t) for t in (*q, None)[:4]) for q in DOCUMENTS[form](text, base, "")]
    return spark.createDataFrame(rows, term_schema(*"spog")).distinct()


# Line formats

IRI_TEXT = r"<[^\x00-\x20<>\"{}|^`\\]*(?:\\u[0-9A-Fa-f]{4}[^\x00-\x20<>\"{}|^`\\]*|\\U[0-9A-Fa-f]{8}[^\x00-\x20<>\"{}|^`\\]*)*>"
BNODE_TEXT = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-·]*[\p{L}\p{N}_\-·])?"
STRING_TEXT = r'"(?:[^"\\\n\r]|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+"'
SUBJECT = f"({IRI_TEXT}|{BNODE_TEXT})"
OBJECT = rf"({IRI_TEXT}|{BNODE_TEXT}|{STRING_TEXT}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{IRI_TEXT})?)"
STATEMENT = rf"{SUBJECT}[ \t]*({IRI_TEXT})[ \t]*{OBJECT}[ \t]*"
NT = rf"^[ \t]*{STATEMENT}\.[ \t]*(?:#.*)?\r?$"
NQ = rf"^[ \t]*{STATEMENT}{SUBJECT}?[ \t]*\.[ \t]*(?:#.*)?\r?$"
PATCH = rf"^[ \t]*([AD])[ \t]+{STATEMENT}{SUBJECT}?[ \t]*\.[ \t]*(?:#.*)?\r?$"
BLANK = r"^[ \t]*(?:#.*)?\r?$"
MARK = r"^[ \t]*(?:(?:PA|PD|TX|TC|TA|H)(?:[ \t].*|\.)?|#.*)?\r?$"


def _unescaped(text: Column) -> Column:
    """Decode the escapes of a string: pieces between backslash escapes, joined again."""
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
    parts = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 3, 8), 16, 10).cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32BE")
        out = F.when(p.rlike(r"^\\[uU]"), wide)
        for c, v in plain.items():
            out = out.when(p == "\\" + c, F.lit(v))
        return out.otherwise(p)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _term(text: Column, scope: Column) -> Column:
    """A term column of one term in N-Triples syntax; NULL for no text."""
    iri = make(2, _unescaped(text.substr(F.lit(2), F.length(text) - 2)))
    bnode = make(1, F.concat(scope, text.substr(F.lit(3), F.length(text))))
    body = F.regexp_extract(text, f"^({STRING_TEXT})", 1)
    suffix = text.substr(F.length(body) + 1, F.length(text))
    dt = F.when(suffix.startswith("^^"), _unescaped(suffix.substr(F.lit(4), F.length(suffix) - 4)))
    lang = F.when(suffix.startswith("@"), F.lower(suffix.substr(F.lit(2), F.length(suffix))))
    literal = make(LITERAL, _unescaped(body.substr(F.lit(2), F.length(body) - 2)), F.when(dt != XSD + "string", dt), lang)
    return F.when(text.startswith("<"), iri).when(text.startswith("_:"), bnode).when(text.startswith('"'), literal)


def _scope(file: Column) -> Column:
    return F.when(file == "", "").otherwise(F.concat(F.lit("f"), F.substring(F.sha2(file.cast("binary"), 256), 1, 32), F.lit("_")))


def _checked(rows: DataFrame, pattern: str, strict: bool, other: str = BLANK) -> DataFrame:
    """Lines of a pattern. Those of ``other`` are left out; the rest are refused, or left out as well.

    The test repeats what the filter says, as a filter may run after what is pushed below it.
    """
    value = F.col("value")
    if not strict:
        return rows.where(value.rlike(pattern))
    bad = F.raise_error(F.concat(F.lit("not a statement: "), value)).cast("string")
    return rows.where(~value.rlike(other)).withColumn("value", F.when(value.rlike(pattern) | value.rlike(other), value).otherwise(bad))


def _statements(pattern: str, graph: bool):
    def parse(rows: DataFrame, file: Column, strict: bool) -> DataFrame:
        rows = _checked(rows, pattern, strict)
        part = lambda n: F.regexp_extract("value", pattern, n)
        scope = _scope(file)
        g = _term(part(4), scope) if graph else lit(None)
        return rows.select(_term(part(1), scope).alias("s"), _term(part(2), scope).alias("p"), _term(part(3), scope).alias("o"), g.alias("g")).distinct()

    return parse


LINES["nt"] = _statements(NT, False)
LINES["nquads"] = _statements(NQ, True)


def _hext(rows: DataFrame, file: Column, strict: bool) -> DataFrame:
    """JSON arrays: subject, predicate, value, datatype or globalId or localId, language, graph."""
    rows = rows.where(~F.col("value").rlike(r"^\s*$"))
    a = F.from_json("value", "array<string>")
    rows = rows.select(a.alias("a"), "value", file.alias("file"))
    bad = F.raise_error(F.concat(F.lit("not a hextuple: "), F.col("value")))
    if strict:
        fine = (F.size("a") == 6) | F.col("value").rlike(r"^\s*$")
        rows = rows.withColumn("a", F.when(fine, F.col("a")).otherwise(bad.cast("array<string>")))
    else:
        rows = rows.where(F.size("a") == 6)
    scope = _scope(F.col("file"))
    at = lambda n: F.col("a")[n]
    node = lambda x: F.when(x.startswith("_:"), make(1, F.concat(scope, x.substr(F.lit(3), F.length(x))))).when(x != "", make(2, x))
    kind, lang = at(3), F.when(at(4) != "", F.lower(at(4)))
    local = F.regexp_replace(at(2), "^_:", "")
    dt = F.when((kind != "") & (kind != XSD + "string") & (kind != RDF + "langString"), kind)
    o = F.when(kind == "globalId", make(2, at(2))).when(kind == "localId", make(1, F.concat(scope, local))).otherwise(make(LITERAL, at(2), dt, lang))
    return rows.select(node(at(0)).alias("s"), node(at(1)).alias("p"), o.alias("o"), node(at(5)).alias("g")).distinct()


LINES["hext"] = _hext


def patch_operations(rows: DataFrame, file: Column, strict: bool = True, order: Column | None = None) -> DataFrame:
    """(line_no, op, s, p, o, g) of an RDF Patch: A and D lines, those of aborted transactions left out.

    The order of lines is that of ``order``, or of reading, which holds within a file.
    """
    value = F.col("value")
    rows = rows.select("value", file.alias("file"), (order if order is not None else F.monotonically_increasing_id()).alias("line_no"))
    code = F.regexp_extract(value, r"^[ \t]*(A|D|PA|PD|TX|TC|TA|H)(?:[ \t]|\.|$)", 1)
    rows = rows.withColumn("code", code)
    marks = rows.where(F.col("code").isin("TX", "TC", "TA")).select("file", "line_no", "code")
    # A transaction is open from TX to its TC or TA; the few marks tell which spans are void.
    ends = F.lead("line_no").over(Window.partitionBy("file").orderBy("line_no"))
    void = marks.select("file", "code", F.col("line_no").alias("lo"), ends.alias("hi"), F.lead("code").over(Window.partitionBy("file").orderBy("line_no")).alias("end")).where("code = 'TX' AND end = 'TA'")
    rows = _checked(rows, PATCH, strict, MARK)
    rows = rows.join(F.broadcast(void.select(F.col("file").alias("f"), "lo", "hi")), (F.col("file") == F.col("f")) & F.col("line_no").between(F.col("lo"), F.col("hi")), "left_anti")
    part = lambda n: F.regexp_extract("value", PATCH, n)
    scope = F.lit("")
    return rows.select("line_no", part(1).alias("op"), *[_term(part(n), scope).alias(c) for n, c in ((2, "s"), (3, "p"), (4, "o"), (5, "g"))])


def apply_patch(quads: DataFrame, operations: DataFrame) -> DataFrame:
    """Quads after a patch: the last operation on a quad wins."""
    last = operations.groupBy("s", "p", "o", "g").agg(F.max_by("op", "line_no").alias("op"))
    same = F.lit(True)
    for c in "spog":
        same &= F.col(f"q.{c}").eqNullSafe(F.col(f"r.{c}"))
    kept = quads.alias("q").join(last.alias("r"), same, "left_anti")
    return kept.select(*"spog").unionByName(last.where("op = 'A'").select(*"spog"))


def _patch(rows: DataFrame, file: Column, strict: bool) -> DataFrame:
    operations = patch_operations(rows, file, strict)
    return apply_patch(rows.sparkSession.createDataFrame([], term_schema(*"spog")), operations)


LINES["patch"] = _patch

