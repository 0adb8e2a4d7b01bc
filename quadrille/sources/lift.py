"""Tables to triples: a subject for each row, a triple for each value that is not empty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..terms import IRI, RDF, RDFS, XSD, lit, make


@dataclass
class Column:
    """How a column becomes objects: literal, int, float, bool, date (by ``format``), uri (``prefix``) or ignore.

    ``split`` makes several objects of one value; ``replace`` lists (old, new) texts; ``cls`` types the IRIs.
    """

    predicate: str
    kind: str = "literal"
    prefix: str = ""
    cls: str | None = None
    split: str | None = None
    replace: tuple[tuple[str, str], ...] = ()
    format: str | None = None
    lang: str | None = None


def property_name(label: str) -> str:
    """A column label in camel case."""
    words = "".join(c if c.isalnum() else " " for c in label).split()
    return "".join(w.lower() if i == 0 else w[:1].upper() + w[1:] for i, w in enumerate(words))


def iri_text(text: SparkColumn, prefix: str) -> SparkColumn:
    """An IRI of a value: blanks become underscores, the rest is percent-encoded."""
    return F.concat(F.lit(prefix), F.replace(F.url_encode(F.replace(F.trim(text), F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))


def _object(c: Column, text: SparkColumn) -> tuple[SparkColumn, tuple]:
    """The text of an object, and its kind, datatype and language."""
    if c.kind == "uri":
        return iri_text(text, c.prefix), (2, None, None)
    if c.kind == "int":
        return text.try_cast("long").cast("string"), (3, XSD + "integer", None)
    if c.kind == "float":
        return text.try_cast("double").cast("string"), (3, XSD + "double", None)
    if c.kind == "bool":
        yes, no = F.lower(text).isin("1", "true", "t", "yes", "y"), F.lower(text).isin("0", "false", "f", "no", "n")
        return F.when(yes, "true").when(no, "false"), (3, XSD + "boolean", None)
    if c.kind == "date":
        when = F.try_to_timestamp(text, F.lit(c.format)) if c.format else F.try_to_timestamp(text)
        return F.date_format(when, "yyyy-MM-dd"), (3, XSD + "date", None)
    return text, (3, None, c.lang)


def lift(df: DataFrame, identity: list[str] | None, base: str, columns: dict[str, Column] | None = None, cls: str | None = None, label: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Quads of a table. The subject is made of the identity columns, or of all of them by a digest.

    Without ``columns``, every column is a literal of a predicate named after it in ``vocabulary``.
    """
    if columns is None:
        columns = {c: Column((vocabulary or base) + property_name(c)) for c in df.columns}
    if identity:
        name = iri_text(F.concat_ws("_", *[F.col(f"`{c}`").cast("string") for c in identity]), base)
    else:
        name = F.concat(F.lit(base), F.md5(F.to_json(F.struct(*df.columns))))
    forms: dict[tuple, int] = {}  # what triples have besides the texts of subject and object: predicate, kind, datatype, language

    def triple(predicate: str, subject: SparkColumn, text: SparkColumn, form: tuple) -> SparkColumn:
        return F.struct(F.lit(forms.setdefault((predicate, *form), len(forms))).alias("form"), subject.alias("s"), text.cast("string").alias("o"))

    def values_of(c: Column):
        return lambda v: triple(c.predicate, name, *_object(c, v))

    def types_of(c: Column):
        return lambda v: triple(RDF + "type", _object(c, v)[0], F.lit(c.cls), (2, None, None))

    arrays = []
    for n, c in columns.items():
        if c.kind == "ignore":
            continue
        text = F.col(f"`{n}`").cast("string")
        for old, new in c.replace:
            text = F.replace(text, F.lit(old), F.lit(new))
        values = F.split(text, _quoted(c.split), -1) if c.split else F.array(text)
        values = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
        arrays.append(F.transform(values, values_of(c)))
        if c.kind == "uri" and c.cls:
            arrays.append(F.transform(values, types_of(c)))
    if cls:
        arrays.append(F.array(triple(RDF + "type", name, F.lit(cls), (2, None, None))))
    if label:
        arrays.append(F.array(triple(RDFS + "label", name, F.col(f"`{label}`"), (3, None, None))))
    if not arrays:
        raise ValueError("no column makes a triple")
    each = df.select(F.explode(F.concat(*arrays)).alias("t")).select("t.*").where("o IS NOT NULL")
    # Equal triples are brought together before any are dropped, as texts only, so that a task's table of them is
    # as large as its part of the shuffle and not as what a split of the input grows to.
    each = each.repartition("form", "s", "o").distinct()
    known = F.array(*[F.struct(lit(IRI(p)).alias("p"), F.lit(k).alias("k"), F.lit(dt).cast("string").alias("dt"), F.lit(lang).cast("string").alias("lang")) for p, k, dt, lang in forms])
    of = F.get(known, F.col("form"))
    o = F.struct(of["k"].cast("tinyint").alias("k"), F.col("o").alias("lex"), of["dt"].alias("dt"), of["lang"].alias("lang"))
    return each.select(make(2, F.col("s")).alias("s"), of["p"].alias("p"), o.alias("o"), lit(None).alias("g"))


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def lift_csv(spark, path: str, identity: list[str] | None, base: str, columns: dict[str, Column] | None = None, delimiter: str = ",", **options) -> DataFrame:
    """Quads of CSV files with a header."""
    return lift(spark.read.csv(path, header=True, sep=delimiter, escape='"'), identity, base, columns, **options)
