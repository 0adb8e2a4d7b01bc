"""Integers beyond 64 bits, whether their kind is known to the plan or to rows only, against Python's own."""

import random
from decimal import Decimal

import pytest

from quadrille.graph import Dataset
from quadrille.terms import IRI, XSD, Literal

E = "http://x/"
EDGES = [0, 1, -1, 2**31, 2**62, 2**63 - 1, -(2**63), 2**63, 2**64 + 5, -(10**19), 10**25 + 7, -(10**30)]


@pytest.fixture(scope="module")
def ds(spark):
    quads = [(IRI(E + f"s{i}"), IRI(E + "v"), Literal(str(n), datatype=XSD + "integer")) for i, n in enumerate(EDGES)]
    return Dataset.of(spark, quads, prefixes={"": E})


def one(ds, text):
    return {n: (t.lex, t.dt) for n, t in next(iter(ds.query(text))).items()}


def test_constants(ds):
    whole = lambda n: (str(n), XSD + "integer")
    got = one(ds, "SELECT (9223372036854775807 + 1 AS ?a) (9223372036854775807 * 9223372036854775807 AS ?b) (-9223372036854775808 - 1 AS ?c) (ABS(-99999999999999999999) AS ?d) (ROUND(12345678901234567890123) AS ?e) (xsd:integer('123456789012345678901234567890') AS ?f) (xsd:integer(-2.9) AS ?g) (xsd:integer(1e20) AS ?h) {}")
    assert got == {"a": whole(2**63), "b": whole((2**63 - 1) ** 2), "c": whole(-(2**63) - 1), "d": whole(10**20 - 1), "e": whole(12345678901234567890123), "f": whole(123456789012345678901234567890), "g": whole(-2), "h": whole(10**20)}
    found = one(ds, "SELECT (10000000000000000000000 > 1.5 AS ?a) (10000000000000000000000 = 1e22 AS ?b) (9007199254740993 = 9007199254740992 AS ?c) (IF(true, 1, 18446744073709551616) AS ?d) (18446744073709551616 / 2 AS ?e) (99999999999999999999999999999999999999 + 1 AS ?none) {}")
    assert found == {"a": ("true", XSD + "boolean"), "b": ("true", XSD + "boolean"), "c": ("false", XSD + "boolean"), "d": whole(1), "e": ("9223372036854775808", XSD + "decimal")}


def test_terms(ds):
    """Sums, differences, products and order of terms, as far as 38 digits hold them."""
    got = {(r["a"].lex, r["b"].lex): tuple(r[n].lex if n in r else None for n in "stul") for r in ds.query("SELECT ?a ?b (?a + ?b AS ?s) (?a - ?b AS ?t) (?a * ?b AS ?u) (?a < ?b AS ?l) { ?x :v ?a . ?y :v ?b }")}
    fits = lambda n: str(n) if abs(n) < 10**38 else None
    assert got == {(str(a), str(b)): (fits(a + b), fits(a - b), fits(a * b), str(a < b).lower()) for a in EDGES for b in EDGES}
    assert [int(r["a"].lex) for r in ds.query("SELECT ?a { ?x :v ?a } ORDER BY ?a")] == sorted(EDGES)


def test_aggregates(ds):
    total = sum(EDGES)
    got = one(ds, "SELECT (SUM(?a) AS ?s) (MIN(?a) AS ?lo) (MAX(?a) AS ?hi) (SUM(DISTINCT ?a) AS ?d) { ?x :v ?a }")
    assert {n: int(x) for n, (x, _) in got.items()} == {"s": total, "lo": min(EDGES), "hi": max(EDGES), "d": total}
    assert one(ds, "SELECT (SUM(?a) AS ?s) { VALUES ?a { 9223372036854775807 9223372036854775807 3 } }")["s"] == (str(2**64 + 1), XSD + "integer")
    assert Decimal(one(ds, "SELECT (AVG(?a) AS ?m) { VALUES ?a { 9223372036854775807 9223372036854775807 9223372036854775807 } }")["m"][0]) == 2**63 - 1
    assert one(ds, "SELECT (SUM(?a) AS ?s) { VALUES ?a { 90000000000000000000000000000000000000 90000000000000000000000000000000000000 } }") == {}
    assert one(ds, "SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) { ?x :none ?a }") == {"s": ("0", XSD + "integer"), "m": ("0", XSD + "integer")}


def test_random_expressions(spark):
    """Native columns of several widths: bounds keep small ones longs, and none goes wrong."""
    from quadrille.sources.quads import MappedTables, map_table

    rng = random.Random(3)
    rows = [(i, rng.choice([-128, 127, rng.randrange(-128, 128)]), rng.choice([-(2**31), 2**31 - 1, rng.randrange(2**31)]), rng.choice([-(2**63), 2**63 - 1, rng.randrange(2**63)])) for i in range(40)]
    table = map_table("n", spark.createDataFrame(rows, "k int, a tinyint, b int, c long"), "k", base=E)
    ds = Dataset(spark, MappedTables(spark, [table]), {"v": E + "v#"})
    texts = ["?a * ?b + ?a", "?b * ?b", "?b * ?b - ?b * ?b * ?a", "?c + ?a", "-?c", "?c - ?c * ?a", "-?a - ?b", "?c * ?c", "?b * ?b * ?b"]
    found = ds.query("SELECT ?k " + " ".join(f"({t} AS ?x{i})" for i, t in enumerate(texts)) + " { ?s v:k ?k ; v:a ?a ; v:b ?b ; v:c ?c }").native()
    assert [t for n, t in found.dtypes if n in ("x0", "x1", "x6")] == ["bigint"] * 3 and dict(found.dtypes)["x3"] == "decimal(38,0)"
    for r in found.collect():
        _, a, b, c = rows[r.k]
        values = [eval(t.replace("?", ""), {}, {"a": a, "b": b, "c": c}) for t in texts]
        assert [None if x is None else int(x) for x in list(r)[1:]] == [n if abs(n) < 10**38 else None for n in values]
