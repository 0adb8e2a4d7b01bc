"""Queries over the mapped tables, each with the SQL that says what it must give."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Dataset, Graph
from .operators import graphs as G
from .operators.canonical import canonical, isomorphic, signature
from .session import checkpoint_dir, materialize
from .sources import readers, writers
from .sources.lift import Column, lift
from .sources.quads import MappedTables, map_table
from .streaming.changes import replay
from .tables import PREFIXES, dataset
from .terms import IRI, XSD, Literal, lit, make, n3, term_schema

EX = "http://ex/"
INT = '"^^<http://www.w3.org/2001/XMLSchema#integer>'
V = EX + "v#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


@dataclass
class Case:
    tables: str
    sparql: str
    sql: str


CASES: dict[str, Case] = {}


def case(name: str, tables: str, sparql: str, sql: str) -> None:
    CASES[name] = Case(tables, sparql, sql)


def ref(table: str, column: str) -> str:
    return f"'{EX}{table}/' || {column}"


# Patterns, filters and joins

case(
    "sparql_flagship", "customer orders",
    "SELECT ?seg (COUNT(?o) AS ?n) (ROUND(SUM(?p)) AS ?rev) WHERE { ?c v:c_mktsegment ?seg . ?o v:o_custkey_ref ?c ; v:o_totalprice ?p . FILTER(?p > 1000) } GROUP BY ?seg ORDER BY DESC(?rev) LIMIT 3",
    "SELECT c_mktsegment AS seg, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS rev FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY rev DESC LIMIT 3",
)
case(
    "bgp_star", "orders",
    'SELECT ?o ?status ?price WHERE { ?o v:o_orderstatus ?status ; v:o_totalprice ?price ; v:o_orderpriority "1-URGENT" }',
    f"SELECT {ref('orders', 'o_orderkey')} AS o, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT'",
)
case(
    "bgp_chain_join", "customer nation region",
    "SELECT ?name ?nation ?region WHERE { ?c v:c_name ?name ; v:c_nationkey_ref ?n . ?n v:n_name ?nation ; v:n_regionkey_ref ?r . ?r v:r_name ?region }",
    "SELECT c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
case(
    "bgp_value_join", "customer supplier",
    "SELECT ?c ?s WHERE { ?c v:c_nationkey ?k . ?s v:s_nationkey ?k ; v:s_acctbal ?b FILTER(?b < 0) }",
    f"SELECT {ref('customer', 'c_custkey')} AS c, {ref('supplier', 's_suppkey')} AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal < 0",
)
case(
    "bgp_any_predicate", "nation",
    "SELECT ?p ?o WHERE { <http://ex/nation/3> ?p ?o }",
    f"SELECT '{RDF_TYPE[1:-1]}' AS p, '{EX}c#Nation' AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{V}n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{V}n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{V}n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{V}n_regionkey_ref', {ref('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 3",
)
for _name, _filter, _where in (
    ("filter_compare", "?p >= 100000 && ?p < 150000.5", "o_totalprice >= 100000 AND o_totalprice < 150000.5"),
    ("filter_logic", "?p < 2000 || !(?s = 'F' || ?s = 'O')", "o_totalprice < 2000 OR NOT (o_orderstatus = 'F' OR o_orderstatus = 'O')"),
    ("filter_in", "?s IN ('P', 'O') && ?k IN (1, 2, 3, 5, 8, 13)", "o_orderstatus IN ('P', 'O') AND o_orderkey IN (1, 2, 3, 5, 8, 13)"),
    ("filter_not_in", "?s NOT IN ('F', 'O') && ?p > 50000", "o_orderstatus NOT IN ('F', 'O') AND o_totalprice > 50000"),
    ("filter_regex", "REGEX(?r, '^[1-3]-.*[gt]$', 'i')", "regexp_matches(o_orderpriority, '(?i)^[1-3]-.*[gt]$')"),
):
    case(_name, "orders", f"SELECT ?k ?s ?p ?r WHERE {{ ?o v:o_orderkey ?k ; v:o_orderstatus ?s ; v:o_totalprice ?p ; v:o_orderpriority ?r FILTER({_filter}) }}", f"SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS r FROM orders WHERE {_where}")

# Functions

case(
    "fn_string_case", "part",
    'SELECT ?k (UCASE(?n) AS ?u) (LCASE(?b) AS ?l) (STRLEN(?n) AS ?len) (CONCAT(?b, "/", ?t) AS ?cat) WHERE { ?x v:p_partkey ?k ; v:p_name ?n ; v:p_brand ?b ; v:p_type ?t }',
    "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS len, p_brand || '/' || p_type AS cat FROM part",
)
case(
    "fn_string_parts", "part",
    'SELECT ?k (SUBSTR(?n, 2, 4) AS ?sub) (SUBSTR(?n, 3) AS ?rest) (STRBEFORE(?b, "#") AS ?before) (STRAFTER(?b, "#") AS ?after) (REPLACE(?n, "[aeiou]", "_") AS ?rep) WHERE { ?x v:p_partkey ?k ; v:p_name ?n ; v:p_brand ?b }',
    "SELECT p_partkey AS k, substr(p_name, 2, 4) AS sub, substr(p_name, 3) AS rest, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS before, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END AS after, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rep FROM part",
)
case(
    "fn_string_tests", "part",
    'SELECT ?k (STRSTARTS(?n, "a") AS ?st) (STRENDS(?t, "L") AS ?en) (CONTAINS(?n, "e") AS ?co) (ENCODE_FOR_URI(?b) AS ?enc) WHERE { ?x v:p_partkey ?k ; v:p_name ?n ; v:p_brand ?b ; v:p_type ?t }',
    "SELECT p_partkey AS k, starts_with(p_name, 'a') AS st, ends_with(p_type, 'L') AS en, contains(p_name, 'e') AS co, replace(replace(p_brand, '#', '%23'), ' ', '%20') AS enc FROM part",
)
case(
    "fn_math", "customer",
    "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (-?b * 2 + 1 AS ?x) (?k - 3 AS ?m) (?k * ?k AS ?sq) WHERE { ?s v:c_custkey ?k ; v:c_acctbal ?b }",
    "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r, -c_acctbal * 2 + 1 AS x, c_custkey - 3 AS m, c_custkey * c_custkey AS sq FROM customer",
)
case(
    "fn_integers_wide", "orders",
    'SELECT ?k (STR(?k * ?k * ?k * 1000000000000000) AS ?x) (STR(9223372036854775807 + ?k) AS ?y) (STR(-?k - 9223372036854775808) AS ?z) (?k * ?k * ?k * 1000000000000000 > 18446744073709551616 AS ?above) (STR(xsd:integer(CONCAT("100000000000000000000", STR(?k)))) AS ?t) WHERE { ?o v:o_orderkey ?k }',
    "SELECT o_orderkey AS k, CAST(o_orderkey::HUGEINT * o_orderkey * o_orderkey * 1000000000000000 AS VARCHAR) AS x, CAST(9223372036854775807::HUGEINT + o_orderkey AS VARCHAR) AS y, CAST(-(o_orderkey::HUGEINT) - 9223372036854775808 AS VARCHAR) AS z, o_orderkey::HUGEINT * o_orderkey * o_orderkey * 1000000000000000 > 18446744073709551616 AS above, '100000000000000000000' || o_orderkey AS t FROM orders",
)
case(
    "agg_sum_wide", "orders lineitem",
    "SELECT ?p (STR(SUM(?k * 4611686018427387904)) AS ?s) (STR(MAX(?k + 9223372036854775807)) AS ?hi) (STR(SUM(DISTINCT ?k * 4611686018427387904)) AS ?d) WHERE { ?o v:o_orderpriority ?p ; v:o_orderkey ?k . ?l v:l_orderkey_ref ?o } GROUP BY ?p",
    "SELECT o_orderpriority AS p, CAST(sum(o_orderkey::HUGEINT * 4611686018427387904) AS VARCHAR) AS s, CAST(max(o_orderkey + 9223372036854775807::HUGEINT) AS VARCHAR) AS hi, CAST(sum(DISTINCT o_orderkey::HUGEINT * 4611686018427387904) AS VARCHAR) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
case(
    "fn_divide", "part",
    "SELECT ?k (?p / ?s AS ?d) (?s / 4 AS ?q) WHERE { ?x v:p_partkey ?k ; v:p_retailprice ?p ; v:p_size ?s FILTER(?s != 0) }",
    "SELECT p_partkey AS k, p_retailprice / p_size AS d, p_size / 4.0 AS q FROM part WHERE p_size <> 0",
)
case(
    "fn_date", "orders",
    "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (SECONDS(?d) AS ?s) WHERE { ?o v:o_orderkey ?k ; v:o_orderdate ?d }",
    "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, CAST(second(o_orderdate) AS DOUBLE) AS s FROM orders",
)
case(
    "fn_hash", "customer",
    "SELECT ?k (MD5(?n) AS ?md5) (SHA1(?n) AS ?sha1) (SHA256(?n) AS ?sha256) WHERE { ?c v:c_custkey ?k ; v:c_name ?n }",
    "SELECT c_custkey AS k, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer",
)
case(
    "fn_made_terms", "customer",
    'SELECT ?k (STR(IRI(CONCAT("http://ex/x/", ?n))) AS ?i) (STR(DATATYPE(STRDT(?n, v:name))) AS ?dt) (LANG(STRLANG(?n, "en-GB")) AS ?lang) (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "EN") AS ?en) (LANGMATCHES("fr", "en") AS ?fr) (isBlank(BNODE(?n)) AS ?b) (isURI(URI(STR(?c))) AS ?u) (STRLEN(SHA384(?n)) AS ?h3) (STRLEN(SHA512(?n)) AS ?h5) WHERE { ?c v:c_custkey ?k ; v:c_name ?n }',
    f"SELECT c_custkey AS k, 'http://ex/x/' || c_name AS i, '{V}name' AS dt, 'en-gb' AS lang, true AS en, false AS fr, true AS b, true AS u, CAST(96 AS BIGINT) AS h3, CAST(128 AS BIGINT) AS h5 FROM customer",
)
case(
    "fn_zones", "orders",
    'SELECT ?k (TZ(?z) AS ?tz) (STR(TIMEZONE(?z)) AS ?zone) (YEAR(?z) AS ?y) (HOURS(?z) AS ?h) (TZ(?d) AS ?none) WHERE { ?o v:o_orderkey ?k ; v:o_orderdate ?d BIND(STRDT(CONCAT(SUBSTR(STR(?d), 1, 10), "T10:00:00-05:30"), xsd:dateTime) AS ?z) }',
    "SELECT o_orderkey AS k, '-05:30' AS tz, '-PT5H30M' AS zone, year(o_orderdate) AS y, CAST(10 AS BIGINT) AS h, '' AS none FROM orders",
)
case(
    "fn_dates_moved", "orders",
    'SELECT ?k (STR(?z + "P1DT2H"^^xsd:dayTimeDuration) AS ?later) (STR(?z - "P3D"^^xsd:dayTimeDuration) AS ?before) (STR(?z - "1990-01-01T00:00:00Z"^^xsd:dateTime) AS ?age) WHERE { ?o v:o_orderkey ?k ; v:o_orderdate ?d BIND(STRDT(CONCAT(SUBSTR(STR(?d), 1, 10), "T10:00:00Z"), xsd:dateTime) AS ?z) }',
    "SELECT o_orderkey AS k, strftime(date_trunc('day', o_orderdate) + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS later, strftime(date_trunc('day', o_orderdate) - INTERVAL 62 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS before, 'P' || date_diff('day', TIMESTAMP '1990-01-01', CAST(o_orderdate AS TIMESTAMP)) || 'DT10H' AS age FROM orders",
)
case(
    "fn_numbers_mixed", "part",
    "SELECT ?k (+?s AS ?plus) (?s + 0.5 AS ?dec) (?s + ?p * 2.0e0 AS ?dbl) (-3 + ?s AS ?neg) (?s * -1.5 AS ?d2) (?s - -1e1 AS ?d3) WHERE { ?x v:p_partkey ?k ; v:p_size ?s ; v:p_retailprice ?p }",
    "SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS plus, CAST(p_size + 0.5 AS DOUBLE) AS dec, p_size + p_retailprice * 2.0 AS dbl, CAST(p_size - 3 AS BIGINT) AS neg, CAST(p_size * -1.5 AS DOUBLE) AS d2, CAST(p_size + 10 AS DOUBLE) AS d3 FROM part",
)
case(
    "fn_generated", "customer",
    "SELECT ?k (STRLEN(STRUUID()) AS ?n) (STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?u) (RAND() < 1.0 AS ?r) (NOW() = NOW() AS ?now) (isBlank(BNODE()) AS ?b) WHERE { ?c v:c_custkey ?k }",
    "SELECT c_custkey AS k, CAST(36 AS BIGINT) AS n, true AS u, true AS r, true AS now, true AS b FROM customer",
)
case(
    "syntax_strings", "nation",
    "SELECT ?k ('''a'b\nc''' AS ?l1) (\"\"\"x\"y\nz\"\"\" AS ?l2) ('t\\tu\\u00E9' AS ?esc) (1.5E1 AS ?e) WHERE { ?x v:n_nationkey ?k }",
    "SELECT CAST(n_nationkey AS BIGINT) AS k, 'a''b' || chr(10) || 'c' AS l1, 'x\"y' || chr(10) || 'z' AS l2, 't' || chr(9) || 'ué' AS esc, CAST(15 AS DOUBLE) AS e FROM nation",
)
case(
    "syntax_blank_nodes", "orders customer",
    "SELECT ?k ?seg WHERE { [ v:o_orderkey ?k ; v:o_custkey_ref [ v:c_mktsegment ?seg ] ; v:o_orderstatus 'P' ] . [] v:c_custkey 1 . _:n v:c_custkey 2 }",
    "SELECT o_orderkey AS k, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
)
case(
    "reduced", "orders",
    "SELECT (COUNT(*) AS ?n) WHERE { SELECT REDUCED ?k ?c WHERE { ?o v:o_orderkey ?k ; v:o_custkey ?c } }",
    "SELECT count(*) AS n FROM orders",
)
for _op in ("=", "!=", "<", "<=", ">", ">="):
    case("year_" + {"=": "is", "!=": "not", "<": "before", "<=": "until", ">": "after", ">=": "since"}[_op], "orders", f"SELECT ?k WHERE {{ ?o v:o_orderkey ?k ; v:o_orderdate ?d FILTER(YEAR(?d) {_op} 1996) }}", f"SELECT o_orderkey AS k FROM orders WHERE year(o_orderdate) {_op.replace('!=', '<>')} 1996")
case(
    "regex_flags", "part",
    "SELECT ?k (REGEX(?n, '^A', ?f) AS ?a) (REPLACE(?n, 'E', '_', ?f) AS ?r) WHERE { ?x v:p_partkey ?k ; v:p_name ?n ; v:p_size ?s BIND(IF(?s < 25, 'i', '') AS ?f) }",
    "SELECT p_partkey AS k, CASE WHEN p_size < 25 THEN regexp_matches(p_name, '(?i)^A') ELSE regexp_matches(p_name, '^A') END AS a, CASE WHEN p_size < 25 THEN regexp_replace(p_name, '(?i)E', '_', 'g') ELSE regexp_replace(p_name, 'E', '_', 'g') END AS r FROM part",
)
case(
    "fn_if_coalesce", "customer",
    'SELECT ?k (IF(?b < 0, "debt", "credit") AS ?w) (COALESCE(?none, ?b) AS ?c) (IF(BOUND(?none), 1, 2) AS ?n) WHERE { ?s v:c_custkey ?k ; v:c_acctbal ?b }',
    "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS w, c_acctbal AS c, CAST(2 AS BIGINT) AS n FROM customer",
)
case(
    "fn_terms", "nation",
    "SELECT ?k (STR(?n) AS ?s) (DATATYPE(?k) AS ?dt) (LANG(?name) AS ?lang) (isIRI(?n) AS ?i) (isLiteral(?name) AS ?l) (isNumeric(?k) AS ?num) (isBlank(?n) AS ?b) (sameTerm(?k, 3) AS ?three) WHERE { ?n v:n_nationkey ?k ; v:n_name ?name }",
    f"SELECT n_nationkey AS k, {ref('nation', 'n_nationkey')} AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, '' AS lang, true AS i, true AS l, true AS num, false AS b, n_nationkey = 3 AS three FROM nation".replace("n_nationkey AS k", "CAST(n_nationkey AS BIGINT) AS k"),
)
case(
    "cast_numbers", "customer",
    "SELECT ?k (xsd:integer(?b) AS ?i) (xsd:double(?k) AS ?d) (xsd:string(?k) AS ?s) (xsd:boolean(?k) AS ?t) (xsd:integer(?n) AS ?none) WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b ; v:c_name ?n }",
    "SELECT c_custkey AS k, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_custkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR) AS s, c_custkey <> 0 AS t, CAST(NULL AS BIGINT) AS none FROM customer",
)

# Optional, union, values, negation

case(
    "optional", "customer orders",
    "SELECT ?k ?o WHERE { ?c v:c_custkey ?k OPTIONAL { ?x v:o_custkey_ref ?c ; v:o_orderkey ?o } }",
    "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
)
case(
    "optional_filter", "customer orders",
    "SELECT ?k ?o WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b OPTIONAL { ?x v:o_custkey_ref ?c ; v:o_orderkey ?o ; v:o_totalprice ?p FILTER(?p > 30 * ?b) } }",
    "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 30 * c_acctbal",
)
case(
    "union", "customer supplier",
    "SELECT ?n ?b WHERE { { ?x v:c_name ?n ; v:c_acctbal ?b } UNION { ?x v:s_name ?n } }",
    "SELECT c_name AS n, c_acctbal AS b FROM customer UNION ALL SELECT s_name, NULL FROM supplier",
)
case(
    "values", "nation",
    'SELECT ?k ?n ?w WHERE { VALUES (?k ?w) { (1 "one") (3 "three") (99 "none") } ?x v:n_nationkey ?k ; v:n_name ?n }',
    "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, w FROM nation JOIN (VALUES (1, 'one'), (3, 'three'), (99, 'none')) AS t(k, w) ON k = n_nationkey",
)
case(
    "values_undef", "nation",
    'SELECT ?k ?r WHERE { ?x v:n_nationkey ?k ; v:n_regionkey ?r } VALUES (?k ?r) { (1 UNDEF) (UNDEF 2) (3 99) }',
    "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey AS BIGINT) AS r FROM nation, (VALUES (1, NULL), (NULL, 2), (3, 99)) AS t(a, b) WHERE (a IS NULL OR a = n_nationkey) AND (b IS NULL OR b = n_regionkey)",
)
case(
    "bind", "orders",
    "SELECT ?k ?t ?u WHERE { ?o v:o_orderkey ?k ; v:o_totalprice ?p BIND(?p * 1.0e0 - 5 AS ?t) BIND(?t > 1000 AS ?u) FILTER(?u) }",
    "SELECT o_orderkey AS k, o_totalprice - 5 AS t, true AS u FROM orders WHERE o_totalprice - 5 > 1000",
)
case(
    "minus", "customer orders",
    "SELECT ?k WHERE { ?c v:c_custkey ?k MINUS { ?o v:o_custkey_ref ?c ; v:o_orderstatus 'P' } }",
    "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
case(
    "minus_disjoint", "nation region",
    "SELECT ?k WHERE { ?n v:n_nationkey ?k MINUS { ?r v:r_regionkey ?z } }",
    "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation",
)
case(
    "not_exists", "customer orders",
    "SELECT ?k WHERE { ?c v:c_custkey ?k FILTER NOT EXISTS { ?o v:o_custkey_ref ?c } }",
    "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
case(
    "exists_correlated", "customer orders",
    "SELECT ?k WHERE { ?c v:c_custkey ?k ; v:c_acctbal ?b FILTER EXISTS { ?o v:o_custkey_ref ?c ; v:o_totalprice ?p FILTER(?p > 40 * ?b) } }",
    "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal)",
)
case(
    "exists_value", "customer orders",
    "SELECT ?k (EXISTS { ?o v:o_custkey_ref ?c } AS ?has) WHERE { ?c v:c_custkey ?k }",
    "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer",
)
case(
    "optional_chain", "customer nation",
    "SELECT ?k ?name WHERE { ?c v:c_custkey ?k OPTIONAL { ?c v:c_nationkey_ref ?n . ?n v:n_regionkey 2 } OPTIONAL { ?n v:n_name ?name } }",
    "SELECT c_custkey AS k, b.n_name AS name FROM customer LEFT JOIN nation a ON c_nationkey = a.n_nationkey AND a.n_regionkey = 2 LEFT JOIN nation b ON a.n_nationkey IS NULL OR a.n_nationkey = b.n_nationkey",
)
case(
    "minus_optional", "customer orders",
    "SELECT ?k ?x WHERE { ?c v:c_custkey ?k OPTIONAL { ?x v:o_custkey_ref ?c ; v:o_orderstatus 'P' } MINUS { ?x v:o_orderpriority '1-URGENT' } }",
    f"SELECT c_custkey AS k, {ref('orders', 'o_orderkey')} AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL OR o_orderpriority <> '1-URGENT'",
)
case(
    "exists_optional", "customer orders",
    "SELECT ?k ?x WHERE { ?c v:c_custkey ?k OPTIONAL { ?x v:o_custkey_ref ?c ; v:o_orderstatus 'P' } FILTER EXISTS { ?x v:o_orderpriority '1-URGENT' } }",
    f"SELECT c_custkey AS k, {ref('orders', 'o_orderkey')} AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE CASE WHEN o_orderkey IS NULL THEN EXISTS (SELECT 1 FROM orders u WHERE u.o_orderpriority = '1-URGENT') ELSE o_orderpriority = '1-URGENT' END",
)
case(
    "cross_theta", "nation region",
    "SELECT ?a ?b WHERE { ?n v:n_nationkey ?a . ?r v:r_regionkey ?b FILTER(?a < ?b) }",
    "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(r_regionkey AS BIGINT) AS b FROM nation, region WHERE n_nationkey < r_regionkey",
)

# Aggregates and modifiers

case(
    "agg_all", "lineitem",
    "SELECT ?f (COUNT(*) AS ?n) (ROUND(SUM(?q)) AS ?sum) (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (ROUND(AVG(?q) * 1000) AS ?avg) WHERE { ?l v:l_returnflag ?f ; v:l_quantity ?q ; v:l_extendedprice ?p } GROUP BY ?f",
    "SELECT l_returnflag AS f, count(*) AS n, floor(sum(l_quantity) + 0.5) AS sum, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, floor(avg(l_quantity) * 1000 + 0.5) AS avg FROM lineitem GROUP BY 1",
)
case(
    "agg_distinct", "lineitem",
    "SELECT (COUNT(DISTINCT ?o) AS ?orders) (COUNT(DISTINCT ?p) AS ?parts) (SUM(DISTINCT ?n) AS ?s) WHERE { ?l v:l_orderkey ?o ; v:l_partkey ?p ; v:l_linenumber ?n }",
    "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem",
)
case(
    "agg_group_concat", "nation",
    'SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?names) (SAMPLE(?r) AS ?same) WHERE { ?x v:n_regionkey ?r ; v:n_name ?n } GROUP BY ?r',
    "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, '|' ORDER BY n_name) AS names, CAST(n_regionkey AS BIGINT) AS same FROM nation GROUP BY n_regionkey",
)
case(
    "agg_empty", "nation",
    "SELECT (COUNT(?n) AS ?c) (SUM(?k) AS ?s) WHERE { ?n v:n_nationkey ?k FILTER(?k < 0) }",
    "SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS s",
)
case(
    "having", "orders",
    "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)",
    "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12",
)
case(
    "group_expr", "orders",
    "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o v:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
    "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1",
)
case(
    "subselect_topk", "customer orders",
    "SELECT ?name ?n WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o v:o_custkey_ref ?c } GROUP BY ?c ORDER BY DESC(?n) ?c LIMIT 10 } ?c v:c_name ?name }",
    f"SELECT c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, {ref('customer', 'o_custkey')} LIMIT 10) JOIN customer ON c_custkey = o_custkey",
)
case(
    "order_limit_offset", "orders",
    "SELECT ?k ?p WHERE { ?o v:o_orderkey ?k ; v:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 15",
    "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 15",
)
case(
    "distinct_order", "orders",
    "SELECT DISTINCT ?s ?r WHERE { ?o v:o_orderstatus ?s ; v:o_orderpriority ?r } ORDER BY ?r DESC(?s) LIMIT 7",
    "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS r FROM orders ORDER BY r, s DESC LIMIT 7",
)
case(
    "pricing_summary", "lineitem",
    'SELECT ?f ?st (ROUND(SUM(?q)) AS ?sum_qty) (ROUND(SUM(?p * (1 - ?d) * (1 + ?t))) AS ?sum_charge) (COUNT(*) AS ?n) WHERE { ?l v:l_returnflag ?f ; v:l_linestatus ?st ; v:l_quantity ?q ; v:l_extendedprice ?p ; v:l_discount ?d ; v:l_tax ?t ; v:l_shipdate ?sd FILTER(YEAR(?sd) < 1998) } GROUP BY ?f ?st',
    "SELECT l_returnflag AS f, l_linestatus AS st, floor(sum(l_quantity) + 0.5) AS sum_qty, floor(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) + 0.5) AS sum_charge, count(*) AS n FROM lineitem WHERE year(l_shipdate) < 1998 GROUP BY 1, 2",
)
case(
    "revenue_by_nation", "lineitem orders customer supplier nation region",
    "SELECT ?nation (ROUND(SUM(?p * (1 - ?d))) AS ?rev) WHERE { ?l v:l_orderkey_ref ?o ; v:l_suppkey_ref ?s ; v:l_extendedprice ?p ; v:l_discount ?d . ?o v:o_custkey_ref ?c . ?c v:c_nationkey_ref ?n . ?s v:s_nationkey_ref ?n . ?n v:n_name ?nation ; v:n_regionkey_ref ?r . ?r v:r_name 'ASIA' } GROUP BY ?nation",
    "SELECT n_name AS nation, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
)

# Paths and graphs

case(
    "path_seq_inv", "customer nation region orders",
    "SELECT ?k ?region WHERE { ?c v:c_custkey ?k ; v:c_nationkey_ref/v:n_regionkey_ref/v:r_name ?region ; ^v:o_custkey_ref/v:o_orderstatus 'P' }",
    "SELECT c_custkey AS k, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
)
case(
    "path_alt", "customer supplier",
    "SELECT ?x ?n WHERE { ?x v:c_name|v:s_name ?n }",
    f"SELECT {ref('customer', 'c_custkey')} AS x, c_name AS n FROM customer UNION ALL SELECT {ref('supplier', 's_suppkey')}, s_name FROM supplier",
)
case(
    "path_neg", "region",
    "SELECT ?r ?x WHERE { ?r !(rdf:type|v:r_regionkey) ?x }",
    f"SELECT {ref('region', 'r_regionkey')} AS r, r_name AS x FROM region",
)
case(
    "path_plus", "supplier nation region",
    "SELECT ?a ?b WHERE { ?a (v:s_nationkey_ref|v:n_regionkey_ref)+ ?b }",
    f"SELECT {ref('supplier', 's_suppkey')} AS a, {ref('nation', 's_nationkey')} AS b FROM supplier UNION SELECT {ref('nation', 'n_nationkey')}, {ref('region', 'n_regionkey')} FROM nation UNION SELECT {ref('supplier', 's_suppkey')}, {ref('region', 'n_regionkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
case(
    "path_star_bound", "supplier nation region",
    "SELECT ?x WHERE { ?x (v:s_nationkey_ref|v:n_regionkey_ref)* <http://ex/region/1> }",
    f"SELECT '{EX}region/1' AS x UNION SELECT {ref('nation', 'n_nationkey')} FROM nation WHERE n_regionkey = 1 UNION SELECT {ref('supplier', 's_suppkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1",
)
case(
    "path_opt", "nation region",
    "SELECT ?x WHERE { <http://ex/nation/2> v:n_regionkey_ref? ?x }",
    f"SELECT '{EX}nation/2' AS x UNION SELECT {ref('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 2",
)
case(
    "graph_named", "region nation supplier",
    "SELECT ?g (COUNT(?s) AS ?n) WHERE { GRAPH ?g { ?s rdf:type ?t } } GROUP BY ?g",
    f"SELECT '{EX}g/region' AS g, count(*) AS n FROM region UNION ALL SELECT '{EX}g/nation', count(*) FROM nation UNION ALL SELECT '{EX}g/supplier', count(*) FROM supplier",
)
case(
    "graph_fixed", "region nation",
    "SELECT ?s ?n WHERE { GRAPH g:nation { ?s v:n_name ?n } GRAPH ?h { ?r v:r_name 'ASIA' } ?s v:n_regionkey_ref ?r }",
    f"SELECT {ref('nation', 'n_nationkey')} AS s, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
case(
    "dataset_from", "region nation",
    "SELECT ?p (COUNT(*) AS ?n) FROM <http://ex/g/nation> WHERE { ?s ?p ?o } GROUP BY ?p",
    f"SELECT p, count(*) AS n FROM nation, (VALUES ('{RDF_TYPE[1:-1]}'), ('{V}n_nationkey'), ('{V}n_name'), ('{V}n_regionkey'), ('{V}n_regionkey_ref')) AS t(p) GROUP BY 1",
)


# EXISTS inside expressions, and keys that may be unbound

_BIG = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 40)"
case(
    "exists_in_bind", "customer orders",
    "SELECT ?c ?big { ?c v:c_acctbal ?b BIND(EXISTS { ?o v:o_custkey_ref ?c ; v:o_totalprice ?p FILTER(?p > ?b * 40) } AS ?big) }",
    f"SELECT {ref('customer', 'c_custkey')} AS c, {_BIG} AS big FROM customer",
)
case(
    "exists_in_or", "customer orders",
    'SELECT ?c { ?c v:c_acctbal ?b ; v:c_mktsegment ?seg FILTER(?seg = "BUILDING" || EXISTS { ?o v:o_custkey_ref ?c ; v:o_totalprice ?p FILTER(?p > ?b * 40) }) }',
    f"SELECT {ref('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR {_BIG}",
)
case(
    "not_exists_in_if", "customer orders",
    'SELECT ?kind (COUNT(*) AS ?n) { ?c v:c_acctbal ?b BIND(IF(NOT EXISTS { ?o v:o_custkey_ref ?c } || ?b < 0, "idle", "active") AS ?kind) } GROUP BY ?kind',
    "SELECT CASE WHEN c_acctbal < 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'idle' ELSE 'active' END AS kind, count(*) AS n FROM customer GROUP BY 1",
)
_LARGE = "customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey"
case(
    "minus_unsure", "customer orders",
    'SELECT ?c ?o { ?c v:c_acctbal ?b OPTIONAL { ?o v:o_custkey_ref ?c ; v:o_totalprice ?p FILTER(?p > 300000) } MINUS { ?o v:o_orderstatus "F" } }',
    f"SELECT {ref('customer', 'c_custkey')} AS c, {ref('orders', 'o_orderkey')} AS o FROM {_LARGE} WHERE o_orderkey IS NULL OR o_orderstatus <> 'F'",
)
case(
    "optional_two_unsure", "customer orders nation supplier",
    """SELECT ?n (COUNT(?c) AS ?m) (COUNT(DISTINCT ?s) AS ?k) { ?n v:n_name ?name
      OPTIONAL { ?c v:c_nationkey_ref ?n ; v:c_acctbal ?b FILTER(?b > 9900) } OPTIONAL { ?s v:s_nationkey_ref ?n ; v:s_acctbal ?d FILTER(?d > 8000) }
      OPTIONAL { { ?c v:c_mktsegment "BUILDING" } UNION { ?s v:s_acctbal ?any } } } GROUP BY ?n""",
    f"""WITH c AS (SELECT * FROM customer WHERE c_acctbal > 9900), s AS (SELECT * FROM supplier WHERE s_acctbal > 8000),
      l AS (SELECT n_nationkey, c_custkey, s_suppkey FROM nation LEFT JOIN c ON c_nationkey = n_nationkey LEFT JOIN s ON s_nationkey = n_nationkey),
      r AS (SELECT c_custkey AS c, NULL AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT NULL, s_suppkey FROM supplier),
      j AS (SELECT n_nationkey, coalesce(c_custkey, c) AS c, coalesce(s_suppkey, s) AS s FROM l LEFT JOIN r ON (c IS NULL OR c_custkey IS NULL OR c = c_custkey) AND (s IS NULL OR s_suppkey IS NULL OR s = s_suppkey))
    SELECT {ref('nation', 'n_nationkey')} AS n, count(c) AS m, count(DISTINCT s) AS k FROM j GROUP BY 1""",
)


def _sparql(c: Case) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dataset(spark, sf_dir, c.tables.split()).query(c.sparql).native(integers="bigint")


# Graphs as results: subject, predicate, object in N-Triples form

FUNCTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_N = f"""SELECT '<{EX}nation/' || n_nationkey || '>' AS s, p, o FROM nation, LATERAL (VALUES
 ('{RDF_TYPE}', '<{EX}c#Nation>'), ('<{V}n_nationkey>', '"' || n_nationkey || '{INT}'), ('<{V}n_name>', '"' || n_name || '"'),
 ('<{V}n_regionkey>', '"' || n_regionkey || '{INT}'), ('<{V}n_regionkey_ref>', '<{EX}region/' || n_regionkey || '>')) AS t(p, o)"""
_R = f"""SELECT '<{EX}region/' || r_regionkey || '>' AS s, p, o FROM region, LATERAL (VALUES
 ('{RDF_TYPE}', '<{EX}c#Region>'), ('<{V}r_regionkey>', '"' || r_regionkey || '{INT}'), ('<{V}r_name>', '"' || r_name || '"')) AS t(p, o)"""


def triples_text(df: DataFrame) -> DataFrame:
    return df.select(*[n3(F.col(c)).alias(c) for c in "spo"])


def query(name: str, sql: str | None = None):
    def keep(f):
        FUNCTIONS[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def explicit(spark: SparkSession, sf_dir: str, *names: str, only: tuple[str, ...] | None = None) -> Dataset:
    """Some tables as explicit quads; with ``only``, those of some predicates."""
    return Dataset(spark, dataset(spark, sf_dir, names).source.quads(only), PREFIXES)


@query("construct", f"SELECT '<{EX}nation/' || n_nationkey || '>' AS s, '<{V}in>' AS p, '\"' || r_name || '\"' AS o FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT '<{EX}region/' || n_regionkey || '>', '<{V}has>', '<{EX}nation/' || n_nationkey || '>' FROM nation")
def _construct(spark, sf_dir):
    text = "CONSTRUCT { ?n v:in ?name . ?r v:has ?n } WHERE { ?n v:n_regionkey_ref ?r . ?r v:r_name ?name }"
    return triples_text(dataset(spark, sf_dir, ["nation", "region"]).query(text).graph.quads)


@query("describe", f"SELECT * FROM ({_N}) WHERE s = '<{EX}nation/4>'")
def _describe(spark, sf_dir):
    return triples_text(dataset(spark, sf_dir, ["nation", "region"]).query("DESCRIBE <http://ex/nation/4>").graph.quads)


@query("ask", "SELECT count(*) > 0 AS answer FROM customer WHERE c_acctbal < -900")
def _ask(spark, sf_dir):
    found = dataset(spark, sf_dir, ["customer"]).query("ASK { ?c v:c_acctbal ?b FILTER(?b < -900) }")
    return found.plan.df.limit(1).agg((F.count("*") > 0).alias("answer"))


@query("update_insert_where", f"{_N} UNION SELECT '<{EX}nation/' || n_nationkey || '>', '<{V}label>', '\"N ' || n_name || '\"' FROM nation")
def _insert(spark, sf_dir):
    ds = explicit(spark, sf_dir, "nation").update('INSERT { ?n v:label ?l } WHERE { ?n v:n_name ?x BIND(CONCAT("N ", ?x) AS ?l) }')
    return triples_text(ds.quads.select("s", "p", "o").distinct())


@query("update_delete_where", f"SELECT * FROM ({_N}) WHERE p NOT IN ('<{V}n_name>', '<{V}n_regionkey>')")
def _delete(spark, sf_dir):
    ds = explicit(spark, sf_dir, "nation").update("DELETE WHERE { GRAPH ?g { ?n v:n_name ?x ; v:n_regionkey ?y } }")
    return triples_text(ds.quads)


@query("update_modify", f"SELECT s, p, CASE WHEN p = '<{V}n_regionkey_ref>' AND o = '<{EX}region/2>' THEN '<{EX}region/9>' ELSE o END AS o FROM ({_N})")
def _modify(spark, sf_dir):
    ds = explicit(spark, sf_dir, "nation").update("WITH g:nation DELETE { ?n v:n_regionkey_ref <http://ex/region/2> } INSERT { ?n v:n_regionkey_ref <http://ex/region/9> } WHERE { ?n v:n_regionkey_ref <http://ex/region/2> }")
    return triples_text(ds.quads)


@query("update_graphs", f"SELECT '{EX}a' AS g, s, p, o FROM ({_N}) UNION ALL SELECT '{EX}a', s, p, o FROM ({_R}) UNION ALL SELECT '{EX}b', s, p, o FROM ({_N})")
def _graphs(spark, sf_dir):
    text = "COPY g:nation TO :b ; MOVE g:nation TO :a ; ADD g:region TO :a ; CLEAR GRAPH g:region ; DROP SILENT GRAPH :none"
    ds = explicit(spark, sf_dir, "nation", "region").update(text)
    return ds.quads.select(F.col("g.lex").alias("g"), *[n3(F.col(c)).alias(c) for c in "spo"])


@query("update_data", f"SELECT * FROM ({_R}) WHERE NOT (s = '<{EX}region/0>' AND p = '{RDF_TYPE}') UNION ALL SELECT '<{EX}region/77>', '<{V}r_name>', '\"X\"'")
def _data(spark, sf_dir):
    ds = explicit(spark, sf_dir, "region").update('INSERT DATA { <http://ex/region/77> v:r_name "X" } ; DELETE DATA { GRAPH g:region { <http://ex/region/0> a c:Region } }')
    return triples_text(ds.quads)


def _two(spark, sf_dir) -> tuple[Graph, Graph]:
    quads = explicit(spark, sf_dir, "nation").quads
    key = F.regexp_extract(F.col("s.lex"), "([0-9]+)$", 1).cast("int")
    return Graph(quads.where(key < 15)), Graph(quads.where(key >= 10))


_K = "CAST(regexp_extract(s, '([0-9]+)>$', 1) AS INT)"
for _name, _op, _where in (
    ("graph_union", lambda a, b: a + b, "true"),
    ("graph_intersect", lambda a, b: a & b, f"{_K} BETWEEN 10 AND 14"),
    ("graph_difference", lambda a, b: a - b, f"{_K} < 10"),
    ("graph_xor", lambda a, b: a ^ b, f"{_K} NOT BETWEEN 10 AND 14"),
):
    FUNCTIONS[_name] = lambda spark, sf_dir, op=_op: triples_text(op(*_two(spark, sf_dir)).quads)
    SQL[_name] = f"SELECT * FROM ({_N}) WHERE {_where}"


@query("graph_cbd", f"SELECT * FROM ({_R}) WHERE s = '<{EX}region/1>'")
def _cbd(spark, sf_dir):
    return triples_text(Graph(explicit(spark, sf_dir, "region", "nation").quads).cbd(IRI(EX + "region/1")).quads)


@query("graph_roots", f"SELECT DISTINCT {ref('region', 'n_regionkey')} AS n FROM nation")
def _roots(spark, sf_dir):
    return G.roots(explicit(spark, sf_dir, "nation").quads, IRI(V + "n_regionkey_ref")).select(F.col("n.lex").alias("n"))


@query("graph_components", f"SELECT {ref('nation', 'n_nationkey')} AS n, {ref('region', 'n_regionkey')} AS r FROM nation")
def _components(spark, sf_dir):
    links = explicit(spark, sf_dir, "nation", only=(V + "n_regionkey_ref",)).quads
    found = G.components(links).select(F.col("n.lex").alias("x"), "root")
    a = found.where(F.col("x").contains("/nation/")).withColumnRenamed("x", "n")
    return a.join(found.where(F.col("x").contains("/region/")).withColumnRenamed("x", "r"), "root").select("n", "r")


@query("graph_components_orders", f"SELECT {ref('orders', 'o_orderkey')} AS n, {ref('customer', 'o_custkey')} AS r FROM orders")
def _components_orders(spark, sf_dir):
    """Customers with their orders, as components of a graph that grows with the tables."""
    links = explicit(spark, sf_dir, "orders", only=(V + "o_custkey_ref",)).quads
    found = G.components(links).select(F.col("n.lex").alias("x"), "root")
    a = found.where(F.col("x").contains("/orders/")).withColumnRenamed("x", "n")
    return a.join(found.where(F.col("x").contains("/customer/")).withColumnRenamed("x", "r"), "root").select("n", "r")


_STATUS = f"SELECT '<{EX}orders/' || o_orderkey || '>' AS s, '<{V}o_orderstatus>' AS p, '\"' || CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE o_orderstatus END || '\"' AS o FROM orders"


@query("update_modify_orders", _STATUS)
def _modify_orders(spark, sf_dir):
    quads = explicit(spark, sf_dir, "orders", only=(V + "o_orderstatus",)).quads
    text = "WITH g:orders DELETE { ?o v:o_orderstatus 'P' } INSERT { ?o v:o_orderstatus 'pending' } WHERE { ?o v:o_orderstatus 'P' }"
    return triples_text(Dataset(spark, quads, PREFIXES).update(text).quads)


@query("nquads_roundtrip_customer", f"SELECT '<{EX}customer/' || c_custkey || '>' AS s, p, o FROM customer, LATERAL (VALUES ('<{V}c_name>', '\"' || c_name || '\"'), ('<{V}c_nationkey_ref>', '<{EX}nation/' || c_nationkey || '>')) AS t(p, o)")
def _customers_written(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    quads = explicit(spark, sf_dir, "customer", only=(V + "c_name", V + "c_nationkey_ref")).quads
    writers.write(quads, path, "nquads", PREFIXES)
    return triples_text(readers.read(spark, path, "nquads"))


@query("graph_difference_orders", f"SELECT * FROM ({_STATUS.replace('pending', 'P')}) WHERE o <> '\"F\"'")
def _difference_orders(spark, sf_dir):
    quads = explicit(spark, sf_dir, "orders", only=(V + "o_orderstatus",)).quads
    return triples_text((Graph(quads) - Graph(quads.where(F.col("o.lex") == "F"))).quads)


@query(
    "void_profile",
    f"WITH t AS ({_N} UNION ALL {_R}) SELECT 'dataset' AS scope, NULL AS term, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t UNION ALL SELECT 'property', p[2:-2], count(*), count(DISTINCT s), count(DISTINCT o) FROM t GROUP BY p UNION ALL SELECT 'class', y.o[2:-2], count(*), count(DISTINCT t.s), count(DISTINCT t.o) FROM t JOIN t AS y ON t.s = y.s AND y.p = '{RDF_TYPE}' GROUP BY y.o",
)
def _void(spark, sf_dir):
    return Graph(explicit(spark, sf_dir, "nation", "region").quads).void()


@query("pattern_choices", f"SELECT * FROM ({_N}) WHERE p = '<{V}n_name>' AND s IN ('<{EX}nation/1>', '<{EX}nation/7>')")
def _choices(spark, sf_dir):
    return triples_text(Graph(explicit(spark, sf_dir, "nation").quads).triples(([IRI(EX + "nation/1"), IRI(EX + "nation/7")], IRI(V + "n_name"), None)))


@query("pattern_regex", f"SELECT * FROM ({_N}) WHERE regexp_matches(o, '^.[A-C].*') AND p = '<{V}n_name>'")
def _regex(spark, sf_dir):
    from .graph import Regex

    return triples_text(Graph(explicit(spark, sf_dir, "nation").quads).triples((None, IRI(V + "n_name"), Regex("[A-C]"))))


@query("multi_hop_api", f"SELECT '{EX}nation/' || n_nationkey AS s, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def _api(spark, sf_dir):
    from .plans.nodes import Link

    path = Link(IRI(V + "n_regionkey_ref")) / Link(IRI(V + "r_name"))
    return Graph(explicit(spark, sf_dir, "nation", "region").quads).triples((None, path, None)).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


# Documents


def _round_trip(form: str):
    def run(spark, sf_dir):
        path = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
        writers.write(explicit(spark, sf_dir, "nation", "region").quads, path, form, PREFIXES)
        back = readers.read(spark, path, form)
        return back.select(F.coalesce(n3(F.col("g")), F.lit("")).alias("g"), *[n3(F.col(c)).alias(c) for c in "spo"])

    return run


_Q = f"SELECT '<{EX}g/nation>' AS g, * FROM ({_N}) UNION ALL SELECT '<{EX}g/region>', * FROM ({_R})"
for _form in ("nquads", "hext", "patch", "trig"):
    FUNCTIONS[f"{_form}_roundtrip"] = _round_trip(_form)
    SQL[f"{_form}_roundtrip"] = _Q
for _form in ("nt", "turtle"):
    FUNCTIONS[f"{_form}_roundtrip"] = _round_trip(_form)
    SQL[f"{_form}_roundtrip"] = f"SELECT '' AS g, * FROM ({_N}) UNION ALL SELECT '', * FROM ({_R})"


def _triples_trip(form: str):
    def run(spark, sf_dir):
        path = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
        writers.write(Graph(explicit(spark, sf_dir, "nation", "region").quads).quads, path, form, PREFIXES)
        return triples_text(readers.read(spark, path, form))

    return run


for _form in ("xml", "pretty-xml", "json-ld", "trix", "n3", "longturtle"):
    _key = _form.replace("-", "_") + "_roundtrip"
    FUNCTIONS[_key] = _triples_trip(_form)
    SQL[_key] = f"SELECT * FROM ({_N}) UNION ALL SELECT * FROM ({_R})"


def _nested_trip(form: str):
    def run(spark, sf_dir):
        """Orders as blank nodes of their customers, nested in a folder of documents of 5,000 triples, read and asked."""
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        who, node = make(2, F.concat(F.lit(EX + "customer/"), F.col("o_custkey").cast("string"))), make(1, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
        links = orders.select(who.alias("s"), lit(IRI(V + "placed")).alias("p"), node.alias("o"))
        keys = orders.select(node.alias("s"), lit(IRI(V + "key")).alias("p"), make(3, F.col("o_orderkey").cast("string"), XSD + "integer").alias("o"))
        states = orders.select(node.alias("s"), lit(IRI(V + "status")).alias("p"), make(3, F.col("o_orderstatus")).alias("o"))
        quads = links.union(keys).union(states).withColumn("g", lit(None))
        path = f"{checkpoint_dir(spark)}/nested-{uuid.uuid4().hex}"
        writers.write(quads, path, form, PREFIXES, records=5000)
        read = materialize(readers.read(spark, path, form, shared=True))  # each pattern reads it
        found = Dataset(spark, read, PREFIXES).query("SELECT ?c (STR(?n) AS ?k) (STR(?t) AS ?status) { ?c v:placed ?o . ?o v:key ?n ; v:status ?t }")
        return found.native()

    return run


for _form in ("pretty-xml", "n3"):
    FUNCTIONS[f"nested_orders_{_form.replace('-', '_')}"] = _nested_trip(_form)
    SQL[f"nested_orders_{_form.replace('-', '_')}"] = f"SELECT {ref('customer', 'o_custkey')} AS c, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status FROM orders"


@query("patch_replay", f"SELECT * FROM ({_N}) WHERE {_K} >= 5 AND p <> '<{V}n_name>'")
def _replay(spark, sf_dir):
    """A change log replayed as a stream: everything added, two kinds of quads removed in a later file."""
    quads = explicit(spark, sf_dir, "nation").quads
    gone = quads.where((F.regexp_extract("s.lex", "([0-9]+)$", 1).cast("int") < 5) | (F.col("p.lex") == V + "n_name"))
    folder = f"{checkpoint_dir(spark)}/patch-{uuid.uuid4().hex}"
    writers.patch_lines(quads).coalesce(1).write.text(f"{folder}/log")
    writers.patch_lines(gone, operation="remove").coalesce(1).write.mode("append").text(f"{folder}/log")
    return triples_text(replay(spark, f"{folder}/log", f"{folder}/state"))


@query(
    "csv_lift",
    f"SELECT '<{EX}cust/' || c_custkey || '>' AS s, p, o FROM customer, LATERAL (VALUES ('<{EX}name>', '\"' || c_name || '\"'), ('<{EX}segment>', '<{EX}seg/' || c_mktsegment || '>'), ('{RDF_TYPE}', '<{EX}Customer>')) AS t(p, o)",
)
def _lift(spark, sf_dir):
    return _lift_customers(spark.read.parquet(f"{sf_dir}/customer.parquet"))


@query(
    "csv_lift_all",
    f"SELECT '<{EX}cust/' || c_custkey || '>' AS s, p, o FROM customer, LATERAL (VALUES ('<{EX}name>', '\"' || c_name || '\"'), ('<{EX}segment>', '<{EX}seg/' || c_mktsegment || '>'), ('{RDF_TYPE}', '<{EX}Customer>')) AS t(p, o)",
)
def _lift_all(spark, sf_dir):
    """The same by another name, which earlier results have."""
    return _lift_customers(spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _lift_customers(rows):
    columns = {"c_name": Column(EX + "name"), "c_mktsegment": Column(EX + "segment", "uri", prefix=EX + "seg/")}
    return triples_text(lift(rows, ["c_custkey"], EX + "cust/", columns, cls=EX + "Customer"))


@query("list_items", "SELECT position, item FROM (SELECT CAST(row_number() OVER (ORDER BY r_name) - 1 AS INT) AS position, r_name AS item FROM region)")
def _list(spark, sf_dir):
    from .operators.collections import list_triples

    names = [Literal(r[0]) for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").orderBy("r_name").collect()]
    head, triples = list_triples(names)
    return G.list_positions(Graph.of(spark, triples).quads, head).select("position", F.col("item.lex").alias("item"))


@query("canonical_isomorphic", "SELECT true AS same, false AS other, count(*) AS n FROM nation")
def _canonical(spark, sf_dir):
    """Nations as blank nodes, named in two ways, are one graph; without one triple they are not."""
    quads = explicit(spark, sf_dir, "nation", only=(V + "n_name", V + "n_regionkey")).quads
    def blank(salt: str) -> DataFrame:
        name = F.struct(F.lit(1).cast("tinyint").alias("k"), F.md5(F.concat(F.lit(salt), "s.lex")).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
        return quads.select(name.alias("s"), "p", "o", F.lit(None).cast(term_schema("g").split(" ", 1)[1]).alias("g"))

    a, b = blank("a"), blank("b")
    less = b.where(~((F.col("o.lex") == "1") & (F.col("p.lex") == V + "n_regionkey")))
    same, other = isomorphic(a, b), isomorphic(a, less)
    return canonical(a).select("s").distinct().agg(F.lit(same).alias("same"), F.lit(other).alias("other"), F.count("*").alias("n"))


# Stores, transactions, results and the graph API


@query("store_snapshots", f"SELECT 0 AS snapshot, p, count(*) AS n FROM ({_STATUS.replace('pending', 'P')}) GROUP BY p UNION ALL SELECT 1, p, count(*) FROM ({_STATUS}) WHERE o <> '\"F\"' GROUP BY p")
def _store(spark, sf_dir):
    """Orders kept on disk; a second snapshot without some, the first still there."""
    from .sources.store import open_store

    store = open_store(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.commit(explicit(spark, sf_dir, "orders", only=(V + "o_orderstatus",)).quads)
    store.commit(Dataset(spark, store.open(), PREFIXES).remove((None, IRI(V + "o_orderstatus"), Literal("F"))).quads)

    def counted(n: int) -> DataFrame:
        return store.open(n).quads.groupBy(n3(F.col("p")).alias("p")).agg(F.count("*").alias("n")).select(F.lit(n).alias("snapshot"), "p", "n")

    return counted(0).union(counted(1))


@query("transaction_rollback", f"SELECT 'kept' AS step, count(*) AS n FROM ({_R}) UNION ALL SELECT 'within', count(*) FROM ({_R}) WHERE p <> '<{V}r_name>'")
def _transaction(spark, sf_dir):
    ds = explicit(spark, sf_dir, "region")
    ds.begin()
    within = ds.update("DELETE WHERE { GRAPH g:region { ?r v:r_name ?n } }").quads.agg(F.lit("within").alias("step"), F.count("*").alias("n"))
    ds.rollback()
    return within.union(ds.quads.agg(F.lit("kept"), F.count("*")))


@query("update_using", f"SELECT '{EX}out' AS g, '<{EX}nation/' || n_nationkey || '>' AS s, '<{V}region>' AS p, '\"' || r_name || '\"' AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def _using(spark, sf_dir):
    text = "CREATE GRAPH :out ; INSERT { GRAPH :out { ?n v:region ?x } } USING g:nation USING NAMED g:region WHERE { ?n v:n_regionkey_ref ?r GRAPH g:region { ?r v:r_name ?x } }"
    made = explicit(spark, sf_dir, "nation", "region").update(text).quads.where(F.col("g.lex") == EX + "out")
    return made.select(F.col("g.lex").alias("g"), *[n3(F.col(c)).alias(c) for c in "spo"])


@query("update_load", f"SELECT '{EX}loaded' AS g, s, p, o FROM ({_STATUS.replace('pending', 'P')})")
def _load(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}.nt"
    writers.write(explicit(spark, sf_dir, "orders", only=(V + "o_orderstatus",)).quads, path, "nt")
    made = Dataset(spark, None, PREFIXES).update(f"LOAD <{path}> INTO GRAPH :loaded").quads
    return made.select(F.col("g.lex").alias("g"), *[n3(F.col(c)).alias(c) for c in "spo"])


def _result_trip(form: str):
    def run(spark, sf_dir):
        from .sources.results import parse_result

        text = dataset(spark, sf_dir, ["nation"]).query("SELECT ?n ?name WHERE { ?n v:n_name ?name }").serialize(form)
        _, rows = parse_result(text, form)
        return spark.createDataFrame([(r["n"].n3(), r["name"].n3()) for r in rows], "n string, name string")

    return run


for _form in ("json", "xml", "csv", "tsv"):
    FUNCTIONS[f"result_{_form}"] = _result_trip(_form)
    SQL[f"result_{_form}"] = f"SELECT '<{EX}nation/' || n_nationkey || '>' AS n, '\"' || n_name || '\"' AS name FROM nation"


@query("graph_transitive", f"SELECT '{EX}supplier/' || s_suppkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 UNION SELECT '{EX}nation/' || n_nationkey FROM nation WHERE n_regionkey = 2 UNION SELECT '{EX}region/2'")
def _transitive(spark, sf_dir):
    """All that leads to a region, once the two kinds of links have one name."""
    quads = explicit(spark, sf_dir, "supplier", "nation", only=(V + "s_nationkey_ref", V + "n_regionkey_ref")).quads
    links = Graph(quads.withColumn("p", F.col("p").withField("lex", F.lit(V + "in"))))
    return links.transitive_subjects(IRI(V + "in"), IRI(EX + "region/2")).select(F.col("s.lex").alias("n"))


@query("graph_projections", "SELECT 'subjects' AS what, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'objects', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'predicates', 1 UNION ALL SELECT 'pairs', count(*) FROM orders UNION ALL SELECT 'nodes', count(*) + count(DISTINCT o_orderstatus) FROM orders")
def _projections(spark, sf_dir):
    p = IRI(V + "o_orderstatus")
    graph = Graph(explicit(spark, sf_dir, "orders", only=(p.lex,)).quads)
    found = {"subjects": graph.subjects(p, Literal("P")), "objects": graph.objects(None, p, unique=True), "predicates": graph.predicates(unique=True), "pairs": graph[None:p:None], "nodes": graph.nodes()}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("graph_edits", f"SELECT s, p, CASE WHEN s = '<{EX}region/1>' THEN '\"new\"' ELSE o END AS o FROM ({_R}) WHERE p = '<{V}r_name>' AND s <> '<{EX}region/2>' UNION ALL SELECT '<{EX}region/8>', '<{V}r_name>', '\"more\"'")
def _edits(spark, sf_dir):
    name = IRI(V + "r_name")
    graph = Graph(explicit(spark, sf_dir, "region", only=(name.lex,)).quads)
    graph = graph.set((IRI(EX + "region/1"), name, Literal("new"))).remove((IRI(EX + "region/2"), None, None))
    return triples_text(graph.add((IRI(EX + "region/8"), name, Literal("more"))).quads)


def _records(spark, sf_dir, salt: str) -> DataFrame:
    """Orders' statuses and priorities on blank nodes, so that thousands of nodes look alike."""
    quads = explicit(spark, sf_dir, "orders", only=(V + "o_orderstatus", V + "o_orderpriority")).quads
    name = make(1, F.md5(F.concat(F.lit(salt), "s.lex")))
    return quads.select(name.alias("s"), "p", "o", F.lit(None).cast(term_schema("g").split(" ", 1)[1]).alias("g"))


@query("canonical_records", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, true AS same FROM orders GROUP BY 1, 2")
def _canonical_records(spark, sf_dir):
    """As many blank nodes after canonical labelling as before, and the same under other names."""
    a, b = _records(spark, sf_dir, "a"), _records(spark, sf_dir, "b")
    named, other = (materialize(canonical(quads)) for quads in (a, b))
    by = {c: named.where(F.col("p.lex") == V + "o_order" + c).select(F.col("s.lex").alias("x"), F.col("o.lex").alias(c)) for c in ("status", "priority")}
    counted = by["status"].join(by["priority"], "x").groupBy("status", "priority").agg(F.count("*").alias("n"))
    return counted.withColumn("same", F.lit(signature(named) == signature(other)))


@query("custom_function", "SELECT c_custkey AS k, 'x' || c_name AS y FROM customer")
def _custom(spark, sf_dir):
    from .functions.registry import register

    register(EX + "f#tag", lambda t: make(3, F.concat(F.lit("x"), t["lex"])), override=True)
    return dataset(spark, sf_dir, ["customer"]).query("SELECT ?k (<http://ex/f#tag>(?n) AS ?y) WHERE { ?c v:c_custkey ?k ; v:c_name ?n }").native()


@query("prepared_bindings", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'")
def _bindings(spark, sf_dir):
    ds = dataset(spark, sf_dir, ["orders"])
    return ds.query(ds.prepare("SELECT ?k WHERE { ?o v:o_orderkey ?k ; v:o_orderstatus ?s }"), {"s": Literal("P")}).native()


@query(
    "stream_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
)
def _windows(spark, sf_dir):
    from .streaming.windows import count_by_window

    return count_by_window(spark, sf_dir, "events.parquet", "ts", "event_type", "1 hour")


# Several tables about one subject


def _described(spark, sf_dir) -> Dataset:
    """Customers in three tables: who they are, their account, and what their orders add up to."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer = read("customer")
    activity = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"))
    tables = [
        map_table("customer", customer.select("c_custkey", "c_name", "c_nationkey"), "c_custkey", {"c_nationkey": "nation"}),
        map_table("account", customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", about="customer"),
        map_table("activity", activity, "o_custkey", about="customer"),
        map_table("nation", read("nation"), "n_nationkey"),
    ]
    return Dataset(spark, MappedTables(spark, tables), PREFIXES)


_ACTIVITY = "(SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS largest FROM orders GROUP BY 1)"
for _name, _text, _sql in (
    (
        "star_over_tables",
        "SELECT ?name ?seg ?n ?nation { ?c v:c_name ?name ; v:c_mktsegment ?seg ; v:n_orders ?n ; v:c_nationkey_ref ?k FILTER(?n > 12) ?k v:n_name ?nation }",
        f"SELECT c_name AS name, c_mktsegment AS seg, n_orders AS n, n_name AS nation FROM customer JOIN {_ACTIVITY} ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_orders > 12",
    ),
    (
        "star_shared_predicate",  # c_custkey and the class are in several tables
        "SELECT ?c ?key ?class ?x { ?c v:c_custkey ?key ; a ?class ; v:largest ?x FILTER(?x > 300000) }",
        f"SELECT {ref('customer', 'c_custkey')} AS c, c_custkey AS key, '{EX}c#' || class AS class, largest AS x FROM customer JOIN {_ACTIVITY} ON c_custkey = o_custkey, (VALUES ('Customer'), ('Account'), ('Activity')) AS t(class) WHERE largest > 300000",
    ),
    (
        "star_any_predicate",
        'SELECT ?c ?p (STR(?o) AS ?t) { ?c v:c_mktsegment "BUILDING" ; v:n_orders ?n . ?c ?p ?o FILTER(?n > 15) FILTER(isIRI(?o) || ?p IN (v:c_name, v:n_orders)) }',
        f"""SELECT {ref('customer', 'c_custkey')} AS c, p, t FROM customer JOIN {_ACTIVITY} ON c_custkey = o_custkey, LATERAL (VALUES ('{V}c_name', c_name), ('{V}n_orders', CAST(n_orders AS VARCHAR)), ('{V}c_nationkey_ref', '{EX}nation/' || c_nationkey),
          ('{RDF_TYPE[1:-1]}', '{EX}c#Customer'), ('{RDF_TYPE[1:-1]}', '{EX}c#Account'), ('{RDF_TYPE[1:-1]}', '{EX}c#Activity')) AS v(p, t) WHERE c_mktsegment = 'BUILDING' AND n_orders > 15""",
    ),
    (
        "star_by_graph",
        "SELECT ?g (COUNT(*) AS ?n) (COUNT(DISTINCT ?c) AS ?m) { GRAPH ?g { ?c v:c_custkey ?key ; ?p ?o } } GROUP BY ?g",
        f"SELECT '{EX}g/customer' AS g, 5 * count(*) AS n, count(*) AS m FROM customer UNION ALL SELECT '{EX}g/account', 4 * count(*), count(*) FROM customer",
    ),
):
    FUNCTIONS[_name] = lambda spark, sf_dir, text=_text: _described(spark, sf_dir).query(text).native()
    SQL[_name] = _sql


@query("path_orders_after", "SELECT 'http://ex/customer/' || a.o_custkey AS c, count(*) AS n, max(b.o_totalprice) AS largest FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (a.o_orderdate, a.o_orderkey) < (b.o_orderdate, b.o_orderkey) GROUP BY 1")
def _orders_after(spark, sf_dir):
    """Each customer's orders linked one to the next, and the closure of the links."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", after.alias("next"))
    ds = Dataset(spark, MappedTables(spark, [map_table("orders", rows, "o_orderkey", {"o_custkey": "customer", "next": "orders"})]), PREFIXES)
    return ds.query("SELECT ?c (COUNT(?b) AS ?n) (MAX(?p) AS ?largest) { ?a v:next_ref+ ?b . ?a v:o_custkey_ref ?c . ?b v:o_totalprice ?p } GROUP BY ?c").native()


case(
    "regex_flags_x_q", "part",
    """SELECT ?k (REGEX(?t, "^ P R O M O [ ]", "x") AS ?x) (REGEX(?t, "promo b.*", "q") AS ?q) (REGEX(?t, "promo ", "qi") AS ?qi) (REPLACE(?t, " ", "$0", "q") AS ?r)
      WHERE { ?p v:p_partkey ?k ; v:p_type ?t }""",
    "SELECT p_partkey AS k, starts_with(p_type, 'PROMO ') AS x, contains(p_type, 'promo b.*') AS q, contains(lower(p_type), 'promo ') AS qi, replace(p_type, ' ', '$0') AS r FROM part",
)


@query("store_changes", f"SELECT step, s, o FROM (SELECT 'after' AS step, '{EX}orders/' || o_orderkey AS s, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o FROM orders UNION ALL SELECT 'before', '{EX}orders/' || o_orderkey, o_orderstatus FROM orders) WHERE o IN ('done', 'P')")
def _store_changes(spark, sf_dir):
    """Orders kept on disk and then changed: only the changes are written, and patterns by object read their order."""
    from .sources.store import open_store

    store = open_store(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    quads = explicit(spark, sf_dir, "orders", only=(V + "o_orderstatus",)).quads
    before, gone = store.commit(quads), quads.where(F.col("o.lex") == "F")
    after = store.commit_changes(gone.withColumn("o", make(3, F.lit("done"))), gone)
    found = [Dataset(spark, store.open(n), PREFIXES).query(f'SELECT ?s ?o {{ VALUES ?o {{ "done" "P" }} ?s v:o_orderstatus ?o }}').native().withColumn("step", F.lit(step)) for n, step in ((before, "before"), (after, "after"))]
    return found[0].unionByName(found[1])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sparql(c) for n, c in CASES.items()} | FUNCTIONS


def all_sql() -> dict[str, str]:
    return {n: c.sql for n, c in CASES.items()} | SQL


