"""What keeps queries within their limits on large tables."""

import datetime

from pyspark.sql import functions as F

from quadrille import queries
from quadrille.graph import Dataset
from quadrille.sources import readers, writers
from quadrille.terms import term_schema

DATA = """
@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :k 1 ; :p :u . :b :k 2 . :u :q "U" . :v :q "V" .
:t :at "2011-01-31T23:30:00-05:00"^^xsd:dateTime ; :by "P1MT1H"^^xsd:duration ; :n 4 .
"""


def data(spark):
    return Dataset(spark, readers.read_text(spark, DATA, "turtle"))


def planned(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rows_repeated_by_keys_are_not_broadcast(spark):
    found = data(spark).query("PREFIX : <http://x/> SELECT * { ?x :k ?n OPTIONAL { ?x :p ?y } OPTIONAL { { ?y :q ?l } UNION { ?z :q ?l } } }").native()
    assert len(found.collect()) == 7
    physical = planned(found).split("== Physical Plan ==")[1]
    repeated = [i for i, line in enumerate(physical.splitlines()) if "explode(" in line]
    assert repeated
    for i in repeated:
        above = physical.splitlines()[i - 1 : i]
        assert not any("BroadcastExchange" in line for line in above) and "SortMergeJoin" in physical


def test_arithmetic_of_dates_reads_operands_once(spark):
    text = 'PREFIX : <http://x/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT (STR(?d + ?b) AS ?x) (STR(?b + ?d) AS ?y) (STR(?d - "P1D"^^xsd:dayTimeDuration) AS ?z) (STR(?d - "2011-01-31T00:00:00Z"^^xsd:dateTime) AS ?age) (STR(?b - "PT2H"^^xsd:dayTimeDuration) AS ?mixed) (STR(?n + ?n) AS ?sum) { :t :at ?d ; :by ?b ; :n ?n }'
    found = data(spark).query(text).native()
    assert tuple(found.first()) == ("2011-03-01T00:30:00-05:00", "2011-03-01T00:30:00-05:00", "2011-01-30T23:30:00-05:00", "P1DT4H30M", None, "8")
    one = data(spark).query('PREFIX : <http://x/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> SELECT (STR(?d - "P1D"^^xsd:dayTimeDuration) AS ?z) { :t :at ?d }').native()
    optimized = planned(one).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("as timestamp)") <= 4 and optimized.count("date_format(") <= 4


def test_other_patterns_of_a_star_are_read_in_its_scan(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"c{k}", k % 3, float(k), "A") for k in range(9)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, 5.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "n")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = queries.all_queries()["star_by_graph"](spark, str(tmp_path))
    assert "Join" not in planned(found).split("== Optimized Logical Plan ==")[1]
    assert sorted(map(tuple, found.collect())) == [("http://ex/g/account", 36, 9), ("http://ex/g/customer", 45, 9)]


def test_lifted_triples_are_dealt_before_repeats_are_dropped(spark):
    from quadrille.sources.lift import Column, lift

    rows = spark.createDataFrame([(1, "a|b", "x y", "7"), (1, "b", "x y", "7"), (2, "", None, "no")], "id long, tags string, place string, n string")
    place = Column("http://x/in", "uri", prefix="http://x/at/", cls="http://x/Place")
    columns = {"tags": Column("http://x/tag", split="|", lang="en"), "place": place, "n": Column("http://x/n", "int")}
    found = lift(rows, ["id"], "http://x/", columns, cls="http://x/Row")
    physical = planned(found).split("== Physical Plan ==")[1]
    assert "HashAggregate" not in physical[physical.rindex("Exchange hashpartitioning") :]
    got = sorted((r.s.lex, r.p.lex.split("/")[-1], *r.o) for r in found.collect())
    integer, place = "http://www.w3.org/2001/XMLSchema#integer", "http://x/at/x_y"
    assert got == sorted(
        [("http://x/1", "tag", 3, t, None, "en") for t in "ab"]
        + [("http://x/1", "in", 2, place, None, None), (place, "22-rdf-syntax-ns#type", 2, "http://x/Place", None, None), ("http://x/1", "n", 3, "7", integer, None)]
        + [(f"http://x/{k}", "22-rdf-syntax-ns#type", 2, "http://x/Row", None, None) for k in (1, 2)]
    )


def test_values_shared_by_many_rows_are_dealt(spark, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(40)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 2, -1.0 if k < 4 else 1.0) for k in range(6)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries.all_queries()["bgp_value_join"](spark, str(tmp_path))
    assert "salt_" in planned(found).split("== Optimized Logical Plan ==")[1] and "BroadcastHashJoin" not in planned(found)
    assert sorted(map(tuple, found.collect())) == sorted((f"http://ex/customer/{c}", f"http://ex/supplier/{s}") for c in range(40) for s in range(4) if c % 2 == s % 2)


def test_nested_documents_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(k, k % 2, "F") for k in range(6)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    found = queries.all_queries()["nested_orders_n3"](spark, str(tmp_path))
    assert "MapInPandas" not in planned(found)
    assert sorted(map(tuple, found.collect())) == [(f"http://ex/customer/{k % 2}", str(k), "F") for k in sorted(range(6), key=lambda k: (k % 2, k))]


def test_blank_nodes_that_link_to_none_are_refined_once(spark, monkeypatch):
    from quadrille.operators import canonical as C

    rounds, around = [], C._links_around
    monkeypatch.setattr(C, "_links_around", lambda parts: rounds.append(1) or around(parts))
    text = "@prefix : <http://x/> . " + " ".join(f"_:n{k} :p {k % 3} ; :q 'a' ." for k in range(30))
    names = C.labels(readers.read_text(spark, text, "turtle")).collect()
    assert len(rounds) == 1 and len({r.label for r in names}) == len({r.lex for r in names}) == 30
    linked = "@prefix : <http://x/> . " + " ".join(f"_:n{k} :p 'a' ; :q _:m{k % 5} ." for k in range(30)) + " _:m0 :r _:m0 ."
    a, b = (readers.read_text(spark, linked.replace("_:n", f"_:{x}").replace("_:m", f"_:z{x}"), "turtle") for x in "xy")
    assert sorted(C.canonical(a).collect()) == sorted(C.canonical(b).collect()) and a.count() == 61
    less = readers.read_text(spark, linked.replace("_:m0 :r _:m0", "_:m0 :r _:m1"), "turtle")
    assert C.isomorphic(a, b) and not C.isomorphic(a, less)


def test_values_beside_blank_nodes_gather_in_no_task(spark):
    from quadrille.operators import canonical as C

    iri, shared = (2, "http://x/p", None, None), (3, "a", None, None)
    rows = [((1, f"n{k}", None, None), iri, shared, None) for k in range(400)] + [(iri, iri, (1, "n1", None, None), None)]
    quads = spark.createDataFrame(rows, term_schema(*"spog"))
    names = quads.where("s.k = 1").select("s.lex", F.lit("x").alias("label"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = C._beside(quads, names, ["s", "o"]).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 401 and max(sizes) < 200


def test_closures_within_a_table_go_by_its_keys(spark, tmp_path, monkeypatch):
    from quadrille.operators import paths

    types, all_pairs = [], paths.all_pairs
    monkeypatch.setattr(paths, "all_pairs", lambda edges: types.append(edges.dtypes) or all_pairs(edges))
    rows = [(k, k % 2, float(k), datetime.datetime(2020, 1, 1 + k)) for k in range(9)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    found = queries.all_queries()["path_orders_after"](spark, str(tmp_path))
    assert types == [[("a", "bigint"), ("b", "bigint")]]
    assert sorted(map(tuple, found.collect())) == [("http://ex/customer/0", 10, 8.0), ("http://ex/customer/1", 6, 7.0)]


def test_blank_nodes_that_link_to_none_go_through_no_components(spark, tmp_path, monkeypatch):
    from quadrille.operators import graphs

    calls, components = [], graphs.components
    monkeypatch.setattr(graphs, "components", lambda quads: calls.append(1) or components(quads))
    iri, term = (2, "http://x/p", None, None), lambda k, x: (k, x, None, None)
    alone = [(term(2, f"http://x/{i}"), iri, term(1, f"n{i}"), None) for i in range(9)] + [(term(1, f"n{i}"), iri, term(3, str(j)), None) for i in range(9) for j in range(9 if i else 30)]
    tied = [(term(1, f"n{i}"), iri, term(1, f"n{i + 1}"), None) for i in range(1, 3)]
    formula = [(term(1, "m"), iri, term(3, str(j)), term(1, "f")) for j in range(30)] + [(term(1, "f"), iri, term(1, "n5"), None)]
    for name, form, rows, want in (("a", "pretty-xml", alone, 0), ("b", "n3", alone, 0), ("c", "pretty-xml", alone + tied, 1), ("d", "n3", alone + formula, 1)):
        calls.clear()
        writers.write(spark.createDataFrame(rows, term_schema(*"spog")), f"{tmp_path}/{name}", form, {"": "http://x/"}, records=20)
        assert len(calls) == want
        texts = [p.read_text() for p in (tmp_path / name).glob("part-*")]
        parsed = [list(readers.DOCUMENTS[readers.ALIASES.get(form, form)](t, "http://b/", "")) for t in texts]
        if name == "d":  # a formula is never cut, what is linked to it stays with it
            assert sum("{" in t for t in texts) == 1 and sorted(map(len, parsed))[-1] > 31
        else:
            back = readers.read(spark, f"{tmp_path}/{name}", form, shared=True)
            assert sum(map(len, parsed)) == back.count() == len(rows) and max(map(len, parsed)) <= 20
        assert sum("_:n0" in t or 'nodeID="n0"' in t for t in texts) > 1  # beyond the bound: named, and dealt
        assert not any("_:n8" in t or 'nodeID="n8"' in t for t in texts)
