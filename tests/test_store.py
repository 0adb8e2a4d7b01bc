"""Kept quads: changes, compaction and the orders that patterns read."""

import os
import random
import re

import pytest

from quadrille.graph import Dataset
from quadrille.sources.store import QuadStore
from quadrille.streaming.changes import State, replay
from quadrille.terms import IRI, Literal

E = "http://e/"


def quad(i, j, g=None):
    return IRI(f"{E}s{i}"), IRI(f"{E}p{i % 3}"), Literal(j), g and IRI(E + g)


def frame(spark, quads):
    return Dataset.of(spark, [q if q[3] else q[:3] for q in quads], union=False).quads


def found(df):
    return sorted((r.s.lex, r.p.lex, r.o.lex, r.g.lex if r.g else "") for r in df.select("s", "p", "o", "g").collect())


def shown(quads):
    return sorted((s.lex, p.lex, o.lex, g.lex if g else "") for s, p, o, g in quads)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


@pytest.mark.parametrize("most", [2, 64])
def test_changes_are_merged_on_read(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(State, "MOST", most)
    rng, store, kept, states = random.Random(5), QuadStore(spark, str(tmp_path)), set(), []
    for n in range(6):
        pool = [quad(rng.randint(0, 5), rng.randint(0, 2), rng.choice([None, "g"])) for _ in range(8)]
        removed, added = rng.sample(sorted(kept | set(pool), key=str), 3), pool[:4]
        kept = kept - set(removed) | set(added)
        assert store.commit_changes(frame(spark, added), frame(spark, removed)) == n
        states.append(set(kept))
    for n, want in enumerate(states):
        assert found(store.read(n)) == shown(want) == found(store.open(n).quads)
    assert bool(store._numbers("snapshot")) == (most == 2)
    store.vacuum()
    assert found(store.open().quads) == shown(states[-1])
    assert most == 64 or len(store._numbers("delta")) <= 3


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path))
    big = spark.range(200_000).selectExpr("named_struct('k', 2Y, 'lex', concat('http://e/s', id), 'dt', null, 'lang', null) AS s", "named_struct('k', 2Y, 'lex', 'http://e/p', 'dt', null, 'lang', null) AS p", "named_struct('k', 3Y, 'lex', sha2(string(id), 256), 'dt', null, 'lang', null) AS o", "cast(null AS struct<k:tinyint,lex:string,dt:string,lang:string>) AS g")
    types = frame(spark, [quad(0, 0)]).schema
    store.commit(big.select(*[big[c].cast(types[c].dataType).alias(c) for c in "spog"]))
    whole = size(tmp_path)
    for k in range(3):
        store.commit_changes(frame(spark, [quad(k, k)]))
    assert store._numbers("snapshot") == [0] and size(tmp_path) - whole < whole / 100
    assert store.open().quads.count() == 200_003


def test_a_log_of_many_files(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    for k in range(12):
        lines = [f"A <{E}s{k}> <{E}p> \"{k}\" ."] + ([f"D <{E}s{k - 1}> <{E}p> \"{k - 1}\" ."] if k % 2 else [])
        (tmp_path / "log" / f"{k:03}.rdp").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / "log" / f"{k:03}.rdp", (1_700_000_000 + k, 1_700_000_000 + k))
    quads = replay(spark, str(tmp_path / "log"), str(tmp_path / "state"))
    assert sorted(r.o.lex for r in quads.collect()) == sorted(str(k) for k in range(1, 12, 2))
    state = State(spark, str(tmp_path / "state" / "quads"))
    assert len(state._numbers("delta")) == 12 and state._numbers("snapshot") == []


PATTERNS = {"s": f"SELECT ?p ?o {{ <{E}s7> ?p ?o }}", "o": f"SELECT ?s {{ ?s <{E}p1> 3 }}", "p": f"SELECT ?s ?o {{ ?s <{E}p2> ?o }}"}


@pytest.mark.parametrize("order", PATTERNS)
def test_patterns_read_the_order_that_leads_with_their_term(spark, tmp_path, order):
    quads = [quad(i, i % 40) for i in range(300)]
    store = QuadStore(spark, str(tmp_path))
    store.commit(frame(spark, quads))
    ds = Dataset(spark, store.open())
    result = ds.query(PATTERNS[order])
    files = result.df.inputFiles()
    folder = "snapshot-0" if order == "p" else f"{order}-0"
    plan = result.df._jdf.queryExecution().executedPlan().toString()
    assert files and all(f"/{folder}/part=" in f for f in files) and re.search(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = \d+\)\]", plan)
    want = {"s": [q for q in quads if q[0].lex == E + "s7"], "o": [q for q in quads if q[1].lex == E + "p1" and q[2].lex == "3"], "p": [q for q in quads if q[1].lex == E + "p2"]}
    assert len(list(result.rows())) == len(want[order])
    store.commit_changes(frame(spark, [(IRI(E + "s7"), IRI(E + "p1"), Literal(3), None)]), frame(spark, want[order][:1]))
    again = Dataset(spark, store.open()).query(PATTERNS[order])
    assert len(list(again.rows())) == len(want[order]) - 1 + (order != "p")
    assert all(f"/{folder}/part=" in f or "/delta-1/" in f for f in again.df.inputFiles())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_frequent_pair_of_terms_is_dealt_over_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store, quads = QuadStore(spark, str(tmp_path)), [(IRI(f"{E}s{i}"), IRI(E + "p"), Literal("x"), None) for i in range(400)]
        store.commit(frame(spark, quads).unionAll(frame(spark, quads[:50])))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder in ("snapshot-0", "o-0"):
        files = [f for _, _, names in os.walk(tmp_path / folder) for f in names if f.endswith(".parquet")]
        assert len(files) > 1
    assert found(store.open().quads) == shown(quads)


def test_last_operations_are_aggregated_by_hash_and_of_one_batch_not_at_all(spark, tmp_path):
    store = QuadStore(spark, str(tmp_path))
    store.commit(frame(spark, [quad(i, i) for i in range(20)]))
    store.commit_changes(frame(spark, [quad(30, 30)]), frame(spark, [quad(1, 1), quad(30, 30)]))
    assert "Aggregate" not in plan_of(store.changes([1]))
    store.commit_changes(frame(spark, [quad(1, 1)]), frame(spark, [quad(30, 30), quad(2, 2)]))
    plan = plan_of(store.changes([1, 2]))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert found(store.open().quads) == shown([quad(i, i) for i in range(20) if i != 2])


def test_values_are_broadcast_and_leave_out_rows_in_the_scan(spark, tmp_path):
    quads = [(IRI(f"{E}s{i}"), IRI(E + "p"), t, g and IRI(E + g)) for i in range(30) for t in (Literal("abc"[i % 3]), Literal("a", lang="en")) for g in (None, "g")]
    frame(spark, quads).write.parquet(str(tmp_path / "quads"))
    ds = Dataset(spark, spark.read.parquet(str(tmp_path / "quads")))
    result = ds.query(f'SELECT ?s ?o {{ VALUES ?o {{ "a" "b" "a" }} ?s <{E}p> ?o }}')
    plan = plan_of(result.df)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    scan = plan[plan.rindex("HashAggregate(") :]
    assert re.search(r"Filter .*o#\d+\.lex = a\)", scan)
    rows = sorted((r["s"].lex, r["o"].lex) for r in result.rows())
    assert rows == sorted((f"{E}s{i}", "abc"[i % 3]) for i in range(30) for _ in range(2 - i % 3 if i % 3 < 2 else 0))


def test_quads_of_some_predicates_read_their_columns_only(spark, tmp_path):
    from quadrille.queries import explicit

    spark.range(5).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "id % 2 AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    name, link = "http://ex/v#n_name", "http://ex/v#n_regionkey_ref"
    some = explicit(spark, str(tmp_path), "nation", only=(name,)).quads
    assert "n_regionkey" not in plan_of(some)
    every = explicit(spark, str(tmp_path), "nation").quads
    assert found(some) == found(every.where(f"p.lex = '{name}'")) != []
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    assert found(explicit(spark, str(tmp_path), "nation", only=(link, kind)).quads) == found(every.where(f"p.lex IN ('{link}', '{kind}')"))
