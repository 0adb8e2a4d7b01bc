"""Closures of long and tangled links against brute force, and how many rounds they take."""

import random

import pytest
from pyspark.sql import DataFrame

from quadrille.operators import paths


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that closures write."""
    written = []
    keep = paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df: written.append(1) or keep(df))
    return written


def closure(links, starts=None):
    out = {}
    after = {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    for s in after if starts is None else starts:
        found, left = set(), list(after.get(s, ()))
        while left:
            if (n := left.pop()) not in found:
                found.add(n)
                left += after.get(n, ())
        out[s] = found
    return {(a, b) for a, bs in out.items() for b in bs}


def frame(spark, links, graph=None) -> DataFrame:
    if graph is None:
        return spark.createDataFrame(links, "a long, b long")
    return spark.createDataFrame([(*x, graph) for x in links], "a long, b long, g string")


def pairs(df) -> list:
    return sorted(map(tuple, df.collect()))


GRAPHS = {
    "tree": [(i, i // 2) for i in range(2, 200)],
    "cycle": [(i, (i + 1) % 37) for i in range(37)],
    "two cycles and tails": [(i, (i + 1) % 9) for i in range(9)] + [(20 + i, 20 + (i + 1) % 14) for i in range(14)] + [(3, 20), (50, 51), (51, 52), (52, 1)],
    "loop": [(1, 1), (1, 2)],
    "random": [(random.Random(k).randint(0, 60), random.Random(-k).randint(0, 60)) for k in range(1, 90)],
    "ladder": [x for i in range(0, 60, 3) for x in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3))],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_closures(spark, name, monkeypatch):
    monkeypatch.setattr(paths, "PLAIN_ROUNDS", 2)
    links = GRAPHS[name]
    edges = frame(spark, links)
    assert pairs(paths.all_pairs(edges)) == sorted(closure(links))
    start = links[-1][0]
    assert pairs(paths.reach(edges.where(f"a = {start}"), edges)) == sorted(closure(links, [start]))
    two = edges.where(f"a IN ({start}, {links[0][0]})")
    assert pairs(paths.reach(two, edges)) == sorted(closure(links, {start, links[0][0]}))


def test_closures_stay_in_their_graph(spark, monkeypatch):
    monkeypatch.setattr(paths, "PLAIN_ROUNDS", 1)
    one, two = [(i, i + 1) for i in range(12)], [(i + 1, i) for i in range(0, 12, 2)] + [(11, 12), (12, 13)]
    edges = frame(spark, one, "x").union(frame(spark, two, "y"))
    want = sorted([(*p, "x") for p in closure(one)] + [(*p, "y") for p in closure(two)])
    assert pairs(paths.all_pairs(edges)) == want
    assert pairs(paths.reach(edges.where("a IN (0, 11)"), edges)) == [p for p in want if p[0] in (0, 11)]


def test_a_long_chain_takes_few_rounds(spark, rounds):
    n = 100_000
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    found = paths.reach(edges.where("a = 0"), edges)
    assert found.agg({"b": "count"}).first()[0] == n and found.agg({"b": "max"}).first()[0] == n
    assert len(rounds) < 60  # 8 plain rounds, 17 pointers, 17 joins along them


def test_all_pairs_of_a_chain_take_few_rounds(spark, rounds):
    n = 700
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    assert paths.all_pairs(edges).count() == n * (n + 1) // 2
    assert len(rounds) <= 12
