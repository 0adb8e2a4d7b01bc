"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quadrille.llm import trie

COLUMNS = "conv_id long, turn long, role string, text string"


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))

    def digest(role, text):
        d = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return [int(d[k : k + 16], 16) - (1 << 64 if d[k] >= "8" else 0) for k in (0, 16)]

    return {c: [t[2:] for t in sorted(turns, key=lambda t: (*t[:3], digest(*t[2:])))] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def expected(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (held[0], len(node), members[node[:-1]][0] if node else None, len(held), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, held in members.items())


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def conversations():
    rng = random.Random(13)
    said = [f"t{k} é" * k for k in range(4)]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(said)) for c in range(-12, 60) for t in range(rng.randint(1, 12)) if c % 7]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(3)]  # one very common conversation
    rows += [(200, t, "user", f"long {t // 2}") for t in range(90)] + [(201, t, "user", f"long {t // 2}") for t in range(70)]
    rows += [(202, None, None, None), (202, None, "user", "b"), (202, 0, "user", "tie one"), (202, 0, "user", "tie two"), (202, 1, "user", "r"), (202, 1, "user", "r")]
    rows += [(None, 0, "user", "no conversation"), (10**15, 0, "user", ""), (10**15 + 1, 0, "user", "x" * 100_000)]
    rng.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark, monkeypatch):
    rows = conversations()
    convs = in_order(rows)
    assert any(not turns for turns in rebuilt(convs).values())  # some are left without a turn
    plain = spark.createDataFrame(rows, COLUMNS)
    clash = spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], COLUMNS + ", depth int, p1 int, k1 string, ids int, pos int")
    assert result(trie.trie(*trie.rebuilt(trie.turns_of(clash)))) == expected(rebuilt(convs))
    # Bands of 4 go over three levels for 90 turns; short stretches and blocks part what is small here.
    for name, value in (("BAND", 4), ("STRETCH", 16), ("BLOCK_BITS", 3)):
        monkeypatch.setattr(trie, name, value)
    assert result(trie.prefix_trie(plain)) == expected(convs)
    assert result(trie.trie(*trie.rebuilt(trie.turns_of(plain)))) == expected(rebuilt(convs))


def test_trie_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert result(trie.prefix_trie(none)) == []
    assert result(trie.trie(*trie.rebuilt(trie.turns_of(none)))) == []
    rows = [(7, 0, "user", "hello")]  # its group's first is absent, so its only turn goes
    assert result(trie.trie(*trie.rebuilt(trie.turns_of(spark.createDataFrame(rows, COLUMNS))))) == expected(rebuilt(in_order(rows)))


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_cross_partitions(spark, parts):
    rng = np.random.default_rng(5)
    groups = np.sort(rng.choice([1, 2, 2, 2, 2, 3, -4], 3000))
    values = rng.integers(-(2**63), 2**63 - 1, 3000)
    rows = [(int(g), int(i), int(v), 0) for i, (g, v) in enumerate(zip(groups, values))]
    df = spark.createDataFrame(rows, "g long, i long, v long, w long").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.g, r.i): (r.v, r.w) for r in trie.running(df, "g", ["i"], ["v"], ("w",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    totals = defaultdict(int)
    for g, i, v, _ in rows:
        before = totals[g]
        totals[g] = (before + v + 2**63) % 2**64 - 2**63
        assert got[g, i] == (totals[g], before)
