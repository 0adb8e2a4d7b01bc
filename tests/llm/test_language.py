"""Language identification against a plain partial-matching coder, and on held-out rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import language

DOC = "doc_id long, text string, lang string"


def entries(rows, nodes):
    """{lang: {context: Counter of bytes}} of what the trees keep."""
    counts = Counter()
    for text, lang in rows:
        data = b"\n" * 4 + text.lower().encode()
        for i in range(4, len(data)):
            for k in range(5):
                counts[lang, data[i - k : i], data[i]] += 1
    least = 1
    while sum(n >= least for n in counts.values()) > nodes:
        least *= 2
    trees = defaultdict(lambda: defaultdict(Counter))
    for (lang, context, byte), n in counts.items():
        if n >= least:
            trees[lang][context][byte] = n
    return trees


def bits(tree, text):
    data, out = b"\n" * 4 + text.lower().encode(), 0.0
    for i in range(4, len(data)):
        for k in range(4, -1, -1):
            seen = tree.get(data[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                out -= math.log2(seen[data[i]] / total)
                break
            out -= math.log2(len(seen) / total)
        else:
            out += 8
    return out


def prose(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    kinds = {"xx": ["ka", "to", "mi", "é"], "yy": ["ka", "sch", "ung", "ö"], "zz": ["ka", "日", "本", "to"]}
    out = [(i, prose(rng, kinds[lang], rng.randint(1, 40)), lang) for i, lang in enumerate(rng.choices(sorted(kinds), k=90))]
    out += [(200, None, "xx"), (201, "", "yy"), (202, "12 34 !", "zz"), (203, prose(rng, kinds["yy"], 3000), "yy"), (204, "KATOMI É", None), (205, "Ʊ", "zz"), (206, "²", "xx")]
    return out + [(None, "to ka mi", "xx"), (7, "again", "yy"), (7, "again", "yy")]


@pytest.mark.parametrize("nodes", [language.NODES, 700])
def test_code_lengths_match_a_plain_coder(spark, rows, nodes, monkeypatch):
    monkeypatch.setattr(language, "SLICE", 500)  # texts are counted in parts
    monkeypatch.setattr(language, "COSTS", 3 << 12)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    trees = entries([(t, lang) for i, t, lang in rows if i is not None and not held[i] and lang and t is not None], nodes)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOC + ", gram long, bits string, n int").repartition(3)
    got = language.identify(frame, language.learning(frame), nodes)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    want = []
    for i, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            want.append((str(i), held[i], "und", 0.0, None))
            continue
        own = {lang: bits(trees[lang], text) for lang in sorted(trees)}
        best = min(own, key=own.get)
        want.append((str(i), held[i], best, 1 / sum(2.0 ** (own[best] - b) for b in own.values()), own[best]))
    found = sorted(((str(r.doc_id), r.held_out, r.lang_pred, r.score, r.bits) for r in got.collect()), key=str)
    for a, b in zip(found, sorted(want, key=str), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == pytest.approx(b[4])
    right = [p == lang for (_, text, lang), (_, _, p, *_) in zip(rows[:90], want[:90]) if len(text) > 20]
    assert sum(right) / len(right) > 0.95


def test_nothing_to_learn_from_and_nothing_to_score(spark, rows):
    frame = spark.createDataFrame([(i, t, None) for i, t, _ in rows], DOC)
    assert {tuple(r) for r in language.identify(frame, language.learning(frame)).select("lang_pred", "score").collect()} == {("und", 0.0)}
    none = frame.limit(0)
    learn = language.learning(spark.createDataFrame(rows, DOC))
    assert language.identify(none, learn).collect() == []
    one = language.identify(frame, learn.where("lang = 'xx'")).where("lang_pred != 'und'").agg(F.min("score"), F.max("score"), F.min("lang_pred"), F.max("lang_pred")).first()
    assert tuple(one) == (1.0, 1.0, "xx", "xx")
    empty = language.identify(frame, spark.createDataFrame([("", "b"), ("", "a")], "text string, lang string"))
    assert {tuple(r) for r in empty.where("lang_pred != 'und'").select("lang_pred", "score").collect()} == {("a", 0.5)}  # a tie


def test_lookups():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    table = language.index_of(keys)
    assert (language.find(table, keys) == np.arange(len(keys))).all()
    others = rng.integers(2**41, 2**42, 5000).astype(np.uint64)
    assert (language.find(table, others) == -1).all()


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op11_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
