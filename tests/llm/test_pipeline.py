"""The pipeline on small corpora, each stage against what brute force says of its own input."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_operators import CLASH, DOC, base_spans, classes, documents, fingerprint, labelled, prose, sentences

from quadrille.llm import rules

ITEMS = "item_id long, text string"


def stages(spark, folder):
    """Each stage's input and output, as run() chains them."""
    at, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(folder)).write.parquet(f"{folder}/{k}")
        before, at = at, spark.read.parquet(f"{folder}/{k}")
        out[name] = before, at
    return out


def row(r):
    return tuple(map(str, r))


def corpus(spark, folder, clash):
    docs, frame, marks = labelled(spark, 120)
    rng = random.Random(12)
    passage, twice = prose(rng, 40), sentences(rng)
    extra = [(500, docs[1][1]), (501, docs[1][1] + " end"), (502, f"{sentences(rng)} {passage}."), (503, f"{sentences(rng)} Set token=abcdef123456 now."), (504, prose(rng, 30_000)), (505, None), (506, "")]
    extra += [(None, sentences(rng)), (None, sentences(rng)), (None, docs[2][1]), (507, sentences(rng)), (507, sentences(rng)), (508, twice), (508, twice), (None, None), (509, f"{sentences(rng)} Ünïcode ★ 日本語 \U0001f600 .")]
    # A passage alone and a row of odd secrets: unlike the labelled good texts, and judged as the rules judge them.
    extra += [(510, passage), (511, "token=abcdef123456 " * 12)]
    everything = frame.union(documents(spark, extra))
    if clash:
        everything = spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, "h") for r in everything.collect()], DOC + CLASH)
    everything.write.parquet(f"{folder}/documents.parquet")
    marks.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (None, "no id"), (2, None)], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return everything, marks, passage


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline(spark, tmp_path, clash):
    everything, marks, passage = corpus(spark, tmp_path, clash)
    out = stages(spark, tmp_path)
    for name, (before, after) in list(out.items())[:4]:
        assert after.columns == before.columns == everything.columns, name
    # Quality rules: exactly the rows of kept documents stay, each as often as it was there.
    before, after = out["quality_rules"]
    verdict = {str(r.text): r.kept for r in rules.verdicts(before, marks).join(before, "doc_id").collect() if r.doc_id not in (507,)}
    rows = Counter(row(r) for r in after.collect())
    assert rows == Counter(row(r) for r in before.collect() if row(r) in rows)
    assert all((row(r) in rows) == verdict[str(r.text)] for r in before.collect() if str(r.text) in verdict)
    assert sum(r.doc_id == 507 for r in after.collect()) == 2 and sum(r.doc_id is None for r in after.collect()) == 3
    # Near-duplicates: one row of each class, that of the smallest id, a null only if no other is there.
    before, after = out["simhash_near_dedup"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    of = classes({i: fingerprint(t) for i, (_, t) in enumerate(texts)})
    kept = [(r.doc_id, r.text) for r in after.collect()]
    by_class = {}
    for i, c in of.items():
        by_class.setdefault(c, []).append(texts[i])
    assert len(kept) == len(by_class)
    for members in by_class.values():
        ids = [i for i, _ in members if i is not None]
        mine = [k for k in kept if k in members]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
    assert sum(i == 507 for i, _ in kept) == 2 and sum(i == 508 for i, _ in kept) == 1
    # Decontamination: what holds the passage goes, all else stays.
    before, after = out["benchmark_decontamination"]
    assert 502 in {r.doc_id for r in before.collect()}
    assert sorted(row(r) for r in after.collect()) == sorted(row(r) for r in before.collect() if passage not in (r.text or ""))
    # Secrets: every row stays, masked where it has spans, else as it was.
    before, after = out["secret_scans"]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())
    masked = next(r.text for r in after.collect() if r.doc_id == 503)
    assert "[SECRET]" in masked and not base_spans(masked.replace("[SECRET]", " "))
    left = {row(r) for r in after.collect()}
    assert all(row(r) in left for r in before.collect() if not base_spans(r.text or ""))
    # Packing: every row is in, and run() gives the same.
    before, after = out["best_fit_packing"]
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == Counter(r.doc_id for r in before.collect())
    pieces = lambda df: sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(after)


def test_pipeline_of_empty_tables(spark, tmp_path):
    everything, marks, _ = corpus(spark, tmp_path / "full", False)
    for name, docs, labels, items in (("all", 0, 0, 0), ("documents", 0, 200, 5), ("labels", 200, 0, 5), ("benchmark", 200, 200, 0)):
        folder = tmp_path / name
        everything.limit(docs).write.parquet(f"{folder}/documents.parquet")
        marks.limit(labels).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "none has this")], ITEMS).limit(items).write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder))
        assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert (got.count() > 0) == (docs > 0)
