"""Cross-tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quadrille.llm import align
from quadrille.llm.tokens import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string"
OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts():
    rng = random.Random(12)
    words = ["hello", "Thtion", "naïve", "日本語", "don't", "x=1;", "\n\n", "\t", "2024-01-02", "über", "🙂🙃", "a  b   c", "<|endoftext|>", "<s>", "▁", "Ⅷ", " ", "supercalifragilistic"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(30)]
    out += [(100, None), (101, ""), (102, " "), (103, "\n"), (104, "▁"), (105, "a\x00b"), (106, "  two  spaces "), (107, "same"), (107, "same"), (None, "no id"), (108, "ﬁ ﬀ １２"), (109, "</s>"), (110, "<0x41>")]
    out += [(111, "日" * 300), (112, " ".join(rng.choice(words) for _ in range(8000))), (113, "\U0001f469‍\U0001f680" * 40), (114, "é" * 50)]
    return out


def tokens(text):
    """Bytes and ids of both sides, or None."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    pieces = []
    for i in b_model.encode(text):
        p = b_model.id_to_piece(i)
        pieces.append((i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()))
    ids = a_model.encode(" " + text, add_special_tokens=False).ids
    return [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in ids], pieces


def brute_force(rows):
    groups, memo = [], {}
    for _, text in rows:
        if text not in memo:
            found = []
            if text:
                a, b = tokens(text)
                whole = (" " + text).encode()
                if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                    ends_a, ends_b = np.cumsum([len(x) for _, x in a]).tolist(), np.cumsum([len(x) for _, x in b]).tolist()
                    cuts, i, j = sorted(set(ends_a) & set(ends_b)), 0, 0
                    for c in cuts:
                        x, y = ends_a.index(c) + 1, ends_b.index(c) + 1
                        found.append(([t for t, _ in a[i:x]], [t for t, _ in b[j:y]]))
                        i, j = x, y
            memo[text] = found
        groups.append(memo[text])
    counts, most = Counter(), defaultdict(int)
    for own in groups:
        counts.update({(x, y) for a, b in own for x in a for y in b})
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), own in zip(rows, groups):
        links = [(x, y) for a, b in own for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        sha = hashlib.sha256(text.encode()).hexdigest() if own else ""
        out.append((i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str), counts, most


def test_alignment_matches_brute_force(spark, monkeypatch):
    rows = texts()
    want, counts, most = brute_force(rows)
    assert sum(w[1] == 0 for w in want) >= 3
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], COLUMNS + ", block long, pairs string, n_a int").repartition(3)
    for pairs in (align.BLOCK_PAIRS, 500):  # one block a partition, and many
        got = align.align(frame, A, B, pairs)
        assert got.columns == OUT
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    found = {(r.a, r.b): (r.docs, r.best) for r in align.linked_pairs(frame, A, B, 500).collect()}
    assert found == {x: (n, n == most[x[0]]) for x, n in counts.items()}
    assert align.align(spark.createDataFrame([], COLUMNS), A, B).collect() == []
    assert [tuple(r)[1:] for r in align.align(spark.createDataFrame([(1, None)], COLUMNS), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_windows_are_found_once_and_long_ones_are_not_kept(monkeypatch):
    windows = align.Windows(A, B)
    windows.known.young.clear(), windows.known.old.clear()
    text = "one two one two one two"
    first = windows.aligned(text)
    assert 0 < len(windows.known.young) <= 3
    size = len(windows.known.young)
    assert windows.aligned(text)[:5] == first[:5] and len(windows.known.young) == size
    for name, value in (("LONG_WINDOW", 0), ("STRETCH", 2)):
        monkeypatch.setattr(align, name, value)
    windows.known.young.clear()
    again = windows.aligned(text)
    assert again[:5] == first[:5] and not windows.known.young
    assert all((x == y).all() for x, y in zip(again[5:], first[5:]))


def test_recent_windows_stay():
    recent = align.Recent()
    for k in range(1000):
        assert k == 0 or recent.get("often") == 1
        recent.keep("often" if k == 0 else k, k or 1, align.CACHE_BYTES // 10)
    assert recent.get("often") == 1 and recent.get(3) is None and len(recent.young) + len(recent.old) < 25


@pytest.mark.parametrize("narrow,numbers", [("u1", [0, 255]), ("u1", [256, 3]), ("<u2", [65535]), ("<u2", [65536, 1]), ("u1", [])])
def test_packing_round_trip(narrow, numbers):
    numbers = np.array(numbers, np.int64)
    assert align._unpacked(align._packed(numbers, narrow), len(numbers), narrow).tolist() == numbers.tolist()


def test_known_windows_of_plain_texts_are_not_tokenised_again(monkeypatch):
    windows, met = align.Windows(A, B), []
    windows.known.young.clear(), windows.known.old.clear()
    tokens = windows.unit_tokens
    monkeypatch.setattr(windows, "unit_tokens", lambda units: met.extend(units) or tokens(units))
    monkeypatch.setattr(windows, "tokens", lambda text: pytest.fail("tokenised whole"))
    windows.aligned("one two (one) two\nthree")
    assert met == [" one", " two", " (", "one", ")", "\nthree"]
    windows.aligned("two one two\nthree one)")
    assert met[6:] == []


def test_windows_by_text_give_what_windows_by_ids_give(monkeypatch):
    windows, rng = align.Windows(A, B), random.Random(3)
    parts = ["'s", "'re", "''t", "don't", "word", "  ", "\n", "\n\n", " \n", "\t", "x1", "1x", ";\r", "\r\n", "<s>", "<0x0A>", "éa", "\xa0", "====", "();", "Ab", "1.5", "²", " "]
    for stretch in (align.STRETCH, 3):
        monkeypatch.setattr(align, "STRETCH", stretch)
        for _ in range(300):
            text, quick = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), None
            want = windows.summed(windows.by_ids(text))
            if windows.held(text) is None:
                quick = windows.summed(windows.by_text(text))
                assert quick is not None
            for got in (windows.aligned(text), quick or want):
                assert got[:5] == want[:5] and all((x == y).all() for x, y in zip(got[5:], want[5:])), text
    assert windows.held("a;\rb") and not windows.held("a;\nb 'tis (b)")
