"""Statistics of a text that the quality classifier and the quality rules read.

Words are what lies between ASCII white space (space and \\x09 to \\x0D). A null text counts as empty.
"""

from __future__ import annotations

import re

import numpy as np

SPAN = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
CHUNK_WORDS = 250_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares between 0 and 1, near 0 in ordinary prose.
SHARES = ("symbols", "pipes", "marks", "capitals", "digits", "dup_lines", "repeats", "stops", "odd_words")

_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")
_STOPS = re.compile(r"[.,;:?]")
_ODD = re.compile(rb"(?<![^\x09-\x0D\x20])[\x21-\x40\x5B-\x60\x7B-\x7E]+(?![^\x09-\x0D\x20])")


def repeat_words(words: list[bytes], span: int = SPAN) -> int:
    """Words that lie in a window of ``span`` words found twice or more in the text."""
    first: dict[bytes, int] = {}
    hit = np.zeros(len(words), bool)
    for i in range(len(words) - span + 1):
        window = b" ".join(words[i : i + span])
        j = first.setdefault(window, i)
        if j != i:
            hit[j : j + span] = hit[i : i + span] = True
    return int(hit.sum())


def may_repeat(texts: list[list[bytes]], span: int = SPAN) -> np.ndarray:
    """Whether a text may hold a window twice: equal windows have equal sums, so none is missed."""
    out = np.zeros(len(texts), bool)
    sizes = np.array([len(t) for t in texts])
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    if len(hashes) <= span:
        return out
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = len(hashes) - span + 1
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(span):
        factor = factor * 6364136223846793005 % 2**64
        total += hashes[k : k + n] * np.uint64(factor)
    whole = doc[:n] == doc[span - 1 :]
    total, doc = total[whole], doc[:n][whole]
    total ^= doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # windows of two texts needn't meet
    order = np.argsort(total)
    same = total[order][1:] == total[order][:-1]
    out[doc[order[1:][same]]] = True
    return out


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def _chunks(texts: list[str | None]):
    held, size = [], 0
    for text in texts:
        data = (text or "").encode()
        words = data.split()
        held.append((text or "", data, words))
        size += len(words)
        if size > CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The BASE counts and the SHARES of each text."""
    counts, shares = [], []
    for chunk in _chunks(texts):
        for (text, data, words), again in zip(chunk, may_repeat([w for _, _, w in chunk])):
            n, chars = len(words), len(text) - sum(map(text.count, SPACES))
            symbols, dup = sum(map(text.count, SYMBOLS)), _dup_lines(text)
            repeats = repeat_words(words) if again else 0
            counts.append((n, chars, symbols, dup, repeats))
            c, w = max(1, chars), max(1, n)
            shares.append((symbols / c, text.count("|") / w, text.count("!") / w, len(_CAPITALS.findall(text)) / c, len(_DIGITS.findall(text)) / c, dup / max(1, text.count("\n") + 1), repeats / w, len(_STOPS.findall(text)) / w, len(_ODD.findall(data)) / w))
    return np.array(counts, np.int64).reshape(-1, len(BASE)), np.array(shares, np.float64).reshape(-1, len(SHARES))
