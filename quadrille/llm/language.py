"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte is coded in the longest context
that the tree has; where the context doesn't have the byte, an escape is coded and the context shortened.
With n the context's count and d its distinct bytes, a byte seen c times has probability c / (n + d) and
an escape d / (n + d); below the empty context all 256 bytes are equal. A text starts as if after line
ends, and its letters are lower-cased. The statistics are frozen: the code length of a text under a
language is the sum of the costs of its bytes, and the language with the least wins.

The trees are counted over all learning rows, whatever they are; they keep the contexts seen at least t
times, t being the least power of two that leaves at most ``NODES`` entries in all trees together, which
is what reaches the driver and the executors. An entry's shorter forms are seen at least as often, so each
kept entry's shorter contexts are kept. Costs are worked out once for each entry and language, escapes
included, so a text costs one look-up a byte where its contexts are known.

Defined results: a null text, and one without a letter, is ``und`` with score 0, and so is every text where
there is nothing to learn from; of equal code lengths the first language by name wins; the score is the
share of the winner's probability in that of all languages; rows without an id are not learnt from and not
held out; equal rows each return a row; texts are never cut; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ORDER = 4
NODES = 1 << 19
UNKNOWN = "und"
#: Bits of a gram's code, above which its language's number is.
GRAM_BITS = 8 * (ORDER + 1)
START = b"\n" * ORDER
#: Bytes of texts that are counted at once, distinct grams that a task holds, and costs that are looked up at once.
SLICE, HELD, COSTS = 1 << 20, 1 << 21, 1 << 21

LETTER = re.compile("[A-Za-z]").search


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def has_letter(text: str) -> bool:
    return LETTER(text) is not None or any(map(str.isalpha, text))


def pieces(text: str, size: int = SLICE):
    """The text's bytes, parted by ``size``, each part after the bytes that come before it."""
    data = START + text.lower().encode()
    for at in range(ORDER, len(data), size):
        yield data[at - ORDER : at + size]


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the bytes of all parts, each with the ``ORDER`` before it, and where each part's begin."""
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    codes = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        codes |= data[ORDER - k : len(data) - k] << np.uint64(8 * k)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    own = np.ones(len(codes) + ORDER, bool)
    for k in range(ORDER):  # a part's first bytes are the contexts of those that follow
        own[ends - sizes + k] = False
    return codes[own[ORDER:]], ends - sizes - ORDER * np.arange(len(parts))


def counted(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, n): how often each language's texts have each byte after each context; the code's high bits number the language."""
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches):
        held, size, waiting, bytes_ = [], 0, {}, 0

        def take():
            for k, parts in waiting.items():
                codes, n = np.unique(grams(parts)[0], return_counts=True)
                held.append((codes | np.uint64(k << GRAM_BITS), n))
            waiting.clear()

        def merged():
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(codes, n):
            for k in range(0, len(codes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + 50_000].view(np.int64)), pa.array(n[k : k + 50_000])], names=["gram", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in pieces(text):
                    waiting.setdefault(number[lang], []).append(part)
                    bytes_ += len(part)
                    if bytes_ >= SLICE:
                        take()
                        size, bytes_ = sum(len(c) for c, _ in held), 0
                        if size >= 2 * HELD:
                            held = [merged()]
                            if len(held[0][0]) >= HELD:
                                yield from rows(*held[0])
                                held = []
        take()
        if held:
            yield from rows(*merged())

    return docs.select("text", "lang").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def tree_entries(counts: DataFrame, nodes: int = NODES) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of gram: number of the language, code and count of the entries that the trees keep."""
    levels = {ORDER + 1: materialize(counts)}
    for k in range(ORDER, 0, -1):  # drop the gram's first byte
        mask = (1 << 8 * k) - 1 | ~((1 << GRAM_BITS) - 1)
        levels[k] = materialize(levels[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("n").alias("n")))
    sizes = np.zeros(64, np.int64)
    for level in levels.values():
        for power, n in level.groupBy(F.floor(F.log2("n")).cast("int")).count().collect():  # at most 63 rows
            sizes[power] += n
    kept = np.cumsum(sizes[::-1])[::-1]  # entries seen at least 2**power times
    least = 1 << int(np.argmax(kept <= nodes))
    out = {}
    for k, level in levels.items():
        rows = level.where(F.col("n") >= least).toArrow()  # at most ``nodes`` in all
        codes, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        out[k] = codes >> GRAM_BITS, (codes & (1 << GRAM_BITS) - 1).astype(np.uint64), n
    return out


def index_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """An open table of distinct keys: the keys, the key's place at each slot (or -1), the shift of the hash, the most probes that a key needs."""
    bits = max(4, int(4 * len(keys)).bit_length())
    slots, left, probe = np.full(1 << bits, -1, np.int32), np.arange(len(keys), dtype=np.int32), 0
    while len(left):
        at = _slot(keys[left], 64 - bits, probe)
        free = slots[at] < 0
        slots[at[free]] = left[free]  # of several the last stays
        left, probe = left[slots[at] != left], probe + 1
    return keys, slots, 64 - bits, probe


def _slot(keys: np.ndarray, shift: int, probe: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)) + np.uint64(probe)) & np.uint64((1 << 64 - shift) - 1)


def find(table: tuple, wanted: np.ndarray) -> np.ndarray:
    """The place of each key, or -1."""
    keys, slots, shift, probes = table
    out = np.full(len(wanted), -1, np.int32)
    if not len(keys):
        return out
    rest = None
    for probe in range(probes):
        own = wanted if rest is None else wanted[rest]
        place = slots[_slot(own, shift, probe)]
        same = (keys[place] == own) & (place >= 0)
        if rest is None:
            out = np.where(same, place, -1)
            rest = np.flatnonzero(~same & (place >= 0))
        else:
            out[rest[same]] = place[same]
            rest = rest[~same & (place >= 0)]
        if not len(rest):
            break
    return out


def costs(entries: dict, languages: int) -> list[tuple]:
    """By length of gram, from 1 on: (grams, bits of each in each language, contexts, bits of their escapes)."""
    out, shorter = [], (index_of(np.zeros(1, np.uint64)), np.full((1, languages), 8.0))
    for k in range(1, ORDER + 2):
        lang, code, n = entries[k]
        known, at = np.unique(code, return_inverse=True)
        contexts, of = np.unique(code >> np.uint64(8), return_inverse=True)
        total, distinct = (np.bincount(of * languages + lang, w, len(contexts) * languages).reshape(-1, languages) for w in (n, None))
        escape = np.zeros(total.shape)
        escape[distinct > 0] = -np.log2(distinct[distinct > 0] / (total + distinct)[distinct > 0])
        bits = escape[np.searchsorted(contexts, known >> np.uint64(8))] + shorter[1][find(shorter[0], known & np.uint64((1 << 8 * (k - 1)) - 1))]
        bits[at, lang] = -np.log2(n / (total + distinct)[of, lang])
        shorter = index_of(known), bits
        out.append((*shorter, index_of(contexts), escape))
    return out


def bits_of(tables: list[tuple], codes: np.ndarray, languages: int) -> np.ndarray:
    """The cost of each byte, given with its context, in each language."""
    out = np.zeros((len(codes), languages))
    left = slice(None)
    for k in range(len(tables), 0, -1):
        known, bits, contexts, escape = tables[k - 1]
        place = find(known, codes)
        missed = np.flatnonzero(place < 0)
        if k == len(tables):
            out = bits[place] if len(bits) else out
            out[missed], left = 0, missed
        else:
            out[left[place >= 0]] += bits[place[place >= 0]]
            left = left[missed]
        if not len(missed):
            return out
        codes = codes[missed]
        context = find(contexts, codes >> np.uint64(8))
        out[left[context >= 0]] += escape[context[context >= 0]]
        codes = codes & np.uint64((1 << 8 * (k - 1)) - 1)
    out[left] += 8.0
    return out


def code_lengths(tables: list[tuple], texts: list[str], languages: int) -> np.ndarray:
    """Bits of each text in each language."""
    out, parts, of, size = np.zeros((len(texts), languages)), [], [], 0
    most = max(1 << 12, COSTS // languages)

    def flush():
        if parts:
            codes, starts = grams(parts)
            np.add.at(out, of, np.add.reduceat(bits_of(tables, codes, languages), starts, axis=0))
            parts.clear(), of.clear()

    for i, text in enumerate(texts):
        for part in pieces(text, most):
            parts.append(part)
            of.append(i)
            size += len(part)
            if size >= most:
                flush()
                size = 0
    flush()
    return out


def learning(docs: DataFrame) -> DataFrame:
    """The rows that the contract learns from."""
    return docs.where(remainder(F.col("doc_id")) != 2).where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")


def identify(docs: DataFrame, learn: DataFrame, nodes: int = NODES) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits (the text's code length in that language) of each document; ``learn`` has text and lang."""
    langs = sorted(r[0] for r in learn.select("lang").distinct().collect())  # a row for each language
    languages, tables = len(langs), None
    if langs:
        tables = costs(tree_entries(counted(learn, langs), nodes), languages)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            which = [i for i, t in enumerate(texts) if t is not None and languages and has_letter(t)]
            lengths = code_lengths(shared.value, [texts[i] for i in which], languages) if which else []
            for i, own in zip(which, lengths):
                best = int(np.argmin(own))
                pred[i], bits[i] = langs[best], float(own[best])
                score[i] = 1 / np.exp2(own[best] - own).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score), pa.array(bits, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    rows = docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits double")


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learning(docs))
