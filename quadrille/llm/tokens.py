"""Token counts by prefix dynamic programming, and packed token ids.

In byte-pair encoding a sequence of tokens is the encoding of its text exactly if every two neighbours
are the encoding of theirs. So the encoding of each prefix is that of a shorter prefix and one last
token: going through a pre-token from left to right, the last token is looked for among the vocabulary's
entries that end there and suit the last token of what is before them, and the count is one more than
there (``Encoder.table``). Pre-tokens don't merge, so with C the count before a pre-token and T(w) the
table of the pre-token w, the count at any prefix is C + T(w)[i]; C is a running sum. Tables and their last entries are kept for
distinct pre-tokens; totals, every prefix and every budget are read from them, in time linear in the
text and the same way in every script, and no text is encoded again. The library itself only normalises
and splits texts with characters on which Unicode versions might differ.

A prefix is counted as a text by itself, so a cut may fall at any code point: inside a special token's
string it is ordinary text, and before a combining mark what it would combine with stands alone.

Defined results: a null or empty text has no bytes and no tokens; texts are never cut; equal rows each
return a row, null ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: What the caches of a Python process may hold, in bytes, about; a cache beyond that is emptied.
CACHE_BYTES = 112 << 20
#: What an entry takes besides its text.
ENTRY = 160
#: Pre-tokens of more characters are not kept.
LONG_WORD = 512

# Letters and numbers among PLAIN, the characters whose class, case and composition every Unicode version agrees on.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ž", "0-9²³¹¼½¾"
PLAIN = r"[\t\n\r\x20-\x7E\xA0-įĲ-ž]*"
# The pre-token patterns that the two vocabularies were made for, on plain texts.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
WORD_PATTERN = rf"(?:'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+)"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
END_OF_WORD = "</w>"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept(dict):
    """A cache that is emptied when the sizes of its entries reach ``CACHE_BYTES``."""

    held = 0

    def keep(self, key, value, size: int):
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size + ENTRY
        return value


def load(path: str) -> types.SimpleNamespace:
    """The tokenizer, on one thread, its special tokens, and caches that last as long as this Python process.

    Functions travel to executors by value, so what is to last from task to task has a module of its own there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    here = sys.modules.setdefault("quadrille_tokenizers_kept", types.ModuleType("quadrille_tokenizers_kept"))
    if path not in vars(here):
        tokenizer = tokenizers.Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vars(here)[path] = types.SimpleNamespace(tokenizer=tokenizer, special=special, tables=Kept(), totals=Kept(), ids=Kept(), suits=Kept(), edges={}, model=None, joining=None)
    return vars(here)[path]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _may_join() -> frozenset[str]:
    """Characters of combining class 0 that may join the one before them in composition."""
    second = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for c in map(chr, range(sys.maxunicode + 1)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            second.add(chr(int(parts[1], 16)))
    return frozenset(c for c in second if not unicodedata.combining(c))


class Encoder:
    """Prefix tables of pre-tokens under a byte-pair vocabulary with word ends."""

    def __init__(self, kept: types.SimpleNamespace, path: str):
        if kept.model is None:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            pairs = (tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
            ranks = {p: rank for rank, p in enumerate(pairs)}
            made = {}
            for (left, right), rank in ranks.items():
                made.setdefault(left + right, (left, right, rank))
            kept.model = frozenset(model["vocab"]), ranks, made, max(map(len, model["vocab"]))
        self.entries, self.ranks, self.made, self.longest = kept.model
        self.suits: Kept = kept.suits
        self.edges: dict = kept.edges
        self.letters = _byte_letters()

    def _edge(self, entry: str, side: int) -> list[tuple[str, int]]:
        """What stands at an entry's left (0) or right (1) edge while it is merged, and the rank of the merge that ends it."""
        out = self.edges.get((entry, side))
        if out is None:
            out, part, rank = [], entry, len(self.ranks)
            while True:
                out.append((part, rank))
                if part not in self.made:
                    break
                part, rank = self.made[part][side], self.made[part][2]
            out.reverse()
            self.edges[entry, side] = out
        return out

    def _apart(self, before: str, entry: str, joined: bool = False) -> bool:
        """Whether no merge crosses the border of two entries: at no time does the pair that meets there rank before what either side merges next.

        With ``joined``, the two may merge once they are whole.
        """
        left, right = self._edge(before, 1), self._edge(entry, 0)
        i = j = 0
        while True:
            last = i == len(left) - 1 and j == len(right) - 1
            if last and joined:
                return True
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_ends and rank <= y_ends:  # of equal merges the leftmost comes first
                return False
            if last:
                return True
            if x_ends <= y_ends and i < len(left) - 1:
                i += 1
            else:
                j += 1

    def _whole(self, entry: str) -> bool:
        """Whether an entry is the encoding of its own text."""
        if entry not in self.made:
            return True
        left, right, _ = self.made[entry]
        return self._suit("", left) and self._suit("", right) and self._apart(left, right, joined=True)

    def _suit(self, before: str, entry: str) -> bool:
        """Whether the two are the encoding of their text; before is empty at the start."""
        key = before, entry
        found = self.suits.get(key)
        if found is None:
            found = self._whole(entry) if not before else self._suit("", entry) and self._apart(before, entry)
            self.suits.keep(key, found, len(before) + len(entry))
        return found

    def _last(self, word: str, i: int, open_: list[tuple[int, str]], mark: str) -> tuple[int, str]:
        """Count and last token of the first ``i`` letters, of which the shorter prefixes' are known."""
        entries, suits = self.entries, self.suits
        for at in range(max(0, i - self.longest), i):
            entry = word[at:i] + mark
            if entry in entries:
                n, before = open_[at]
                found = suits.get((before, entry))
                if found or (found is None and self._suit(before, entry)):
                    return n + 1, entry
        raise ValueError(f"no encoding of {word!r}")

    def states(self, letters: str, open_: list[tuple[int, str]] | None = None, before: str = "") -> list[tuple[int, str]]:
        """(count, last token) of each prefix that goes on; with ``open_``, those of ``before``, and of letters after it."""
        open_ = [(0, "")] if open_ is None else list(open_)
        word = before + letters
        for i in range(len(before) + 1, len(word) + 1):
            open_.append(self._last(word, i, open_, ""))
        return open_

    def lettered(self, word: str) -> tuple[str, list[int]]:
        """A pre-token as letters for its bytes, and where each of its characters ends there."""
        if word.isascii() and word.isprintable():
            return word, list(range(1, len(word) + 1))
        ends, out = [], []
        for c in word:
            out.extend(map(self.letters.__getitem__, c.encode()))
            ends.append(len(out))
        return "".join(out), ends

    def table(self, word: str) -> bytes | array:
        """The token count of each prefix of 1, 2, ... characters of a pre-token, each taken as a pre-token; of contractions' parts, as they split."""
        letters, ends = self.lettered(word)
        open_ = self.states(letters[:-1])
        counts = [self._last(letters, i, open_, END_OF_WORD)[0] for i in ends]
        if word in CONTRACTIONS:  # without its last letters it is an apostrophe and a word
            for i in range(2, len(word)):
                counts[i - 1] = counts[0] + self.table(word[1:i])[-1]
        return bytes(counts) if counts[-1] < 128 and max(counts) < 256 else array("I", counts)

    def total(self, word: str) -> int:
        """The last count of the pre-token's table."""
        letters, _ = self.lettered(word)
        return self._last(letters, len(letters), self.states(letters[:-1]), END_OF_WORD)[0]

    def closed(self, open_: list[tuple[int, str]], before: str, letters: str) -> int:
        """The count of ``before`` and ``letters`` as one pre-token, the open states of ``before`` given."""
        far = max(0, len(before) - self.longest)
        near = before[far:]
        states = self.states(letters[:-1], open_[far : len(before) + 1], near)
        return self._last(near + letters, len(near) + len(letters), states, END_OF_WORD)[0]


class WordCounter:
    """Counts tokens of texts from prefix tables of their pre-tokens."""

    def __init__(self, path: str):
        self.kept = kept = load(path)
        self.tokenizer, self.tables, self.totals = kept.tokenizer, kept.tables, kept.totals
        self.encoder = Encoder(kept, path)
        self.split = re.compile(WORD_PATTERN).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.special = re.compile("|".join(map(re.escape, sorted(kept.special, key=len, reverse=True))) or r"(?!)")
        self.normal = lru_cache(100_000)(self.tokenizer.normalizer.normalize_str)

    def table(self, word: str) -> bytes | array:
        found = self.tables.get(word)
        if found is None:
            found = self.encoder.table(word)
            if len(word) <= LONG_WORD:
                self.tables.keep(word, found, 6 * len(word))
        return found

    def _words(self, normal: str) -> list[tuple[str, int]]:
        """The pre-tokens of a normalised text and their starts."""
        return [(normal[a:b], a) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _parts(self, text: str) -> list[tuple[str, str]]:
        """Ordinary texts, each with the special token after it or nothing."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out.append((text[at : m.start()], m[0]))
            at = m.end()
        return [*out, (text[at:], "")]

    def total(self, word: str) -> int:
        found = self.encoder.total(word)
        if len(word) <= LONG_WORD:
            self.totals.keep(word, found, len(word))
        return found

    def _total(self, part: str) -> int:
        if self.plain(part) is not None:
            words = self.split(part.lower())
        else:
            words = [w for w, _ in self._words(self.tokenizer.normalizer.normalize_str(part))]
        total, known = self.total, self.totals
        return sum([known.get(w) or total(w) for w in words])

    def count(self, text: str | None) -> int:
        """The tokens of the whole text: the last of its prefix counts."""
        return sum(self._total(part) + bool(special) for part, special in self._parts(text or ""))

    def every_prefix(self, text: str | None) -> np.ndarray:
        """The token count of each prefix of 0, 1, 2, ... code points."""
        out, base = [np.zeros(1, np.int64)], 0
        for part, special in self._parts(text or ""):
            # Short of its end, a special token's string is ordinary text that goes on from the part.
            counts = base + self._prefixes(part + special[:-1])
            out.append(counts[1:])
            if special:
                base = int(counts[len(part)]) + 1
                out.append(np.array([base]))
        return np.concatenate(out)

    def _prefixes(self, part: str) -> np.ndarray:
        if self.plain(part) is not None:
            return self._sums(part.lower(), [(m[0], m.start()) for m in re.finditer(WORD_PATTERN, part.lower())])
        normal = self.tokenizer.normalizer.normalize_str(part)
        units = self._units(part)
        ends = np.cumsum([0, *(len(n) for _, n in units)])
        if "".join(n for _, n in units) != normal:
            units, ends = [(part, normal)], np.array([0, len(normal)])
        words = self._words(normal)
        sums, starts = self._sums(normal, words), [a for _, a in words]
        out, open_of = [0], (None, "", [0], [])
        for (unit, _), a, b in zip(units, ends, ends[1:]):
            for k in range(1, len(unit)):
                tail = self.normal(unit[:k])
                if tail == " ":
                    out.append(sums[a])
                    continue
                w = int(np.searchsorted(starts, a)) - 1  # the pre-token that the tail may go on
                word, at = words[w] if w >= 0 else ("", 0)
                before = normal[at:a]
                if w < 0 or len(before) > len(word):
                    at, before, word = a, "", ""
                if open_of[0] != (at, word):
                    letters, spots = self.encoder.lettered(word)
                    open_of = (at, word), letters, [0, *spots], self.encoder.states(letters)
                out.append(self._spliced(sums, at, before, tail, open_of))
            out.append(sums[b])
        return np.array(out)

    def _spliced(self, sums: np.ndarray, at: int, before: str, tail: str, open_of: tuple) -> int:
        """The count where ``before``, from ``at`` on, is followed by another ``tail`` than in the text."""
        last = before[-1:]
        pieces = self._words(last + tail)
        total = int(sums[at])
        if last and pieces and pieces[0][1] == 0 and len(pieces[0][0]) > 1:  # the tail goes on the pre-token
            _, letters, spots, states = open_of
            to = spots[len(before)]
            total += self.encoder.closed(states, letters[:to], self.encoder.lettered(pieces[0][0][1:])[0])
            pieces = pieces[1:]
        else:
            total = int(sums[at + len(before)])
            pieces = pieces[1:] if last else pieces
        return total + sum(self.table(w)[-1] for w, _ in pieces)

    def _sums(self, normal: str, words: list[tuple[str, int]]) -> np.ndarray:
        """The count at every prefix of a normalised text."""
        out = np.zeros(len(normal) + 1, np.int64)
        base = at = 0
        for word, start in words:
            out[at : start + 1] = base
            table = self.table(word)
            at = start + len(word)
            out[start + 1 : at + 1] = np.frombuffer(table, np.uint8 if isinstance(table, bytes) else np.uint32)
            out[start + 1 : at + 1] += base
            base += table[-1]
        out[at:] = base
        return out

    def _units(self, part: str) -> list[tuple[str, str]]:
        """Stretches that normalise independently, with what they become: a character and the marks that may join it, a run of white space."""
        if self.kept.joining is None:
            self.kept.joining = _may_join()
        joining = self.kept.joining
        units: list[list[str]] = []
        space = False
        for c in part:
            blank = self.normal(c) == " "
            if units and ((blank and space) or (not blank and not space and (c in joining or unicodedata.combining(c)))):
                units[-1].append(c)
            else:
                units.append([c])
            space = blank
        return [(u, self.normal(u)) for u in map("".join, units)]

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix whose count is within the budget.

        In a plain text the counts before pre-tokens only grow, so the cut is in the first whose end is over the budget, at a
        place that its own table of prefixes gives; what follows need not be read.
        """
        text = text or ""
        if self.plain(text) is None or self.special.search(text):
            return cut(self.every_prefix(text), budget)
        base = 0
        for m in re.finditer(WORD_PATTERN, text.lower()):
            n = self.totals.get(m[0]) or self.total(m[0])
            if base + n > budget:
                fits = [i for i, k in enumerate(self.table(m[0]), 1) if base + k <= budget]
                return m.start() + (fits[-1] if fits else 0)
            base += n
        return len(text)


def cut(counts: np.ndarray, budget: int) -> int:
    """The longest prefix within the budget, from the counts of all prefixes; a count may fall where tokens merge."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, and fit_chars: the code points of its longest prefix within the limit.

    A text within the limit fits whole; of the others every prefix's count is made, and the cut read from them.
    """

    def run(batches):
        counter = WordCounter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            fit = [len(t) if k <= limit else counter.longest_prefix(t, limit) for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "fit_chars"])

    rows = _columns(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, fit_chars long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def prefix_counts(docs: DataFrame, path: str, budgets: list[int] | None = None) -> DataFrame:
    """doc_id, counts (tokens of every prefix, by code points), cuts (code points that fit each budget)."""

    def run(batches):
        counter = WordCounter(path)
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: a text has as many counts as characters
                counts = counter.every_prefix(b.column(1)[i].as_py())
                cuts = [cut(counts, n) for n in budgets or []]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1], pa.array([counts], pa.list_(pa.int32())), pa.array([cuts], pa.list_(pa.int32()))], names=["doc_id", "counts", "cuts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _columns(docs).mapInArrow(run, f"doc_id {kind}, counts array<int>, cuts array<int>")


class IdPacker:
    """Token ids of texts under a byte-level vocabulary, packed as little-endian unsigned 32-bit numbers.

    Plain texts are split here and each distinct pre-token goes through the library's model once; other
    texts, and all texts where the library normalises, go through the library whole.
    """

    def __init__(self, path: str):
        kept = load(path)
        self.tokenizer, self.special, self.known = kept.tokenizer, kept.special, kept.ids
        self.model, self.whole = kept.tokenizer.model, kept.tokenizer.normalizer is not None
        self.split = re.compile(BYTE_PATTERN).findall
        self.plain = re.compile(PLAIN).fullmatch
        self.letters = dict(enumerate(_byte_letters()))

    def lettered(self, word: str) -> str:
        """A pre-token as letters for its bytes."""
        if word.isascii() and word.isprintable():  # of these only the space has another letter
            return word.replace(" ", self.letters[0x20])
        return word.encode().decode("latin-1").translate(self.letters)

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(self.lettered(word))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return self.known.keep(word, ids, len(word) + len(ids))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole or self.plain(text) is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, new = self.known.get, self._word
        return b"".join([known(w) or new(w) for w in self.split(text)])


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
