"""Cross-tokenizer alignment by anchors at tokens that are marked with a space.

Each text is tokenised whole by a byte-level vocabulary (A) and a piece vocabulary (B). Where tokens of
both end at one byte and both go on with a token that starts with a space is an anchor; anchors cut the
two sequences into windows of ids. A window's groups, its id pairs and their text are the same wherever
its ids occur, so they are found once and kept by the tuple of ids (``Windows``).

In plain texts such windows are known before anything is tokenised: where a word, a run of other characters
or the white space before one starts, no token of A goes on, by its pre-tokens, and none of B, as no entry of
its vocabulary holds such a border. There windows are kept by their text, and only new ones are tokenised.
Texts of other characters, or with a border that an entry holds, go the way above.

How many documents hold a pair is counted over the whole corpus. Documents are dealt into blocks of at
most ``BLOCK_PAIRS`` entries of a document and a pair (or one document), which name their pairs by place
in a list of the block's own. Only these lists are shuffled by pair: a pair is one row for each block that
has it, so none is hot. What is known of the pairs comes back by block, and meets the block's documents
there. Nothing but one number for each id of A is broadcast.

Defined results: a null or empty text, and one that the tokens of either vocabulary don't give back byte
for byte after a space, has no tokens; strings of special tokens are plain text; equal rows each return a
row and each count as a document, null ids too; texts are never cut; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .tokens import LETTERS, PLAIN, IdPacker, _byte_letters, load, vocabulary

BLOCK_PAIRS = 1 << 21
#: Windows of more tokens are not kept.
LONG_WINDOW = 128
#: Windows of a text that are held at once.
STRETCH = 1 << 14
#: What a generation of the windows' cache may hold, in bytes, about.
CACHE_BYTES = 96 << 20

#: Windows of plain texts: a word or a run of other characters, with the white space before; letters after an apostrophe belong to it.
UNIT_PATTERN = rf"\s*(?:[{LETTERS}]+|[^\s{LETTERS}]+(?:(?<=')[{LETTERS}]+)?)|\s+"
#: Two characters with a border of such windows between them.
BORDER = rf"(?=(\S\s|[{LETTERS}][^\s{LETTERS}]|[^\s{LETTERS}][{LETTERS}]))"

SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Recent:
    """A cache that keeps what was used of late: of two generations the older goes when the younger reaches ``CACHE_BYTES``."""

    def __init__(self):
        self.young, self.old, self.held = {}, {}, 0

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.young[key] = found
        return found

    def keep(self, key, value, size: int):
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = value
        self.held += size
        return value


class PlainPacker(IdPacker):
    """Token ids under a byte-level vocabulary, strings of special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        kept = load(path)
        if not hasattr(kept, "plain"):
            kept.plain = type(kept.tokenizer).from_file(path)
            kept.plain.encode_special_tokens = True
        self.tokenizer, self.special = kept.plain, []


def _described(tokens: list[bytes]) -> SimpleNamespace:
    """The bytes of each id, how many they are, and whether they start with a space."""
    sizes = [len(t) for t in tokens]
    return SimpleNamespace(bytes=tokens, lengths=sizes, sizes=np.array(sizes, np.int64), spaced=np.array([t[:1] == b" " for t in tokens]))


def byte_tokens(tokenizer) -> SimpleNamespace:
    """The tokens of a byte-level vocabulary."""
    byte = {letter: b for b, letter in enumerate(_byte_letters())}
    words = {i: w for w, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    return _described([bytes(byte[c] for c in words.get(i, "")) for i in range(max(words) + 1)])


def piece_tokens(model) -> SimpleNamespace:
    """The tokens of a vocabulary of pieces, in which U+2581 stands for a space and <0xHH> for a byte."""
    ids = range(model.get_piece_size())
    return _described([bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids])


def held_borders(tokens: list[bytes]) -> set[str]:
    """The borders of plain texts' windows that entries of a vocabulary hold."""
    plain = re.compile(PLAIN).fullmatch
    return {m[1] for t in tokens for m in re.finditer(BORDER, t.decode(errors="replace")) if plain(m[1])}


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side are before each byte at which tokens of both end, given the tokens' sizes."""
    a, b = np.cumsum(a), np.cumsum(b)
    at = np.searchsorted(b, a)
    both = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return both + 1, at[both] + 1


def window_keys(a: np.ndarray, cuts_a: np.ndarray, b: np.ndarray, cuts_b: np.ndarray) -> list[bytes]:
    """The tuples of ids of the windows between the cuts, each as bytes: A's ids, a mark that is no id, and B's."""
    n_a, n_b = np.diff(cuts_a), np.diff(cuts_b)
    starts = np.cumsum(n_a + n_b + 2) - (n_a + n_b + 2)
    row = np.full(int((n_a + n_b + 2).sum()), 0xFFFFFFFF, np.uint32)  # ends each window: the high byte of an id is 0, so none starts sooner
    own, other = a[cuts_a[0] : cuts_a[-1]], b[cuts_b[0] : cuts_b[-1]]
    row[np.arange(len(own)) + np.repeat(starts - (cuts_a[:-1] - cuts_a[0]), n_a)] = own
    row[starts + n_a] = 1 << 31
    row[np.arange(len(other)) + np.repeat(starts + n_a + 1 - (cuts_b[:-1] - cuts_b[0]), n_b)] = other
    return row.tobytes().split(b"\xff\xff\xff\xff")[:-1]


class Windows:
    """The alignments of texts, window by window."""

    def __init__(self, path_a: str, path_b: str):
        self.packer = PlainPacker(path_a)
        kept = load(path_a)
        if getattr(kept, "aligned", (None,))[0] != path_b:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path_b)
            pieces = piece_tokens(model)
            # B's tokens of a window without a space before it are those after a line's end, if that is in no other entry.
            alone = kept.plain.normalizer is None and [pieces.bytes[i] for i in model.encode("\n")] == [b" ", b"\n"] and not any(b"\n" in t and t != b"\n" for t in pieces.bytes)
            held = re.compile("|".join(map(re.escape, sorted(held_borders(pieces.bytes)))) or r"(?!)") if alone else re.compile("")
            kept.aligned = path_b, model, byte_tokens(kept.plain), pieces, Recent(), held.search
        _, self.model, self.a, self.b, self.known, self.held = kept.aligned
        self.units = re.compile(UNIT_PATTERN).findall

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sequences of ids, if each gives back the space and the text."""
        whole = b" " + text.encode()
        a, b = np.frombuffer(self.packer.ids(" " + text), "<u4"), np.array(self.model.encode(text), "<u4")
        for ids, side in ((a, self.a), (b, self.b)):
            if b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole:
                return None
        return a, b

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """A window's ids, cut where tokens of both sides end."""
        size_a, size_b, out = self.a.lengths, self.b.lengths, []
        i = j = ahead = 0  # by how many bytes A's tokens are ahead
        while i < len(a):
            x, y, ahead = i, j, size_a[a[i]] - size_b[b[j]]
            i, j = i + 1, j + 1
            while ahead:
                if ahead < 0:
                    ahead += size_a[a[i]]
                    i += 1
                else:
                    ahead -= size_b[b[j]]
                    j += 1
            out.append((a[x:i], b[y:j]))
        return out

    def unit_tokens(self, units: list[str]) -> list[tuple[list[int], list[int]]] | None:
        """Both sequences of ids of each of some windows of plain texts, if each gives its window back."""
        model, split, lettered = self.packer.model.tokenize, self.packer.split, self.packer.lettered
        a = [[t.id for word in split(u) for t in model(lettered(word))] for u in units]
        whole = "".join([f"\n{u}" for u in units]).encode()
        b = self.model.encode(whole)[1:]  # without the space that B adds
        if b"".join([self.b.bytes[i] for i in b]) != whole or b"\n" + b"\n".join([b"".join([self.a.bytes[i] for i in ids]) for ids in a]) != whole:
            return None
        at = np.cumsum([len(u.encode()) + 1 for u in units])
        ends = np.cumsum(self.b.sizes[b])
        upto = np.searchsorted(ends, at)
        if (ends[upto] != at).any():
            return None
        cuts = [0, *(upto + 1).tolist()]
        return [(x, b[i + 1 : j]) for x, i, j in zip(a, cuts, cuts[1:])]

    def window(self, a: list[int], b: list[int]) -> tuple[int, bytes, bytes]:
        """(A's tokens and, from bit 32 on, B's, the groups' text, the linked pairs) of a short window."""
        n = len(a) | len(b) << 32
        if len(a) == 1 or len(b) == 1:  # one group
            return n, _text([(a, b)]), array("q", [x << 32 | y for x in a for y in b]).tobytes()
        groups = self.groups(a, b)
        return n, _text(groups), array("q", [x << 32 | y for own, other in groups for x in own for y in other]).tobytes()

    def long_window(self, a: list[int], b: list[int]) -> tuple[int, int, bytes, np.ndarray, np.ndarray]:
        """The same of a long one, which may have far more links than pairs: distinct pairs of each group, and how often they are linked."""
        groups, links, pairs, times = self.groups(a, b), 0, [], []
        for own, other in groups:
            (p, n), (q, m) = np.unique(np.array(own, np.int64), return_counts=True), np.unique(np.array(other, np.int64), return_counts=True)
            links += len(own) * len(other)
            pairs.append((p[:, None] << 32 | q).ravel())
            times.append((n[:, None] * m).ravel())
        return len(groups), links, _text(groups), np.concatenate(pairs), np.concatenate(times)

    def by_text(self, text: str):
        """For each stretch of a plain text, its windows' keys, and the ids of the windows of some numbers."""
        units = self.units(" " + text)
        for since in range(0, len(units), STRETCH):
            keys = units[since : since + STRETCH]
            yield keys, lambda new, keys=keys: self.unit_tokens([keys[k] for k in new])

    def by_ids(self, text: str):
        """The same of any text, of which nothing is yielded if its tokens don't give it back."""
        found = self.tokens(text)
        if found is None:
            return
        a, b = found
        ends_a, ends_b = shared_ends(self.a.sizes[a], self.b.sizes[b])
        anchor = np.ones(len(ends_a), bool)  # the last is the end of the text
        anchor[:-1] = self.a.spaced[a[ends_a[:-1]]] & self.b.spaced[b[ends_b[:-1]]]
        cuts_a, cuts_b = np.r_[0, ends_a[anchor]], np.r_[0, ends_b[anchor]]
        for since in range(0, len(cuts_a) - 1, STRETCH):
            at_a, at_b = cuts_a[since : since + STRETCH + 1], cuts_b[since : since + STRETCH + 1]
            yield window_keys(a, at_a, b, at_b), lambda new, at_a=at_a, at_b=at_b: [(a[at_a[k] : at_a[k + 1]].tolist(), b[at_b[k] : at_b[k + 1]].tolist()) for k in new]

    def aligned(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256, the distinct pairs in order, and how often each is linked."""
        row = None
        if text and self.packer.plain(text) is not None and self.held(text) is None:
            row = self.summed(self.by_text(text))
        if text and row is None:
            row = self.summed(self.by_ids(text))
        return row or (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))

    def summed(self, stretches) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None:
        """A text's row from its windows; nothing if there are none, or one's ids don't give it back."""
        digest, tokens, n_groups, n_links, pairs, times, known = hashlib.sha256(), 0, 0, 0, [], [], self.known
        for keys, ids in stretches:
            rows = list(map(known.young.get, keys))
            if None in rows:
                new = {}  # the places of each window that is not known
                for k in [k for k, row in enumerate(rows) if row is None]:
                    rows[k] = known.get(keys[k])
                    if rows[k] is None:
                        new.setdefault(keys[k], []).append(k)
                found = ids([places[0] for places in new.values()]) if new else []
                if found is None:
                    return None
                for (key, places), (own, other) in zip(new.items(), found):
                    if len(own) + len(other) <= LONG_WINDOW:
                        row = self.window(own, other)
                        known.keep(key, row, len(row[1]) + len(row[2]) + 4 * len(key) + 360)
                    else:
                        groups, links, words, linked, times_linked = self.long_window(own, other)
                        row = len(own) | len(other) << 32, words, b""
                        n_links += links * len(places)
                        pairs.append(linked)
                        times.append(times_linked * len(places))
                    for k in places:
                        rows[k] = row
            n, texts, linked = zip(*rows)
            tokens += sum(n)
            texts, linked = b";".join(texts), b"".join(linked)
            if n_groups:
                digest.update(b";")
            digest.update(texts)
            n_groups += texts.count(b"|")
            n_links += len(linked) // 8
            distinct, n = np.unique(np.frombuffer(linked, np.int64), return_counts=True)
            pairs.append(distinct)
            times.append(n)
        if not pairs:
            return None
        if len(pairs) > 1:
            distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
            pairs, times = [distinct], [np.bincount(at, np.concatenate(times)).astype(np.int64)]
        return tokens & 0xFFFFFFFF, tokens >> 32, n_groups, n_links, digest.hexdigest(), pairs[0], times[0]


def _text(groups: list[tuple[list[int], list[int]]]) -> bytes:
    return ";".join([f"{own[0] if len(own) == 1 else ','.join(map(str, own))}|{other[0] if len(other) == 1 else ','.join(map(str, other))}" for own, other in groups]).encode()


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, places binary, times binary"


def _packed(numbers: np.ndarray, narrow: str) -> bytes:
    """In the narrow type if all fit, else as unsigned 32-bit numbers; their count tells which."""
    wide = len(numbers) and numbers.max() > np.iinfo(narrow).max
    return numbers.astype("<u4" if wide else narrow).tobytes()


def _unpacked(data: bytes, n: int, narrow: str) -> np.ndarray:
    return np.frombuffer(data, narrow if len(data) == n * np.dtype(narrow).itemsize else "<u4").astype(np.int64)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """A row for each document, by block, with the places of its pairs in the block's list; and a row for each block with that list.

    Rows of blocks have no document: ``pairs`` in order, and ``docs``, how many of the block's documents have each.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [pa.int64(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "places", "times", "pairs", "docs"]

    def run(batches):
        gc.disable()  # it would go through all kept windows again and again, and nothing here makes cycles
        try:
            yield from found(batches)
        finally:
            gc.enable()

    def found(batches):
        windows = Windows(path_a, path_b)
        ids, rows, held, block = [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            lists = [r[5] for r in rows]
            pairs, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            places = np.split(at, np.cumsum([len(x) for x in lists])[:-1])
            made = [(block, *r[:5], len(p), _packed(np.diff(p, prepend=0), "<u2"), _packed(r[6], "u1"), None, None) for r, p in zip(rows, places)]
            for k in range(0, len(made), 1000):
                columns = [pa.array(c, f) for c, f in zip(zip(*made[k : k + 1000]), fields)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids[k : k + 1000]), *columns], names=["doc_id", *names])
            last = [pa.array([x], f) for x, f in zip((block, *[None] * 8, pairs.tobytes(), n.astype("<u4").tobytes()), fields)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ids[0].type), *last], names=["doc_id", *names])

        for b in batches:
            texts = b.column(1)
            for i in range(b.num_rows):
                row = windows.aligned(texts[i].as_py())
                ids.append(b.column(0)[i : i + 1])
                rows.append(row)
                held += len(row[5]) + 64
                if held >= block_pairs:
                    yield from flush()
                    ids, rows, held, block = [], [], 0, block + 1
        if rows:
            yield from flush()

    schema = f"doc_id {kind.simpleString()}, block long, {DOC}, pairs binary, docs binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, docs), a row for each pair of a block."""

    def run(batches):
        for b in batches:
            for block, pairs, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                pairs, docs = np.frombuffer(pairs, np.int64), np.frombuffer(docs, "<u4").astype(np.int64)
                for k in range(0, len(pairs), 10_000):
                    part = pairs[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(docs[k : k + 10_000])], names=["block", "pair", "docs"])

    return blocks.where("pairs IS NOT NULL").select("block", "pairs", "docs").mapInArrow(run, "block long, pair long, docs long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, pair, count, best) of each pair of a block: the documents of the corpus that have it, and whether no pair of its A id has more."""
    counted = materialize(_block_pairs(blocks).withColumn("count", F.sum("docs").over(Window.partitionBy("pair"))).withColumn("a", F.shiftright("pair", 32)))
    most = counted.groupBy("a").agg(F.max("count").alias("most"))  # one row for each id of A's vocabulary at most
    return counted.join(F.broadcast(most), "a").select("block", "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialize(aligned_blocks(docs, path_a, path_b, block_pairs))
    rows = blocks.where("pairs IS NULL").drop("pairs", "docs")
    out = ["doc_id", *SUMS, "groups_sha256"]

    def summed(own, known):
        order = np.argsort(known["pair"].to_numpy())  # the places are those in the sorted list
        count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order]
        n_best, total = [], []
        for n, places, times in zip(*(own[c].to_pylist() for c in ("n_pairs", "places", "times"))):
            at, times = np.cumsum(_unpacked(places, n, "<u2")), _unpacked(times, n, "u1")
            n_best.append(int(times[best[at]].sum()))
            total.append(int((times * count[at]).sum()))
        columns = {c: own[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({c: columns[c] for c in out})

    both = rows.groupBy("block").cogroup(pair_counts(blocks).groupBy("block"))
    return both.applyInArrow(summed, f"doc_id {kind}, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string")


def linked_pairs(docs: DataFrame, path_a: str, path_b: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(a, b, docs, best): the corpus's linked pairs of ids, how many documents have each, and whether no other b has more for its a."""
    counts = pair_counts(materialize(aligned_blocks(docs, path_a, path_b, block_pairs))).select("pair", "count", "best").distinct()
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), F.col("count").alias("docs"), "best")


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
