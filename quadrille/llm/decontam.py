"""Benchmark decontamination: which words of a document lie in a window of a benchmark item.

A prefix-filtered set join on word shingles. A window is ``WINDOW`` consecutive words of an item (all its
words, if it has fewer), and its tokens are its shingles of ``SHINGLE`` words (all its words, if fewer).
Shingles are ordered by how often the corpus has them; an exact occurrence must hold every shingle of
the window, so the necessary prefix is one shingle, the rarest, and its anchor. Documents and windows are
joined on anchors: the anchor's place in the window gives the one start that an occurrence can have;
those that would begin before the text or end after it are dropped, and the others are verified word
by word in the ``WINDOW`` words on either side that a document's row brings along.

Both sides are shuffled by anchor, whatever their sizes. So that documents only bring shingles which the
benchmark may have, each text is first held against a sketch of 2**``SKETCH_BITS`` bits of the shingles'
hashes: 1 MB, gathered as 64-bit words of it and broadcast, for any benchmark; what it lets through in
error the join drops. Copies of a text are joined once, by their digest.

Defined results: a null or empty text has no words and no hits; an item without words has no window;
the words that an item without an id hits count, but it is not among the items; items that repeat an id count once; equal documents each return a
row, null ids too; a text of any length is read whole, a row at a time; empty tables give no hits or no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, conform, materialize

WINDOW = 10
SHINGLE = 5
#: The largest sketch, of 8 MB, and the least; the bits that it has for each hash below that; the bits of a hash that name those it sets.
SKETCH_BITS, LEAST_BITS, BITS_EACH, MARKS = 26, 16, 24, (6, 14, 22)
FLUSH = 1 << 18

#: On UTF-8 bytes, A-Z lower-cased: the same as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on characters.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: An odd factor for each place in a shingle.
FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0x2545F4914F6CDD1D << k) % 2**64 | 1 for k in range(32)], np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS.findall((text or b"").lower())


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def shingles_of(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each shingle of ``size`` words; equal ones of different shingles cost time only."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * FACTORS[k] + codes[k : k + n]
        total ^= total >> np.uint64(29)
    return total * FACTORS[-1]


def windows_of(text: bytes | None, window: int = WINDOW, shingle: int = SHINGLE) -> dict[bytes, tuple[int, np.ndarray]]:
    """The windows of an item: number of words and shingles of each."""
    words = words_of(text)
    n = min(window, len(words))
    size = min(shingle, n)
    hashes = shingles_of(codes_of(words), size)
    return {b" ".join(words[i : i + n]): (n, hashes[i : i + n - size + 1]) for i in range(len(words) - n + 1)} if n else {}


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, window, n, grams): each item's windows with their shingles."""

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if found := windows_of(text, window, shingle):
                    sizes, grams = zip(*found.values())
                    columns = [pa.array([item] * len(found)), pa.array([w.decode() for w in found]), pa.array(sizes, pa.int32()), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "window", "n", "grams"])

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item string, window string, n int, grams array<long>")


class Sketch:
    """Which hashes may be among those of a DataFrame: each sets ``MARKS`` bits of one 64-bit word.

    The number of words follows the number of hashes, ``BITS_EACH`` bits for each, up to 2**``SKETCH_BITS``
    bits. Tasks get the words alone, as executors need not have this class.
    """

    def __init__(self, grams: DataFrame, bits: int = SKETCH_BITS):
        rows = grams.agg(F.approx_count_distinct("gram")).first()[0]
        self.shift = 64 - min(max(int(BITS_EACH * rows).bit_length(), LEAST_BITS), bits) + 6
        marks = [f"shiftleft(1L, CAST(shiftrightunsigned(gram, {at}) & 63 AS INT))" for at in MARKS]
        words = grams.groupBy(F.shiftrightunsigned("gram", self.shift).alias("word")).agg(F.bit_or(F.expr(" | ".join(marks))).alias("bits"))
        self.words = np.zeros(1 << (64 - self.shift), np.uint64)
        found = words.toArrow()  # at most one row for each 64 bits of the sketch
        self.words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)


def known(words: np.ndarray, shift: int, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in a sketch."""
    marks = np.zeros(len(hashes), np.uint64)
    for at in MARKS:
        marks |= np.uint64(1) << ((hashes >> np.uint64(at)) & np.uint64(63))
    return np.flatnonzero((words[hashes >> np.uint64(shift)] & marks) == marks)


def frequencies(docs: DataFrame, sketch: Sketch, sizes: list[int]) -> DataFrame:
    """(gram, n): how often all documents have the shingles that the sketch may know."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(sketch.words), sketch.shift

    def run(batches):
        words, held, size = shared.value, [], 0

        def counted():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                codes = codes_of(words_of(text))
                for k in sizes:
                    hashes = shingles_of(codes, k)
                    found = hashes[known(words, shift, hashes)]
                    if len(found):
                        held.append(found)
                        size += len(found)
                if size > FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "gram long, n long")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, offset, window, n): each window under its rarest shingle, of equally rare ones the first."""
    each = windows.select("window", "n", F.posexplode("grams").alias("offset", "gram"))
    rated = each.join(counts.withColumnRenamed("n", "times"), "gram", "left")
    best = rated.groupBy("window", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "gram")).alias("a"))
    return best.select("a.gram", "a.offset", "window", "n")


def candidates(docs: DataFrame, sketch: Sketch, sizes: list[int], window: int) -> DataFrame:
    """doc_id, n_words, the text's digest and what it has of anchors that the sketch may know: hash, place, words around it."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(sketch.words), sketch.shift
    found_type = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]))

    def run(batches):
        bits = shared.value
        for b in batches:
            n_words, digests, found = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                codes, own = codes_of(words), []
                for k in sizes:
                    hashes = shingles_of(codes, k)
                    for p in known(bits, shift, hashes).tolist():
                        lead = min(p, window - k)
                        own.append({"gram": int(hashes[p].view(np.int64)), "at": p, "lead": lead, "around": b" ".join(words[p - lead : p + window]).decode()})
                n_words.append(len(words))
                digests.append(hashlib.sha256(text).digest() if own else None)
                found.append(own)
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "digest", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, digest binary, found array<struct<gram:long,at:int,lead:int,around:string>>")


def occurrences(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(digest, start, end, window) of the windows that texts hold."""
    each = rows.where("digest IS NOT NULL").select("digest", F.explode("found").alias("f")).select("digest", "f.*").distinct()
    start = F.col("lead") - F.col("offset")
    met = each.join(anchors, "gram").where(start >= 0)
    met = met.where(F.array_join(F.slice(F.split("around", " "), start + 1, F.col("n")), " ") == F.col("window"))
    return met.select("digest", (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("n")).alias("end"), "window").distinct()


def _covered(spans):
    """Words that the spans hold, each counted once."""
    none = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def step(acc, s):
        return F.struct((acc["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("total"), F.greatest(acc["end"], s["end"]).alias("end"))

    return F.aggregate(F.sort_array(spans), none, step, lambda acc: acc["total"].cast("long"))


class Matching:
    """The documents' rows and the windows that they hold."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = SKETCH_BITS):
        of_items = materialize(item_windows(items, window, shingle))
        self.of_items = of_items.select("item", "window").distinct()
        windows = of_items.dropDuplicates(["window"]).select("window", "n", "grams")
        sizes = [r[0] for r in of_items.select(F.least("n", F.lit(shingle))).distinct().collect()]  # at most the size of a shingle
        counts = frequencies(docs, Sketch(windows.select(F.explode("grams").alias("gram")), bits), sizes)
        anchors = materialize(anchored(windows, counts))
        self.rows = materialize(candidates(docs, Sketch(anchors, bits), sizes, window))
        self.found = materialize(occurrences(self.rows, anchors))

    def by_text(self) -> DataFrame:
        """(digest, n_hit, items) of the texts with a hit."""
        spans = self.found.groupBy("digest").agg(_covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"))
        named = self.of_items.where("item IS NOT NULL")
        items = self.found.select("digest", "window").distinct().join(named, "window").select("digest", "item").distinct()
        items = items.groupBy("digest").agg(F.sort_array(F.collect_list("item")).alias("items"))
        return spans.join(items, "digest", "left")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated of each document."""
    matching = Matching(docs, items, window, shingle, bits)
    rows = matching.rows.drop("found")
    # Texts without a candidate meet nothing, and need no shuffle.
    without = rows.where("digest IS NULL").select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    joined = rows.where("digest IS NOT NULL").join(matching.by_text(), "digest", "left").select("doc_id", "n_words", "n_hit", "items")
    out = without.union(joined).select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = SKETCH_BITS) -> DataFrame:
    """The documents without a hit; columns as they were.

    The digests of texts with a hit are written first, so that Spark knows their size: it broadcasts them if they are few,
    and shuffles the documents by digest if not.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/contaminated-{uuid.uuid4().hex}"
    Matching(docs, items, window, shingle, bits).found.select(F.substring("digest", 1, 16).alias("__digest")).distinct().write.parquet(folder)
    hit = spark.read.schema("__digest binary").parquet(folder)
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return conform(docs.join(hit, F.substring(F.unhex(F.sha2(text, 256)), 1, 16) == hit["__digest"], "left_anti"), docs)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("items")
