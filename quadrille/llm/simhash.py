"""SimHash near-duplicate classes by tiled exact comparison.

A fingerprint holds, for each of 64 bits, whether over half of a text's 3-word shingle hashes set it.
Two fingerprints link when at most ``RADIUS`` bits differ. Fingerprints are cut into four 16-bit
blocks; two that differ in at most two bits agree in at least two blocks, so the six pairs of blocks
name tiles that together hold every linked pair. Inside a tile numpy compares by exclusive-or and bit
counts, and skips what differs by more than the radius in its population count. A tile of more than
``TILE_ROWS`` fingerprints is cut again, by pairs of the four 8-bit blocks of its other 32 bits, after
which a tile can hold at most 65,536 fingerprints, whatever the input.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links like
any other; a text of one or two words hashes its whole word sequence; equal rows each return a row; a
null doc_id keeps its row and counts for the smallest id only if no other is there (then null); an
empty table gives an empty result. Other columns of the input are ignored. ``deduplicate`` keeps one row
of each class whatever the ids: rows without an id, or with the same id, stay if their classes differ.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, conform, materialize

RADIUS = 2
TILE_ROWS = 4096
SEED = 42
SLICE = 1 << 17


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def shingle_hashes(text: bytes | None, k: int = 3) -> list[int]:
    """XXH64 of each k-word shingle of the text, A-Z lower-cased; of all its words if they are fewer."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        return [digest(b" ".join(words), SEED)] if words else []
    if k == 3:
        return [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    return [digest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)]


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """64-bit fingerprints, as unsigned integers."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    ids: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            starts = np.cumsum([0, *map(len, held[:-1])])
            totals = np.array([len(h) for h in held])
            counts = np.add.reduceat(_bit_counts(np.concatenate(held)), starts, axis=0, dtype=np.uint32)
            bits = np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little")
            out[ids] = bits.view("<u8").ravel()
        held.clear(), ids.clear()
        size = 0

    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text), dtype="<u8")
        if len(hashes) > SLICE:  # a very long text: counted slice by slice
            counts = sum(_bit_counts(hashes[j : j + SLICE]).sum(0, dtype=np.int64) for j in range(0, len(hashes), SLICE))
            out[i] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
        elif len(hashes):
            held.append(hashes)
            ids.append(i)
            size += len(hashes)
            if size > SLICE:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _pairs_in_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one tile: each fingerprint is compared with those not yet reached."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int16)
    left = np.ones(len(fps), bool)
    a, b = [], []
    for seed in range(len(fps)):
        if not left[seed]:
            continue
        left[seed] = False
        stack = [seed]
        while stack:
            i = stack.pop()
            lo, hi = np.searchsorted(pop, pop[i] - radius, "left"), np.searchsorted(pop, pop[i] + radius, "right")
            near = lo + np.flatnonzero(left[lo:hi] & (np.bitwise_count(fps[lo:hi] ^ fps[i]) <= radius))
            if len(near):
                left[near] = False
                a.append(np.full(len(near), fps[i]))
                b.append(fps[near])
                stack.extend(near.tolist())
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def tile_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that follow each other with the same key."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    pop = np.bitwise_count(fps).astype(np.int16)
    small = np.repeat(sizes <= 32, sizes)
    run = np.repeat(np.arange(len(starts)), sizes)
    a, b = [], []
    for d in range(1, int(min(32, sizes.max()))):
        near = np.flatnonzero((run[d:] == run[:-d]) & small[d:] & (np.abs(pop[d:] - pop[:-d]) <= radius))
        if len(near):
            near = near[np.bitwise_count(fps[near] ^ fps[near + d]) <= radius]
            a.append(fps[near])
            b.append(fps[near + d])
    for i in np.flatnonzero(sizes > 32):
        x, y = _pairs_in_run(fps[starts[i] : starts[i] + sizes[i]], radius)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _tile_keys(fp: Column, width: int, within: list[int]) -> list[tuple[Column, list[int]]]:
    """Keys of the pairs of ``width``-bit blocks that start at ``within``, and the blocks each pair leaves out."""
    block = lambda at: F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)
    pairs = combinations(range(4), 2)
    return [(F.shiftleft(block(within[i]), width).bitwiseOR(block(within[j])), [at for k, at in enumerate(within) if k not in (i, j)]) for i, j in pairs]


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between the distinct ``fp``, enough of them to connect every class."""
    if not 0 <= radius <= 2:
        raise ValueError("tiles by two of four blocks are exact for a radius of 0, 1 or 2")
    fp = F.col("fp")
    tiles = [F.struct(F.lit(n).alias("n"), key.alias("key")) for n, (key, _) in enumerate(_tile_keys(fp, 16, [0, 16, 32, 48]))]
    rows = fps.select("fp", F.explode(F.array(*tiles)).alias("tile")).select("fp", "tile.n", "tile.key")
    large = rows.groupBy("n", "key").count().where(F.col("count") > tile_rows).select("n", "key", F.lit(True).alias("large"))
    rows = rows.join(large, ["n", "key"], "left")
    finer = None
    for n, (_, rest) in enumerate(_tile_keys(fp, 16, [0, 16, 32, 48])):
        subs = [F.struct(F.lit(m).alias("m"), k.alias("sub")) for m, (k, _) in enumerate(_tile_keys(fp, 8, [rest[0], rest[0] + 8, rest[1], rest[1] + 8]))]
        finer = (finer if finer is not None else F).when(F.col("n") == n, F.array(*subs))
    none = F.array(F.struct(F.lit(-1).alias("m"), F.lit(0).cast("long").alias("sub")))
    rows = rows.select("fp", "n", "key", F.explode(F.when(F.col("large"), finer).otherwise(none)).alias("x"))
    # One 64-bit name of the tile: n and m (6 bits), the 32-bit and the 16-bit key.
    name = F.shiftleft(F.col("n") * 7 + F.col("x.m") + 1, 48).bitwiseOR(F.shiftleft(F.col("key"), 16)).bitwiseOR(F.col("x.sub"))
    rows = rows.select(name.alias("tile"), "fp").repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        keys = fps = np.zeros(0, np.int64)
        for b in batches:
            keys = np.r_[keys, b.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, b.column(1).to_numpy(zero_copy_only=False)]
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last tile may go on
            yield from emit(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        yield from emit(keys, fps)

    def emit(keys, fps):
        a, b = tile_links(keys, fps.view(np.uint64), radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the root of each vertex of the undirected ``edges`` (a, b), one for each component.

    Every vertex takes its least neighbour, pointers are doubled, and the edges are contracted, until
    none is left; each round at least halves the vertices that still have an edge.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left, rounds = materialize(both(edges.select("a", "b"))), []
    while not left.isEmpty():
        parent = left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        parent = materialize(parent)
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = materialize(parent.join(up, "p").select("v", F.col("pp").alias("p")))
        rounds.append(parent)
        at_a, at_b = (parent.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        left = materialize(left.join(at_a, "a").join(at_b, "b").where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    root = rounds.pop().withColumnRenamed("p", "root")
    while rounds:
        later = root.select(F.col("v").alias("p"), F.col("root").alias("r"))
        root = rounds.pop().join(later, "p", "left").select("v", F.coalesce("r", "p").alias("root"))
    return root


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id): the least ``doc_id`` of ``prints`` that each distinct fingerprint reaches by links."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(components(links(distinct.select("fp"), radius)))
    members = roots.join(distinct, roots.v == distinct.fp).select("fp", "root", "least")
    least = members.groupBy("root").agg(F.min("least").alias("reached"))
    reached = members.join(least, "root").select("fp", "reached")
    classes = distinct.join(reached, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    return materialize(classes)  # a join of two plain tables, so that a fingerprint of many rows can be split


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    prints = materialize(fingerprints(docs))
    classes = _classes(prints, radius)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def _row_key(docs: DataFrame) -> Column:
    """A digest of a row's id and text, which rows of different classes can't share."""
    name = docs["doc_id"].cast("string")
    name = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return F.unhex(F.sha2(F.concat(name, F.lit(","), F.coalesce(docs["text"], F.lit(""))).cast("binary"), 256))


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each class, that of the smallest doc_id (a null only if no other is there); columns as they were.

    Among rows of a class with that same id, or all without one, the one whose digest of id and text is least stays. Classes are
    settled on ids and digests; texts are shuffled once, to find those that stay, and the few that are there several times once more.
    """
    spark, key = docs.sparkSession, _row_key(docs)
    rank = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), key.alias("key"))
    prints = materialize(fingerprints(docs.select(rank.alias("doc_id"), "text")))
    stays = prints.join(_classes(prints, radius), "fp").where("doc_id.key = component_id.key")
    stays = materialize(stays.groupBy(F.col("doc_id.key").alias("__key")).count())
    rows, folder = docs.withColumn("__row", key), f"{checkpoint_dir(spark)}/stays-{uuid.uuid4().hex}"
    found = []
    for name, which in (("once", "count = 1"), ("again", "count > 1")):  # written, so that Spark knows their sizes
        stays.where(which).select("__key").write.parquet(f"{folder}/{name}")
        known = spark.read.schema("__key binary").parquet(f"{folder}/{name}")
        found.append(rows.join(known, F.col("__row") == F.col("__key"), "left_semi"))
    once, again = found
    return conform(once.union(again.dropDuplicates(["__row"])), docs)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
