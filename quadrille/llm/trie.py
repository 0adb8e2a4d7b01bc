"""Conversation prefix trie by depth-band rollup.

A node is a distinct sequence of first turns, named by its depth and a 128-bit sum of a hash of each turn
and its place. Sums of that kind are running totals, so a conversation of any length is numbered and named
over sorted ranges of rows, which may cut it anywhere (``running``). Nodes are aggregated from the
conversations, and each has a smallest member, its owner, whose turns lead to it.

Totals over subtrees go by bands of ``BAND`` depths. Inside a band every node goes to its ancestors there,
``BAND`` at most, which its owner's row for the band lists. The first nodes of bands, with the totals of
their own bands, are the nodes of a trie that is ``BAND`` times less deep, whose totals are found in the
same way; completed, each goes to the ancestors in the band above. So rounds grow with the logarithm of
the depth, and rows by a factor of ``BAND`` at most.

Ids of the conversations that end at a node are joined by blocks of at most 2**``BLOCK_BITS`` ids, and one SHA-256 goes
through a node's blocks in order, a block at a time: the digest of a sequence can't be split further.

Defined results: turns are ordered by turn (null first), then role, then the digest of role and text; null
roles and texts are empty; equal rows are turns of their own; rows without a conv_id belong to no
conversation; texts of any length count whole; an empty table gives no rows, not even a root; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BAND = 16
#: A block of ids: those with the same bits but the last so many.
BLOCK_BITS = 12
#: Turns of a conversation that share one row of what holds for all of it.
STRETCH = 4096
#: Conversations of one group start alike: with up to ``HEADS - 1`` turns of the group's first.
GROUP, HEADS = 5, 9
NODE = ["depth", "p1", "p2"]


def running(df: DataFrame, group: str, order: list[str], sums: list[str], prior: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each of ``sums`` (longs, wrapping) replaced by its running total within the group, its row included.

    Columns named in ``prior``, one for each sum, get the total without the row.

    Rows are dealt by ranges of group and order, so that a large group lies in many partitions; what a
    group has in earlier partitions comes from one row of totals for each partition.
    """
    ranged = materialize(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order))
    at, of, to = ranged.columns.index(group), *([ranged.columns.index(c) for c in names] for names in (sums, prior))

    def longs(batch, k):
        return batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def last_totals(batches):
        first = last = None
        totals = np.zeros(len(of), np.uint64)
        for b in batches:
            if b.num_rows:
                groups = longs(b, at).view(np.int64)
                first = groups[0] if first is None else first
                if groups[-1] != last:
                    last, totals = groups[-1], np.zeros(len(of), np.uint64)
                since = int(np.searchsorted(groups, last))
                totals = totals + np.array([longs(b, k)[since:].sum(dtype=np.uint64) for k in of], np.uint64)
        if first is not None:
            row = [TaskContext.get().partitionId(), int(first), int(last), totals.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "first", "last", "totals"])

    before, held, carried = {}, None, [0] * len(of)
    for part, first, last, totals in sorted(ranged.mapInArrow(last_totals, "part long, first long, last long, totals array<long>").collect()):
        before[part] = first, carried if first == held else [0] * len(of)
        carried = [(a + b) % 2**64 for a, b in zip(carried, totals)] if last == held else [t % 2**64 for t in totals]
        held = last

    def add(batches):
        current, carry = before.get(TaskContext.get().partitionId(), (None, [0] * len(of)))
        for b in batches:
            if not b.num_rows:
                continue
            groups = longs(b, at).view(np.int64)
            starts = np.r_[groups[0] != current, groups[1:] != groups[:-1]]
            since = np.maximum.accumulate(np.where(starts, np.arange(len(groups)), -1))
            columns = list(b.columns)
            for j, k in enumerate(of):
                values = longs(b, k)
                upto = np.cumsum(values, dtype=np.uint64)
                total = upto + np.where(since >= 0, np.uint64(0) - (upto - values)[since], np.uint64(carry[j]))
                columns[k] = pa.array(total.view(np.int64))
                if prior:
                    columns[to[j]] = pa.array((total - values).view(np.int64))
                carry = [*carry[:j], int(total[-1]), *carry[j + 1 :]]
            current = groups[-1]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    schema = ", ".join(f"{c} {'long' if c in sums else kind}" for c, kind in ranged.dtypes)
    return ranged.mapInArrow(add, schema)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, n_bytes, pos): each turn by the digest of its role and text, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), half(1).alias("k1"), half(17).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("pos"))
    return materialize(running(rows, "conv_id", ["turn", "role", "k1", "k2"], ["pos"]).select("conv_id", "k1", "k2", "n_bytes", "pos"))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth) of all conversations, and their turns: (conv_id, depth, k1, k2, n_bytes, last)."""
    ends = turns.groupBy("conv_id").agg(F.max("pos").alias("end"))
    stretches = ends.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(end - 1) DIV {STRETCH}"))))
    rows = turns.withColumn("stretch", F.expr(f"(pos - 1) DIV {STRETCH}")).join(stretches, ["conv_id", "stretch"])
    return ends.select("conv_id", F.col("end").alias("depth")), rows.select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "n_bytes", (F.col("pos") == F.col("end")).alias("last"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations that start with the first h turns of their group's first, h by the id, and go on with their own after h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ends = turns.groupBy("conv_id").agg(F.max("pos").alias("end")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    bases = ends.select(F.col("conv_id").alias("base"), F.least("end", F.lit(HEADS - 1)).alias("given"))
    head = F.least("h", F.coalesce("given", F.lit(0)))
    convs = ends.join(bases, "base", "left").select("conv_id", "base", "h", "end", head.alias("head"), (head + F.greatest(F.col("end") - F.col("h"), F.lit(0))).alias("depth"))
    convs = materialize(convs)
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= head")
    heads = heads.select("conv_id", F.col("pos").alias("at"), "k1", "k2", "n_bytes", (F.col("pos") == F.col("depth")).alias("last"))
    # A conversation of very many turns meets its own row once for each stretch of them.
    stretches = convs.where("end > h").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(end - 1) DIV {STRETCH}"))))
    at = F.col("pos") - F.col("h") + F.col("head")
    tails = turns.withColumn("stretch", F.expr(f"(pos - 1) DIV {STRETCH}")).join(stretches, ["conv_id", "stretch"]).where("pos > h")
    tails = tails.select("conv_id", at.alias("at"), "k1", "k2", "n_bytes", (at == F.col("depth")).alias("last"))
    return convs.select("conv_id", "depth"), heads.unionAll(tails).withColumnRenamed("at", "depth")


def _banded(chains: DataFrame) -> DataFrame:
    """(conv_id, band, ids): the nodes of a conversation in one band, from its first depth on."""
    ids = F.sort_array(F.collect_list(F.struct(*NODE)))  # one for each depth of the band
    return chains.groupBy("conv_id", F.expr(f"(depth - 1) DIV {BAND}").alias("band")).agg(ids.alias("ids"))


def totals(nodes: DataFrame, chains: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(depth, p1, p2, *values) with the values of ``nodes`` (those, depth, p1, p2 and an owner's conv_id) summed over subtrees.

    ``chains`` holds at least the owners' nodes: conv_id, depth, p1, p2.
    """
    bands = materialize(_banded(chains)) if deepest > BAND else _banded(chains)
    summed = [F.sum(v).alias(v) for v in values]

    def to_ancestors(rows: DataFrame, upto: Column) -> DataFrame:
        """Rows (conv_id, band, values) to the nodes of that band, the first ``upto`` of them."""
        up = rows.join(bands, ["conv_id", "band"]).select(*values, F.explode(F.slice("ids", 1, upto)).alias("a"))
        return up.select(*[f"a.{c}" for c in NODE], *values)

    place = F.col("depth") - 1
    own = nodes.select("conv_id", F.expr(f"(depth - 1) DIV {BAND}").alias("band"), (place % BAND + 1).cast("int").alias("upto"), *values)
    within = to_ancestors(own, F.col("upto")).groupBy(*NODE).agg(*summed)
    if deepest <= BAND:
        return within
    within = materialize(within)
    level = F.expr(f"(depth - 1) DIV {BAND} + 1")
    firsts = nodes.where(place % BAND == 0).select("conv_id", *NODE).join(within, NODE)
    firsts = materialize(firsts.withColumn("depth", level))
    upper = totals(firsts, chains.where(place % BAND == 0).withColumn("depth", level), values, (deepest - 1) // BAND + 1)
    owners = firsts.select("conv_id", *NODE)
    below = upper.join(owners, NODE).where("depth > 1").select("conv_id", (F.col("depth") - 2).alias("band"), *values)
    return materialize(within.unionByName(to_ancestors(below, F.lit(BAND))).groupBy(*NODE).agg(*summed))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): the digest of the conv_ids that end at each node, ascending and joined by commas."""
    blocks = ends.groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    blocks = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")

    def run(batches):
        node, digest, done = None, None, []

        def flush():
            columns = list(zip(*done)) if done else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])
            done.clear()

        for b in batches:
            for *at, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if at != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield from flush()
        if node is not None:
            done.append((*node, digest.hexdigest()))
        yield from flush()

    return blocks.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    ``convs``: (conv_id, depth); ``turns``: (conv_id, depth, k1, k2, n_bytes, last).
    """
    code = lambda n: F.xxhash64(F.lit(n), "depth", "k1", "k2")
    none = F.lit(0).cast("long")
    rows = turns.select("conv_id", "depth", "n_bytes", "last", code(1).alias("p1"), code(2).alias("p2"), none.alias("up1"), none.alias("up2"))
    chains = materialize(running(rows, "conv_id", ["depth"], ["p1", "p2"], ("up1", "up2")))
    nodes = chains.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("n_bytes").alias("n_bytes"),
        F.every("last").alias("leaf"), F.any_value("up1").alias("up1"), F.any_value("up2").alias("up2"))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("p1"), F.col("up2").alias("p2")]
    nodes = materialize(nodes.select(*NODE, "conv_id", "n_convs", F.col("leaf").cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.struct(*up).alias("up")))
    values = ["n_leaves", "saved_tokens"]
    deepest, every = nodes.agg(F.max("depth")).first()[0] or 0, [none.alias(c) for c in NODE]
    # The root, from the conversations and all other nodes.
    whole = nodes.agg(*[F.sum(v).alias(v) for v in values]).select(*every, *[F.coalesce(v, F.lit(1 - k)).alias(v) for k, v in enumerate(values)])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(*every, "conv_id", "n_convs")
    summed = totals(nodes.select(*NODE, "conv_id", *values), chains.select("conv_id", *NODE), values, deepest).unionByName(whole)
    base = nodes.select(*NODE, "conv_id", "n_convs", "up").unionByName(root, allowMissingColumns=True)
    names = base.select(F.struct(*NODE).alias("up"), F.col("conv_id").alias("parent_conv_id"))
    parents = nodes.select(*NODE, "up").join(names, "up").select(*NODE, "parent_conv_id")  # a node of very many children is one row here, and can be met by parts
    children = nodes.groupBy("up").count().select(*[f"up.{c}" for c in NODE], F.col("count").alias("n_children"))
    ends = chains.where("last").select(*NODE, "conv_id").unionByName(convs.where("depth = 0").select(*every, "conv_id"))
    parts = [base.drop("up"), parents, children, summed, end_digests(ends)]
    sides = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = sides.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in ("conv_id", "n_convs", "parent_conv_id", "n_children", *values, "ends_sha256")]).where("conv_id IS NOT NULL")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), *values, F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    return trie(*as_they_are(turns_of(conversations)))


def op13_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
