"""Canonical blank node labels, isomorphism and digests.

Colours are refined in DataFrames: a blank node's new colour is a digest of its old one and of the
links around it, until the number of colours stands still. Nodes whose colour is theirs alone are done.
What is left, nodes that look alike, falls into connected groups, which are independent of each other.
A node that is linked to no other such node is its colour's; in each larger group nodes are told apart by
picking one of a class, refining again and keeping the least outcome, a group to a task and of at most
``SPLIT`` nodes. Groups of one form are copies, so it doesn't matter in what order they are numbered.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..terms import BNODE, Term, lit, make, n3
from .graphs import components

SPLIT = 2000


def _text(c: str, colour: Column) -> Column:
    return F.when(F.col(c)["k"] == BNODE, F.concat(F.lit("_:"), colour)).otherwise(n3(F.col(c)))


def _links_around(parts: DataFrame) -> DataFrame:
    """(lex, links): for each node the sums of its links' digests by words of 32 bits, which no hub makes longer."""
    hashes = parts.select("lex", F.sha2(F.col("link").cast("binary"), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(6)]
    return hashes.groupBy("lex").agg(*words).select("lex", F.concat_ws(" ", *[f"w{i}" for i in range(6)]).alias("links"))


def _is_blank(c: str) -> Column:
    return F.coalesce(F.col(c)["k"] == BNODE, F.lit(False))


def _slots(quads: DataFrame) -> list[str]:
    """The slots that hold blank nodes at all; the others need no join."""
    row = quads.agg(*[F.max(_is_blank(c)).alias(c) for c in "sog"]).first()
    return [c for c in "sog" if row[c]]


def _beside(rows: DataFrame, nodes: DataFrame, slots: list[str]) -> DataFrame:
    """Rows with the other columns of ``nodes`` (lex, ...) for each slot, as ``s_...``; NULL where it holds no blank node.

    Rows whose slot holds something else have a key of their own, so that a frequent value gathers in no task.
    """
    names = [n for n in nodes.columns if n != "lex"]
    types = dict(nodes.dtypes)
    for c in "sog":
        if c in slots:
            at = nodes.select(F.concat(F.lit("_:"), "lex").alias("at"), *[F.col(n).alias(f"{c}_{n}") for n in names])
            key = F.when(_is_blank(c), F.concat(F.lit("_:"), F.col(c)["lex"])).otherwise(F.xxhash64(*"spog").cast("string"))
            rows = rows.withColumn("at", key).join(at, "at", "left").drop("at")
        else:
            rows = rows.withColumns({f"{c}_{n}": F.lit(None).cast(types[n]) for n in names})
    return rows


def _same(a: str, b: str) -> Column:
    return _is_blank(a) & _is_blank(b) & (F.col(a)["lex"] == F.col(b)["lex"])


def _apart() -> Column:
    """Whether a quad links two blank nodes."""
    return reduce(or_, [_is_blank(a) & _is_blank(b) & (F.col(a)["lex"] != F.col(b)["lex"]) for a, b in ("so", "sg", "og")])


def _links(rows: DataFrame, slots: list[str]) -> DataFrame:
    """(lex, link): the links of each blank node as texts, the node itself as ``*``."""
    parts = []
    for c in slots:
        others = [F.lit("*") if o == c else F.when(_same(o, c), F.lit("*")).otherwise(F.coalesce(_text(o, F.col(f"{o}_colour")), F.lit(""))) for o in "sog"]
        parts.append(rows.where(_is_blank(c)).select(F.col(c)["lex"].alias("lex"), F.concat_ws("\t", F.lit(c), others[0], n3(F.col("p")), *others[1:]).alias("link")))
    return reduce(DataFrame.union, parts)


def refine(quads: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """(lex, colour) of the blank nodes, refined until stable.

    In the first round all colours are empty, so nothing is joined. Later rounds tell apart only nodes that
    are linked to other blank nodes: the links of the rest stay as they are, so only quads that link two are read again.
    """
    slots = _slots(quads) if slots is None else slots
    if not slots:
        return materialize(quads.select(F.col("s")["lex"].alias("lex"), F.lit("").alias("colour")).limit(0))
    around = _links_around(_links(quads.withColumns({f"{c}_colour": F.lit("") for c in "sog"}), slots))
    colours = materialize(around.select("lex", F.sha2(F.concat_ws("\n", F.lit(""), "links").cast("binary"), 256).alias("colour")))
    if len(slots) == 1 or (linking := materialize(quads.where(_apart()))).isEmpty():
        return colours
    slots = _slots(linking)
    linked = reduce(DataFrame.union, [linking.where(_is_blank(c)).select(F.col(c)["lex"].alias("lex")) for c in slots]).distinct()
    alone = colours.join(linked, "lex", "left_anti")
    colours = materialize(colours.join(linked, "lex", "left_semi"))
    total, before = colours.count(), colours.select("colour").distinct().count()
    while before < total:
        around = _links_around(_links(_beside(linking, colours, slots), slots))
        colours = materialize(around.join(colours, "lex").select("lex", F.sha2(F.concat_ws("\n", "colour", "links").cast("binary"), 256).alias("colour")))
        now = colours.select("colour").distinct().count()
        if now == before:
            break
        before = now
    return materialize(alone.union(colours))


def _digest(*parts: str) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _split(rows: list[tuple], colours: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Colours that tell linked look-alikes apart, and the quads among them in these colours; the least of all choices.

    A slot of a row is (a node of ``colours``, "") or ("", a text).
    """

    def settle(colour: dict[str, str]) -> dict[str, str]:
        number = len(set(colour.values()))
        while number < len(colour):
            around: dict[str, list[str]] = {n: [] for n in colour}
            for q in rows:
                for i, (n, _) in enumerate(q):
                    if n:
                        around[n].append("\t".join([str(i), *("*" if u == n else colour[u] if u else text for u, text in q)]))
            colour = {n: _digest(colour[n], *sorted(around[n])) for n in colour}
            if len(set(colour.values())) == number:
                break
            number = len(set(colour.values()))
        return colour

    def form(colour: dict[str, str]) -> list[str]:
        return sorted("\t".join("_:" + colour[n] if n else text for n, text in q) for q in rows)

    def best(colour: dict[str, str]) -> dict[str, str]:
        classes: dict[str, list[str]] = {}
        for n, c in colour.items():
            classes.setdefault(c, []).append(n)
        tied = sorted((len(ns), c) for c, ns in classes.items() if len(ns) > 1)
        if not tied:
            return colour
        c = tied[0][1]
        outcomes, seen = [], set()
        for n in sorted(classes[c]):
            split = settle({**colour, n: _digest(c, "picked")})
            key = tuple(form(split))
            if key in seen:  # an automorphic choice leads to the same
                continue
            seen.add(key)
            outcomes.append(split)
        return min((best(o) for o in outcomes), key=form)

    found = best(settle(colours))
    return found, form(found)


def _told_apart(group):
    """The nodes of one group with their colours among themselves and the group's form."""
    import pandas as pd

    rows = [tuple((getattr(r, f"{c}_tied") or "", getattr(r, f"{c}_text") or "") for c in "spog") for r in group.itertuples()]
    colours = {n: c for r in group.itertuples() for x in "sog" if (n := getattr(r, f"{x}_tied")) for c in [getattr(r, f"{x}_colour")]}
    found, form = _split(rows, colours)
    return pd.DataFrame({"root": group["root"].iloc[0], "lex": list(found), "own": list(found.values()), "form": _digest(*form)})


def _numbered(groups: DataFrame) -> DataFrame:
    """Groups (root, form, ...) of one form numbered, as ``copy``: within the partitions that hold them, then those before."""
    kept = groups.columns
    groups = materialize(groups.withColumn("part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("form", "part").orderBy("root"))
    before = F.sum("n").over(Window.partitionBy("form").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = groups.groupBy("form", "part").agg(F.count("*").alias("n")).select("form", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return groups.withColumn("within", within).join(counts, ["form", "part"]).select(*kept, (F.col("before") + F.col("within")).alias("copy"))


def labels(quads: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """(lex, label) of the blank nodes, the same for isomorphic graphs."""
    slots = _slots(quads) if slots is None else slots
    colours = refine(quads, slots)
    tied = colours.groupBy("colour").count().where("count > 1").select("colour", F.lit(True).alias("tied"))
    if tied.isEmpty():
        return colours.select("lex", F.concat(F.lit("cb"), "colour").alias("label"))
    nodes = materialize(colours.join(tied, "colour", "left"))
    linking = quads.where(_apart())
    slots = _slots(linking) if len(slots) > 1 else []
    alone = nodes.where("tied").select(F.col("lex").alias("root"), "lex", F.col("colour").alias("own"), F.col("colour").alias("form"))
    if slots:
        rows = _beside(linking, nodes.select("lex", "colour", F.when(F.col("tied"), F.col("lex")).alias("tied")), slots)
        rows = rows.withColumn("p_tied", F.lit(None).cast("string")).withColumn("p_text", n3(F.col("p")))
        for c in "sog":
            rows = rows.withColumn(f"{c}_text", F.when(F.col(f"{c}_tied").isNull(), _text(c, F.col(f"{c}_colour"))))
        pairs = [F.struct(F.col(f"{a}_tied").alias("s"), F.col(f"{b}_tied").alias("o")) for a, b in ("so", "sg", "og")]
        # Links to anything else are in the colours already.
        apart = F.filter(F.array(*pairs), lambda x: x["s"] != x["o"])
        rows = materialize(rows.withColumn("pairs", apart).where(F.size("pairs") > 0).select("pairs", *[f"{c}_{x}" for c in "spog" for x in ("tied", "text")], *[f"{c}_colour" for c in "sog"]))
        linked = materialize(components(rows.select(F.inline("pairs"))).withColumnRenamed("n", "lex"))
        largest = linked.groupBy("root").count().agg(F.max("count")).first()[0] or 0
        if largest > SPLIT:
            raise ValueError(f"more than {SPLIT} linked blank nodes look alike")
        of_group = rows.withColumn("lex", F.coalesce(*[f"{c}_tied" for c in "sog"])).join(linked, "lex").drop("lex", "pairs")
        grouped = of_group.groupBy("root").applyInPandas(_told_apart, "root string, lex string, own string, form string")
        found = materialize(grouped.union(alone.join(linked, "lex", "left_anti").select("root", "lex", "own", "form")))
        copies = found.join(_numbered(found.select("root", "form").distinct()).select("root", "copy"), "root")
    else:  # every node is a group of its own
        copies = _numbered(alone)
    better = copies.select("lex", F.sha2(F.concat_ws(" ", "form", "own", "copy").cast("binary"), 256).alias("label"))
    return better.union(nodes.where("tied IS NULL").select("lex", F.col("colour").alias("label"))).select("lex", F.concat(F.lit("cb"), "label").alias("label"))


def canonical(quads: DataFrame) -> DataFrame:
    """The quads with canonical blank node labels."""
    slots = _slots(quads)
    named = _beside(quads, labels(quads, slots), slots)
    return named.select(*[F.when(_is_blank(c), make(BNODE, F.col(f"{c}_label"))).otherwise(F.col(c)).alias(c) if c in "sog" else c for c in "spog"]).distinct()


def digest(quads: DataFrame) -> str:
    """A digest that isomorphic graphs share."""
    return signature(canonical(quads))


def signature(named: DataFrame) -> str:
    """The digest of canonical quads: the sum, modulo 2^256, of theirs."""
    line = F.concat_ws(" ", *[F.coalesce(n3(F.col(c)), F.lit("")) for c in "spog"])
    hashes = named.select(F.sha2(line.cast("binary"), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    parts = hashes.groupBy(F.spark_partition_id().alias("part")).agg(*words)  # sums of a part fit 64 bits
    row = parts.agg(*[F.sum(F.col(f"w{i}").cast("decimal(20,0)")) for i in range(8)]).first()
    return f"{sum(int(v or 0) << (32 * (7 - i)) for i, v in enumerate(row)) % 2**256:064x}"


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    a, b = a.distinct(), b.distinct()
    if a.count() != b.count():
        return False
    return digest(a) == digest(b)


def similar(a: DataFrame, b: DataFrame) -> bool:
    """A cheap test: the same quads once every blank node is called the same."""
    def squash(q: DataFrame) -> DataFrame:
        same = lit(Term(BNODE, "x"))
        return q.select(*[F.when(F.col(c)["k"] == BNODE, same).otherwise(F.col(c)).alias(c) for c in "spog"])

    a, b = squash(a), squash(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
