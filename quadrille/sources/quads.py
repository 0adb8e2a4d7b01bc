"""Where triple patterns are read: explicit quads, or tables mapped to a virtual graph.

A source answers ``match(patterns, graph)`` with a plan of all the patterns joined. ``graph`` is None for
the default graph, a term for a named one, or a variable that ranges over the named ones.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val
from ..plans import plan as P
from ..plans.plan import Plan, fresh
from ..terms import IRI, IRI_KIND, LITERAL, RDF, Term, Var, equal, lit, make, term_schema

TYPE = IRI(RDF + "type")


def unit(spark: SparkSession) -> Plan:
    """One solution that binds nothing."""
    return Plan(spark.range(1).select(F.lit(1).alias(fresh("one"))))


def nothing(spark: SparkSession) -> Plan:
    return Plan(spark.range(0).select(F.lit(1).alias(fresh("one"))))


def greedy(patterns: list, weight) -> list:
    """Patterns from the most selective on, each connected with an earlier one where possible."""
    left, bound, out = list(patterns), set(), []
    while left:
        best = min(left, key=lambda p: (bool(out) and not bound & _vars(p), weight(p), -len(bound & _vars(p))))
        left.remove(best)
        bound |= _vars(best)
        out.append(best)
    return out


def _vars(pattern) -> set[str]:
    return {t.name for t in pattern if isinstance(t, Var)}


class QuadFrame:
    """Explicit quads in a DataFrame (s, p, o, g); g is NULL in the default graph.

    With ``union`` the default graph of a query is the union of all graphs; ``single`` promises that no
    triple is in two graphs, so that the union needs no duplicate removal.
    """

    def __init__(self, quads: DataFrame, union: bool = True, single: bool = False, graphs: DataFrame | None = None):
        self.quads, self.union, self.single, self.known = quads, union, single, graphs
        self.spark = quads.sparkSession

    def scoped(self, default: list[Term], named: list[Term]) -> QuadFrame:
        """The dataset of FROM and FROM NAMED clauses."""
        if not default and not named:
            return self
        g = F.col("g")
        none = F.lit(False)
        in_default = reduce(lambda a, t: a | equal(g, t), default, none)
        in_named = reduce(lambda a, t: a | equal(g, t), named, none)
        triples = self.quads.where(in_default).select("s", "p", "o").distinct().select("s", "p", "o", lit(None).alias("g"))
        return QuadFrame(triples.unionByName(self.quads.where(in_named)), union=False)

    def in_graph(self, graph: Term | Var | None) -> DataFrame:
        if isinstance(graph, Var):
            return self.quads.where("g IS NOT NULL")
        if graph is not None:
            return self.quads.where(equal(F.col("g"), graph))
        if not self.union:
            return self.quads.where("g IS NULL")
        triples = self.quads.select("s", "p", "o")
        return triples if self.single else triples.distinct()

    def graphs(self, name: str) -> Plan:
        names = self.quads.where("g IS NOT NULL").select("g")
        names = names if self.known is None else names.unionByName(self.known.where("g IS NOT NULL").select("g"))
        col = fresh(name)
        return Plan(names.distinct().select(F.col("g").alias(col)), {name: Val("term", F.col(col))}, frozenset([name]))

    def nodes(self, name: str, graph: Term | Var | None) -> Plan:
        """Every subject and object."""
        rows, extra = self.in_graph(graph), ["g"] if isinstance(graph, Var) else []
        both = rows.select(F.col("s").alias("n"), *extra).union(rows.select(F.col("o").alias("n"), *extra)).distinct()
        return self._plan(both, {name: "n"} | ({graph.name: "g"} if extra else {}))

    def _plan(self, df: DataFrame, columns: dict[str, str]) -> Plan:
        names = {n: fresh(n) for n in columns}
        df = df.select(*[F.col(c).alias(names[n]) for n, c in columns.items()]) if columns else df.select(F.lit(1).alias(fresh("one")))
        return Plan(df, {n: Val("term", F.col(names[n])) for n in columns}, frozenset(columns))

    def narrowed(self, pattern) -> QuadFrame:
        """A source that need only hold the quads of a pattern; a layout on disk reads less for it."""
        return self

    def one(self, pattern, graph: Term | Var | None) -> Plan:
        df, at = self.narrowed(pattern).in_graph(graph), {}
        slots = list(zip("spo", pattern)) + ([("g", graph)] if isinstance(graph, Var) else [])
        for c, t in slots:
            if isinstance(t, Term):
                df = df.where(equal(F.col(c), t))
            elif t.name in at:
                df = df.where(F.col(c) == F.col(at[t.name]))
            else:
                at[t.name] = c
        return self._plan(df, at)

    def match(self, patterns, graph: Term | Var | None) -> Plan:
        if not patterns:
            return self.graphs(graph.name) if isinstance(graph, Var) else unit(self.spark)

        def weight(p) -> tuple:
            return (sum(isinstance(t, Var) for t in p), isinstance(p[0], Var), isinstance(p[2], Var))

        return reduce(P.join, [self.one(p, graph) for p in greedy(patterns, weight)])


@dataclass
class Property:
    """A predicate read from a column: a literal of a native kind, or a link to ``prefix`` + key."""

    predicate: Term
    column: str
    kind: str
    prefix: str = ""
    bits: int = 63  # of int: no value is beyond 2 to this power

    def val(self) -> Val:
        return Val(self.kind, F.col(f"`{self.column}`"), self.prefix, self.bits)


@dataclass
class TableMap:
    """One row, one subject: ``prefix`` + the key column, which must be unique and not NULL."""

    name: str
    df: DataFrame
    key: Column
    prefix: str
    cls: Term
    graph: Term
    properties: list[Property] = field(default_factory=list)

    def __post_init__(self):
        self.key_kind = self.df.select(self.key.alias("k")).dtypes[0][1]

    def of(self, predicate: Term) -> list[Property]:
        return [p for p in self.properties if p.predicate == predicate]

    def holds(self, predicate: Term, o) -> bool:
        """Whether rows may have the predicate, with the object if that is a constant."""
        if predicate == TYPE:
            return not isinstance(o, Term) or o == self.cls
        return any(not isinstance(o, Term) or _equals(p.val(), o) is not None for p in self.of(predicate))

    def meets(self, other: TableMap) -> bool:
        """Whether the two may describe one subject: by one prefix, or by one that goes on from the other as its keys may."""
        short, long = sorted((self, other), key=lambda t: len(t.prefix))
        rest = long.prefix[len(short.prefix) :]
        return long.prefix.startswith(short.prefix) and (not rest or short.key_kind == "string" or rest.isdigit())

    def repeats(self, other: TableMap) -> bool:
        """Whether the two may have the same predicate and object."""
        return self.cls == other.cls or any(other.of(p.predicate) for p in self.properties)


def _equals(val: Val, term: Term) -> Column | None:
    """Whether a native value is this very term; None if it never is."""
    if val.kind == "iri":
        if term.k != IRI_KIND or not term.lex.startswith(val.prefix):
            return None
        return val.col.cast("string") == term.lex[len(val.prefix) :]
    if term.k != LITERAL:
        return None
    c = V.constant(term)
    if c.kind == val.kind:
        return val.col == c.col
    return V.term_of(val) == lit(term) if term.dt == V.DATATYPES.get(val.kind) else None


class MappedTables:
    """A virtual graph over tables, in which several tables may describe one subject.

    Patterns of one subject are parted by the tables that hold their predicates: those of one table are
    read in a single scan, and the scans are joined on the subject's key. Prefixes that the subject must
    have, from a constant, from links to it or from its other patterns, leave out tables before any is read.
    """

    def __init__(self, spark: SparkSession, tables: list[TableMap]):
        self.spark, self.tables = spark, tables

    def scoped(self, default: list[Term], named: list[Term]) -> MappedTables | QuadFrame:
        if not default and not named:
            return self
        return QuadFrame(self.quads(), union=True).scoped(default, named)

    def quads(self, only: Collection[str] | None = None) -> DataFrame:
        """All triples, made explicit; with ``only``, those of some predicates, without making the terms of others."""
        parts = []
        for t in self.tables:
            properties = [p for p in t.properties if only is None or p.predicate.lex in only]
            typed = only is None or TYPE.lex in only
            if not (properties or typed):
                continue
            rows = t.df.select(make(2, F.concat(F.lit(t.prefix), t.key.cast("string"))).alias("s"), F.explode(_pairs(t, properties, typed)).alias("x"))
            parts.append(rows.select("s", "x.p", "x.o", lit(t.graph).alias("g")).where("o IS NOT NULL"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], term_schema("s", "p", "o", "g"))

    def graphs(self, name: str) -> Plan:
        col = fresh(name)
        df = self.spark.createDataFrame([(g,) for g in sorted({t.graph.lex for t in self.tables})], f"`{col}` string")
        return Plan(df, {name: Val("iri", F.col(col))}, frozenset([name]))

    def nodes(self, name: str, graph: Term | Var | None) -> Plan:
        return QuadFrame(self.quads(), single=True).nodes(name, graph)

    # Which tables a pattern may be read from

    def _may_describe(self, subject, graph, prefixes: set[str] | None) -> list[TableMap]:
        out = [t for t in self.tables if not isinstance(graph, Term) or t.graph == graph]
        if isinstance(subject, Term):
            return [t for t in out if subject.k == IRI_KIND and subject.lex.startswith(t.prefix)]
        return [t for t in out if prefixes is None or any(t.prefix.startswith(p) or p.startswith(t.prefix) for p in prefixes)]

    def _families(self, tables: list[TableMap], graph) -> list[list[TableMap]]:
        """Tables that may describe the same subjects; within one graph, where the graph is a variable."""
        out: list[list[TableMap]] = []
        for t in tables:
            near = [f for f in out if any(t.meets(u) and not (isinstance(graph, Var) and t.graph != u.graph) for u in f)]
            out = [f for f in out if f not in near] + [[t, *(u for f in near for u in f)]]
        return [[t for t in tables if t in f] for f in out]

    def _prefixes(self, stars: dict, graph) -> dict[str, set[str]]:
        """The prefixes that a variable's IRI must have one of, where patterns with a constant predicate say so."""
        out: dict[str, set[str]] = {}

        def narrow(name: str, found: set[str]) -> None:
            known = out.get(name)
            out[name] = found if known is None else {p for p in found | known if any(p.startswith(q) for q in found) and any(p.startswith(q) for q in known)}

        for subject, patterns in stars.items():
            for _, p, o in patterns:
                tables = [t for t in self._may_describe(subject, graph, None) if t.holds(p, o)]
                if isinstance(subject, Var):
                    narrow(subject.name, {t.prefix for t in tables})
                if isinstance(o, Var) and p != TYPE:
                    narrow(o.name, {x.prefix for t in tables for x in t.of(p) if x.kind == "iri"})
        return out

    # Plans

    def _holding(self, subject, patterns, graph: Term | Var | None, prefixes: set[str] | None) -> list[tuple[list[TableMap], list]]:
        """Families that hold all of the patterns, and the tables that hold each."""
        found = [(f, [[t for t in f if t.holds(p, o)] for _, p, o in patterns]) for f in self._families(self._may_describe(subject, graph, prefixes), graph)]
        return [(f, holders) for f, holders in found if all(holders)]

    def star(self, subject, patterns, graph: Term | Var | None, prefixes: set[str] | None = None, loose=()) -> Plan:
        """Patterns with constant predicates and one subject, and ``loose`` ones of it where single tables hold the others."""
        plans = []
        for family, holders in self._holding(subject, patterns, graph, prefixes):
            if (plan := self._joined(family, holders, subject, patterns, graph, loose)) is not None:
                plans.append(plan)
        if plans:
            return reduce(P.union, plans)
        names = _vars((subject, *(x for p in (*patterns, *loose) for x in p), graph))
        return nothing(self.spark).project(sorted(names))

    def _joined(self, family, holders, subject, patterns, graph, loose=()) -> Plan | None:
        """One scan for each table that alone holds some of the patterns, a union for each pattern that several hold."""
        shared = Var("_:" + fresh("s")) if isinstance(subject, Term) else subject  # a constant is a key of the join too
        groups: dict = {}
        for tables, pattern in zip(holders, patterns):
            groups.setdefault(tables[0].name if len(tables) == 1 else pattern, (tables, []))[1].append(pattern)
        if len(groups) == 1 and len(holders[0]) == 1:
            return self._scan(holders[0][0], subject, patterns, graph, loose=loose)
        plain = len({t.key_kind for t in family}) == 1
        plans = []
        for tables, own in sorted(groups.values(), key=lambda g: (len(g[0]), -sum(isinstance(o, Term) for _, _, o in g[1]))):
            found = [p for t in tables if (p := self._scan(t, subject, own, graph, shared, plain)) is not None]
            if not found:
                return None
            plan = reduce(P.union, found)
            if len(found) > 1 and graph is None:  # a triple that two tables have is one triple of the union of their graphs
                plan = Plan(plan.df.distinct(), plan.vars, plan.certain)
            plans.append(plan)
        plan = reduce(P.join, plans)
        return plan.project([n for n in plan.vars if n != shared.name]) if isinstance(subject, Term) else plan

    def _scan(self, t: TableMap, subject, patterns, graph, shared: Var | None = None, plain: bool = True, loose=()) -> Plan | None:
        key = Val("iri", t.key if plain else t.key.cast("string"), t.prefix)
        rows = Bindings(t.df)
        if not rows.bind(subject, key):
            return None
        if isinstance(subject, Term) and shared is not None:
            rows.bind(shared, key)
        if isinstance(graph, Var) and not rows.bind(graph, Val("iri", F.lit(t.graph.lex))):
            return None
        for _, p, o in patterns:
            if p == TYPE:
                if isinstance(o, Var) and not rows.bind(o, Val("iri", F.lit(t.cls.lex))):
                    return None
                continue
            options = t.of(p)
            if len(options) > 1:
                raise ValueError(f"{p.lex} has two columns in {t.name}")
            rows.df = rows.df.where(F.col(f"`{options[0].column}`").isNotNull())
            if not rows.bind(o, options[0].val()):
                return None
        return rows.plan() if all(self._spread(rows, t, p, o) for _, p, o in loose) else None

    @staticmethod
    def _spread(rows: Bindings, t: TableMap, predicate: Var, o) -> bool:
        """A row for each column that a pattern with a variable predicate matches; False if none can."""
        properties = [p for p in t.properties if not isinstance(o, Term) or _equals(p.val(), o) is not None]
        typed = not isinstance(o, Term) or o == t.cls
        if not (properties or typed):
            return False
        if isinstance(o, Term) and not typed:  # some column must have the constant
            rows.df = rows.df.where(reduce(lambda a, b: a | b, [_equals(p.val(), o) for p in properties]))
        pair = fresh("pair")
        rows.df = rows.df.withColumn(pair, F.explode(_pairs(t, properties, typed))).where(F.col(pair)["o"].isNotNull())
        return rows.bind(predicate, Val("term", F.col(pair)["p"])) and rows.bind(o, Val("term", F.col(pair)["o"]))

    def loose(self, pattern, graph: Term | Var | None, prefixes: set[str] | None = None) -> Plan:
        """A pattern whose predicate is a variable, from the tables and columns that can match it."""
        subject, predicate, o = pattern
        tables, plans = self._may_describe(subject, graph, prefixes), []
        for t in tables:
            key = Val("iri", t.key if len({u.key_kind for u in tables}) == 1 else t.key.cast("string"), t.prefix)
            rows = Bindings(t.df)
            if not rows.bind(subject, key):
                continue
            if isinstance(graph, Var) and not rows.bind(graph, Val("iri", F.lit(t.graph.lex))):
                continue
            if self._spread(rows, t, predicate, o):
                plans.append(rows.plan())
        if not plans:
            return nothing(self.spark).project(sorted(_vars((*pattern, graph))))
        plan = reduce(P.union, plans)
        if graph is None and any(t is not u and t.meets(u) and t.repeats(u) for t in tables for u in tables):
            plan = Plan(plan.df.distinct(), plan.vars, plan.certain)
        return plan

    def match(self, patterns, graph: Term | Var | None) -> Plan:
        if not patterns:
            return self.graphs(graph.name) if isinstance(graph, Var) else unit(self.spark)
        stars: dict = {}
        loose = []
        for p in patterns:
            if isinstance(p[1], Var):
                loose.append(p)
            else:
                stars.setdefault(p[0], []).append(p)
        prefixes = self._prefixes(stars, graph)

        def of(subject) -> set[str] | None:
            return prefixes.get(subject.name) if isinstance(subject, Var) else None

        def alone(subject) -> bool:
            """Whether single tables hold a star, so that any other pattern of its subject is read in the same scan."""
            found = self._holding(subject, stars[subject], graph, of(subject))
            return isinstance(subject, Var) and bool(found) and all(len(f) == 1 for f, _ in found)

        groups = [(s, ps, [p for p in loose if p[0] == s] if alone(s) else []) for s, ps in stars.items()]
        loose = [p for p in loose if not any(p in g[2] for g in groups)]

        def names(group) -> set[str]:
            return _vars([group[0], *(x for p in (*group[1], *group[2]) for x in p)])

        out, bound, subjects = None, set(), set()
        while groups:
            best = min(groups, key=lambda g: (out is not None and not bound & names(g), not isinstance(g[0], Term), -sum(isinstance(p[2], Term) for p in g[1])))
            groups.remove(best)
            plan = self.star(best[0], best[1], graph, of(best[0]), best[2])
            subjects |= _vars([best[0]])
            # a value that is a subject of neither side may be in any number of rows of both
            out = plan if out is None else P.join(out, plan, dealt=not subjects & set(P.shared(out, plan)))
            bound |= names(best)
        for p in greedy(loose, lambda p: (isinstance(p[0], Var) and p[0].name not in bound, isinstance(p[2], Var))):
            plan = self.loose(p, graph, of(p[0]))
            out = plan if out is None else P.join(out, plan)
        return out


class Bindings:
    """A table's rows with the values that variables take in them."""

    def __init__(self, df: DataFrame):
        self.df, self.vals = df, {}

    def bind(self, term, val: Val) -> bool:
        """Give a variable its value, or keep the rows that have the constant or the earlier value; False if none can."""
        if isinstance(term, Term):
            if val.kind == "term":
                self.df = self.df.where(equal(val.col, term))
                return True
            same = _equals(val, term)
            if same is None:
                return False
            self.df = self.df.where(same)
        elif term.name in self.vals:
            self.df = self.df.where(V.equal_terms(self.vals[term.name], val))
        else:
            self.vals[term.name] = val
        return True

    def plan(self) -> Plan:
        names = {n: fresh(n) for n in self.vals}
        df = self.df.select(*[v.col.alias(names[n]) for n, v in self.vals.items()]) if self.vals else self.df.select(F.lit(1).alias(fresh("one")))
        return Plan(df, {n: v.named(names[n]) for n, v in self.vals.items()}, frozenset(self.vals))


def _pairs(t: TableMap, properties: list[Property], typed: bool) -> Column:
    """Predicates and objects of a row, some objects NULL."""
    pairs = [F.struct(lit(TYPE).alias("p"), lit(t.cls).alias("o"))] if typed else []
    return F.array(*pairs, *[F.struct(lit(p.predicate).alias("p"), V.term_of(p.val()).alias("o")) for p in properties])


NATIVE_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "dbl", "float": "dbl", "string": "str", "boolean": "bool", "timestamp_ntz": "dtm", "timestamp": "dtm"}
BASE = "http://ex/"
VOCAB = BASE + "v#"


def map_table(name: str, df: DataFrame, key: str | None, links: dict[str, str] | None = None, base: str = BASE, about: str | None = None) -> TableMap:
    """The default mapping of a table: column c is predicate v#c; a foreign key links by v#c_ref as well.

    ``about`` names the table whose subjects this one describes too, if it isn't its own. Without a key, rows are told apart by a digest of all their columns.
    """
    properties = []
    columns = df.columns
    for c, kind in df.dtypes:
        if kind not in NATIVE_KINDS:
            continue
        native = NATIVE_KINDS[kind]
        if native == "int" and kind != "bigint":
            df = df.withColumn(c, F.col(c).cast("long"))
        if kind == "timestamp":
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
        properties.append(Property(IRI(f"{base}v#{c}"), c, native, bits={"tinyint": 7, "smallint": 15, "int": 31}.get(kind, 63)))
        if links and c in links:
            properties.append(Property(IRI(f"{base}v#{c}_ref"), c, "iri", f"{base}{links[c]}/"))
    at = F.col(key) if key else F.md5(F.to_json(F.struct(*columns)))
    return TableMap(name, df, at, f"{base}{about or name}/", IRI(f"{base}c#{name.capitalize()}"), IRI(f"{base}g/{name}"), properties)


