"""The Python face of the engine: datasets, graphs and query results over DataFrames.

Everything is immutable underneath: an update makes new DataFrames, and a reader keeps what it had.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import graphs as G
from .plans import nodes as N
from .plans.compiler import compile_pattern
from .plans.plan import Plan
from .plans.syntax import parse_query, parse_update
from .session import materialize
from .sources.quads import MappedTables, QuadFrame
from .terms import RDF, RDFS, XSD, BNode, IRI, Literal, Term, Var, equal, lit, make, shorten, term_schema

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#"}


def term(x) -> Term:
    """A term of a term or a Python value."""
    return x if isinstance(x, Term) else Literal(x)


def _term(struct) -> Term | None:
    return None if struct is None else Term(*struct)


class Result:
    """What a query gives: solutions, a truth value, or a graph."""

    def __init__(self, query: N.Query, plan: Plan, source):
        self.query, self.plan, self.source = query, plan, source
        self.form, self.names = query.form, query.names

    @property
    def df(self) -> DataFrame:
        """Solutions as term columns, named by variable."""
        return self.plan.df.select(*[V.term_of(self.plan.vars[n]).alias(n) for n in self.names])

    def native(self, decimals: str = "double", integers: str = V.BIG) -> DataFrame:
        """Solutions as native columns: numbers, strings, booleans, timestamps; IRIs and other terms as text.

        ``integers`` is the type of those that may not fit a long; a value beyond it is an error.
        """
        def one(n: str) -> Column:
            v = self.plan.vars[n]
            if v.kind in ("term", "iri", "num"):
                return V.text_of(v).alias(n)
            to = {"dec": decimals, "big": integers}.get(v.kind)
            return (v.col.cast(to) if to else v.col).alias(n)

        return self.plan.df.select(*map(one, self.names))

    def __iter__(self) -> Iterator[dict[str, Term]]:
        """Solutions as dicts of the variables that are bound."""
        for row in self.df.toLocalIterator():
            yield {n: _term(row[n]) for n in self.names if row[n] is not None}

    def rows(self) -> list[dict[str, Term]]:
        return [{n: _term(row[n]) for n in self.names if row[n] is not None} for row in self.df.collect()]

    @property
    def ask(self) -> bool:
        return not self.plan.df.isEmpty()

    def __bool__(self) -> bool:
        return self.ask

    @property
    def graph(self) -> Graph:
        """The graph of CONSTRUCT and DESCRIBE."""
        if self.form == "CONSTRUCT":
            quads = instantiate(self.plan, [(*t, None) for t in self.query.template])
        elif self.form == "DESCRIBE":
            quads = self._describe()
        else:
            raise ValueError(f"{self.form} gives no graph")
        return Graph(quads)

    def _describe(self) -> DataFrame:
        spark = self.plan.df.sparkSession
        parts = [spark.range(1).select(lit(t).alias("n")) for t in self.query.describe if isinstance(t, Term)]
        for t in self.query.describe:
            if isinstance(t, Var) and t.name in self.plan.vars:
                parts.append(self.plan.df.select(V.term_of(self.plan.vars[t.name]).alias("n")))
        quads = explicit(self.source)
        if not parts:
            return quads.limit(0)
        nodes = parts[0]
        for p in parts[1:]:
            nodes = nodes.union(p)
        return G.description(quads, nodes.where("n IS NOT NULL AND n.k < 3").distinct())

    def serialize(self, form: str = "json") -> str:
        from .sources.results import write_result

        return write_result(self, form)


def explicit(source) -> DataFrame:
    return source.quads() if isinstance(source, MappedTables) else source.quads


def instantiate(plan: Plan, template: list[tuple]) -> DataFrame:
    """The quads of a template for every solution; incomplete and ill-formed ones are left out."""
    df = plan.df
    if any(isinstance(t, Term) and t.k == 1 for q in template for t in q):
        df = materialize(df.withColumn("__row", F.uuid()))  # one blank node for each solution and label
    def slot(t) -> Column:
        if t is None:
            return lit(None)
        if isinstance(t, Var):
            return V.term_of(plan.vars[t.name]) if t.name in plan.vars else lit(None)
        if t.k == 1:
            return make(1, F.concat(F.lit(t.lex + "_"), F.replace(F.col("__row"), F.lit("-"), F.lit(""))))
        return lit(t)

    if not template:
        return df.sparkSession.createDataFrame([], term_schema(*"spog"))
    rows = F.array(*[F.struct(*[slot(t).alias(c) for t, c in zip(q, "spog")], F.lit(q[3] is not None).alias("named")) for q in template])
    rows = df.select(F.explode(rows).alias("q")).select("q.*")
    rows = rows.where("s.k < 3 AND p.k = 2 AND o IS NOT NULL AND (NOT named OR g.k < 3)")
    return rows.select("s", "p", "o", "g").distinct()


class Dataset:
    """Quads with a default graph and named graphs, or tables mapped to them."""

    def __init__(self, spark: SparkSession, source=None, prefixes: dict[str, str] | None = None, union: bool = True, base: str | None = None):
        self.spark, self.prefixes, self.base, self.union = spark, {**PREFIXES, **(prefixes or {})}, base, union
        if source is None:
            source = spark.createDataFrame([], term_schema(*"spog"))
        self.source = QuadFrame(source, union) if isinstance(source, DataFrame) else source
        self.handlers: dict[str, list] = {}
        self.saved = self.source

    @property
    def quads(self) -> DataFrame:
        return explicit(self.source)

    @classmethod
    def of(cls, spark: SparkSession, quads: Iterable[tuple], **options) -> Dataset:
        """A dataset of Python quads or triples."""
        rows = [tuple(None if t is None else tuple(term(t)) for t in (*q, None)[:4]) for q in quads]
        return cls(spark, spark.createDataFrame(rows, term_schema(*"spog")).distinct(), **options)

    # Queries and updates

    def prepare(self, text: str) -> N.Query:
        return parse_query(text, self.prefixes, self.base)

    def query(self, query: str | N.Query, bindings: dict[str, Term] | None = None, now: _dt.datetime | None = None) -> Result:
        q = self.prepare(query) if isinstance(query, str) else query
        source = self.source.scoped(q.default_graphs, q.named_graphs)
        bindings = {n: term(t) for n, t in (bindings or {}).items()}
        return Result(q, compile_pattern(self.spark, source, q.p, q.base or self.base, bindings, now), source)

    def update(self, text: str, bindings: dict[str, Term] | None = None) -> Dataset:
        """Run update operations one after another; self then holds the new snapshot."""
        from .operators.update import run

        for operation in parse_update(text, self.prefixes, self.base):
            try:
                self._replace(run(self, operation, bindings))
            except Exception:
                if not operation.silent:
                    raise
        return self

    def _replace(self, source: QuadFrame) -> None:
        old, self.source = self.source, source
        for handler in self.handlers.get("changed", []):
            handler(old, source)

    def subscribe(self, event: str, handler) -> None:
        """Call ``handler(old source, new source)`` on each change."""
        if event != "changed":
            raise KeyError(event)
        self.handlers.setdefault(event, []).append(handler)

    def begin(self) -> None:
        """Remember the present snapshot, to which ``rollback`` returns."""
        self.saved = self.source

    def commit(self) -> None:
        self.saved = self.source

    def rollback(self) -> None:
        self._replace(self.saved)

    def changes(self, old: QuadFrame) -> tuple[DataFrame, DataFrame]:
        """Quads added and removed since an earlier snapshot."""
        return self.quads.exceptAll(old.quads), old.quads.exceptAll(self.quads)

    # Graphs

    def graph(self, name: Term | str | None = None) -> Graph:
        name = IRI(name) if isinstance(name, str) else name
        g = F.col("g")
        rows = self.quads.where(g.isNull() if name is None else equal(g, name))
        return Graph(rows.select("s", "p", "o", lit(None).alias("g")), self.prefixes, name)

    def graphs(self, triple: tuple | None = None) -> list[Term | None]:
        """Names of the graphs, the default one (None) included; of those with a triple, if one is given."""
        rows = Graph(self.quads)._matching(triple) if triple else self.quads
        names = {_term(r[0]) for r in rows.select("g").distinct().collect()}
        if triple is None:
            names.add(None)
            if self.source.known is not None:
                names |= {_term(r[0]) for r in self.source.known.select("g").collect()}
        return sorted(names, key=lambda t: (t is not None, t or ()))

    def add(self, quads: Iterable[tuple]) -> Dataset:
        more = Dataset.of(self.spark, quads).quads
        self._replace(self._with(self.quads.unionByName(more).distinct()))
        return self

    def add_graph(self, name: Term) -> Dataset:
        known = self.spark.createDataFrame([(tuple(name),)], term_schema("g"))
        old = self.source.known
        self._replace(QuadFrame(self.quads, self.union, graphs=known if old is None else old.union(known).distinct()))
        return self

    def remove(self, pattern: tuple) -> Dataset:
        """Drop quads that match (s, p, o[, g]); None matches anything."""
        keep = self.quads
        hit = F.lit(True)
        for c, t in zip("spog", pattern):
            if t is not None:
                hit &= F.coalesce(equal(F.col(c), term(t)), F.lit(False))
        self._replace(self._with(keep.where(~hit)))
        return self

    def remove_graph(self, name: Term) -> Dataset:
        known = self.source.known
        self._replace(QuadFrame(self.quads.where(~F.coalesce(equal(F.col("g"), name), F.lit(False))), self.union, graphs=None if known is None else known.where(~equal(F.col("g"), name))))
        return self

    def _with(self, quads: DataFrame) -> QuadFrame:
        return QuadFrame(quads, self.union, graphs=self.source.known)

    def __len__(self) -> int:
        return self.quads.count()

    def parse(self, path: str, form: str | None = None, graph: Term | None = None, **options) -> Dataset:
        from .sources.readers import read

        more = read(self.spark, path, form, **options)
        if graph is not None:
            more = more.withColumn("g", F.coalesce(F.col("g"), lit(graph)))
        self._replace(self._with(self.quads.unionByName(more).distinct()))
        return self

    def serialize(self, form: str = "trig", **options) -> str:
        from .sources.writers import to_text

        return to_text(self.quads, form, self.prefixes, **options)


class Graph:
    """Triples (s, p, o, g with g NULL) and the operations on one graph."""

    def __init__(self, quads: DataFrame, prefixes: dict[str, str] | None = None, name: Term | None = None):
        self.quads = quads.select("s", "p", "o", lit(None).alias("g"))
        self.spark, self.prefixes, self.name = quads.sparkSession, {**PREFIXES, **(prefixes or {})}, name

    @classmethod
    def of(cls, spark: SparkSession, triples: Iterable[tuple], **options) -> Graph:
        return cls(Dataset.of(spark, [t[:3] for t in triples]).quads, **options)

    @classmethod
    def parse(cls, spark: SparkSession, path: str | None = None, data: str | None = None, form: str | None = None, **options) -> Graph:
        from .sources.readers import read, read_text

        return cls(read(spark, path, form, **options) if path is not None else read_text(spark, data, form or "turtle", **options))

    def serialize(self, form: str = "turtle", **options) -> str:
        from .sources.writers import to_text

        return to_text(self.quads, form, self.prefixes, **options)

    def _new(self, quads: DataFrame) -> Graph:
        return Graph(quads, self.prefixes, self.name)

    def dataset(self) -> Dataset:
        return Dataset(self.spark, QuadFrame(self.quads, single=True), self.prefixes)

    def query(self, text: str, bindings: dict[str, Term] | None = None) -> Result:
        return self.dataset().query(text, bindings)

    def update(self, text: str) -> Graph:
        """The graph after an update."""
        return Graph(self.dataset().update(text).quads.where("g IS NULL"), self.prefixes, self.name)

    # Patterns

    def _matching(self, pattern: tuple | None) -> DataFrame:
        rows = self.quads
        lists = 0
        for c, t in zip("spo", pattern or ()):
            if isinstance(t, (list, set)):
                lists += 1
                if lists > 1:
                    raise ValueError("one slot of a pattern may be a list")
                if t:
                    wanted = self.spark.createDataFrame([(tuple(term(x)),) for x in t], term_schema(c))
                    rows = rows.join(wanted, c, "left_semi")
            elif isinstance(t, Regex):
                rows = rows.where(F.col(c)["lex"].rlike(f"^(?:{t.pattern})"))
            elif t is not None:
                rows = rows.where(equal(F.col(c), term(t)))
        return rows.select("s", "p", "o", "g")

    def triples(self, pattern: tuple) -> DataFrame:
        """Triples that match; a slot is a term, a list of terms, a Regex, a path (the predicate) or None."""
        if isinstance(pattern[1], N.Path):
            s, o = (Var(n) if t is None else term(t) for n, t in (("s", pattern[0]), ("o", pattern[2])))
            plan = compile_pattern(self.spark, QuadFrame(self.quads, single=True), N.BGP([(s, pattern[1], o)]))
            value = lambda t: V.term_of(plan.vars[t.name]) if isinstance(t, Var) else lit(t)
            return plan.df.select(value(s).alias("s"), lit(None).alias("p"), value(o).alias("o"), lit(None).alias("g"))
        return self._matching(pattern)

    def project(self, pattern: tuple, columns: str, unique: bool = False) -> DataFrame:
        rows = self.triples(pattern).select(*columns)
        return rows.distinct() if unique else rows

    def subjects(self, p=None, o=None, unique: bool = False) -> DataFrame:
        return self.project((None, p, o), "s", unique)

    def predicates(self, s=None, o=None, unique: bool = False) -> DataFrame:
        return self.project((s, None, o), "p", unique)

    def objects(self, s=None, p=None, unique: bool = False) -> DataFrame:
        return self.project((s, p, None), "o", unique)

    def subject_predicates(self, o=None, unique: bool = False) -> DataFrame:
        return self.project((None, None, o), "sp", unique)

    def subject_objects(self, p=None, unique: bool = False) -> DataFrame:
        return self.project((None, p, None), "so", unique)

    def predicate_objects(self, s=None, unique: bool = False) -> DataFrame:
        return self.project((s, None, None), "po", unique)

    def value(self, s=None, p=None, o=None, default: Term | None = None, any: bool = True) -> Term | None:
        """The one term missing of a pattern."""
        missing = [c for c, t in zip("spo", (s, p, o)) if t is None]
        if len(missing) != 1:
            raise ValueError("exactly one of subject, predicate and object must be None")
        rows = self.project((s, p, o), missing[0], True).limit(2).collect()
        if len(rows) > 1 and not any:
            raise ValueError("more than one value")
        return _term(rows[0][0]) if rows else default

    def __contains__(self, triple: tuple) -> bool:
        return not self.triples(triple).isEmpty()

    def __len__(self) -> int:
        return self.quads.count()

    def __getitem__(self, item):
        """``g[s:p:o]`` projects what is None; ``g[s]`` is its predicates and objects."""
        if not isinstance(item, slice):
            return self.predicate_objects(item)
        pattern = (item.start, item.stop, item.step)
        free = "".join(c for c, t in zip("spo", pattern) if t is None)
        return self.project(pattern, free) if free else pattern in self

    # Changes, each giving a new graph

    def add(self, *triples: tuple) -> Graph:
        return self._new(self.quads.unionByName(Dataset.of(self.spark, [t[:3] for t in triples]).quads).distinct())

    def remove(self, pattern: tuple) -> Graph:
        return self._new(self.quads.join(self.triples(pattern).select("s", "p", "o"), ["s", "p", "o"], "left_anti"))

    def set(self, triple: tuple) -> Graph:
        if triple[0] is None or triple[1] is None:
            raise ValueError("set needs a subject and a predicate")
        return self.remove((triple[0], triple[1], None)).add(triple)

    def __add__(self, other: Graph) -> Graph:
        return Graph(self.quads.union(other.quads).distinct(), {**other.prefixes, **self.prefixes}, self.name)

    __or__ = __add__

    def __mul__(self, other: Graph) -> Graph:
        return self._new(self.quads.intersect(other.quads))

    __and__ = __mul__

    def __sub__(self, other: Graph) -> Graph:
        return self._new(self.quads.subtract(other.quads))

    def __xor__(self, other: Graph) -> Graph:
        return (self - other) + (other - self)

    # Analysis

    def nodes(self) -> DataFrame:
        return self.quads.select(F.col("s").alias("n")).union(self.quads.select("o")).distinct()

    def transitive_objects(self, s, p) -> DataFrame:
        """The subject and all it reaches by a predicate."""
        return self.project((term(s), N.Mul(N.as_path(p), "*"), None), "o")

    def transitive_subjects(self, p, o) -> DataFrame:
        return self.project((None, N.Mul(N.as_path(p), "*"), term(o)), "s")

    def closure(self, step, *start: Term) -> DataFrame:
        """(n) of the start nodes and all that ``step(frontier, graph) -> DataFrame of n`` leads to."""
        new = materialize(self.spark.createDataFrame([(tuple(t),) for t in start], term_schema("n")).distinct())
        seen = new
        while not new.isEmpty():
            new = materialize(step(new, self).select("n").distinct().join(seen, "n", "left_anti"))
            seen = seen.unionAll(new)
        return seen

    def cbd(self, *nodes: Term) -> Graph:
        """The concise bounded description of nodes."""
        return self._new(G.description(self.quads, self.spark.createDataFrame([(tuple(n),) for n in nodes], term_schema("n"))))

    def connected(self) -> bool:
        return G.is_connected(self.quads)

    def components(self) -> DataFrame:
        return G.components(self.quads)

    def roots(self, p: Term) -> DataFrame:
        return G.roots(self.quads, p)

    def tree(self, root: Term, p: Term, down: bool = True):
        return G.tree(self.quads, root, p, down)

    def items(self, head: Term) -> list[Term]:
        """The members of an rdf:List."""
        return [_term(r) for r in G.list_items(self.quads, head)]

    def members(self, container: Term) -> list[Term]:
        """The members of a container, by number."""
        return [_term(r[0]) for r in G.container_members(self.quads, container).collect()]

    def void(self) -> DataFrame:
        return G.profile(self.quads)

    def skolemize(self, authority: str = "http://localhost") -> Graph:
        return self._new(G.skolemize(self.quads, authority))

    def de_skolemize(self) -> Graph:
        return self._new(G.de_skolemize(self.quads))

    def canonical(self) -> Graph:
        from .operators.canonical import canonical

        return self._new(canonical(self.quads))

    def isomorphic(self, other: Graph) -> bool:
        from .operators.canonical import isomorphic

        return isomorphic(self.quads, other.quads)

    def diff(self, other: Graph) -> tuple[Graph, Graph, Graph]:
        """(both, only here, only there), blank nodes by their canonical labels."""
        a, b = self.canonical(), other.canonical()
        return a & b, a - b, b - a

    # Names

    def bind(self, prefix: str, namespace: str, override: bool = True) -> Graph:
        """Name a namespace; a prefix that means another one is kept unless overridden, and then a number is added."""
        taken = self.prefixes.get(prefix)
        if taken not in (None, namespace) and not override:
            n = 1
            while self.prefixes.get(f"{prefix}{n}") not in (None, namespace):
                n += 1
            prefix = f"{prefix}{n}"
        self.prefixes = {**{p: ns for p, ns in self.prefixes.items() if ns != namespace}, prefix: namespace}
        return self

    def qname(self, iri: Term | str) -> str | None:
        return shorten(iri.lex if isinstance(iri, Term) else iri, self.prefixes)

    def expand(self, curie: str) -> Term:
        prefix, _, local = curie.partition(":")
        return IRI(self.prefixes[prefix] + local)

    def collect(self) -> set[tuple[Term, Term, Term]]:
        """All triples on the driver."""
        return {tuple(map(_term, (r.s, r.p, r.o))) for r in self.quads.toLocalIterator()}


class Regex:
    """A slot of a pattern that matches text from its start."""

    def __init__(self, pattern: str):
        self.pattern = pattern


class Aggregate:
    """A read-only union of graphs, duplicates kept."""

    def __init__(self, *graphs: Graph):
        self.graphs = graphs

    @property
    def quads(self) -> DataFrame:
        out = self.graphs[0].quads
        for g in self.graphs[1:]:
            out = out.unionAll(g.quads)
        return out

    def triples(self, pattern: tuple) -> DataFrame:
        return Graph(self.quads).triples(pattern)

    def __len__(self) -> int:
        return self.quads.count()


class Resource:
    """One node of a graph."""

    def __init__(self, graph: Graph, node: Term):
        self.graph, self.node = graph, node

    def objects(self, p: Term | None = None) -> list:
        return [self._wrap(_term(r[0])) for r in self.graph.objects(self.node, p).collect()]

    def subjects(self, p: Term | None = None) -> list:
        return [self._wrap(_term(r[0])) for r in self.graph.subjects(p, self.node).collect()]

    def value(self, p: Term, default=None):
        found = self.graph.value(self.node, p, default=default)
        return self._wrap(found)

    def set(self, p: Term, o) -> Resource:
        return Resource(self.graph.set((self.node, p, term(o))), self.node)

    def add(self, p: Term, o) -> Resource:
        return Resource(self.graph.add((self.node, p, term(o))), self.node)

    def _wrap(self, t):
        return Resource(self.graph, t) if isinstance(t, Term) and t.k < 3 else t

    def __eq__(self, other) -> bool:
        return isinstance(other, Resource) and self.node == other.node

    def __hash__(self) -> int:
        return hash(self.node)


__all__ = ["Aggregate", "BNode", "Dataset", "Graph", "IRI", "Literal", "Regex", "Resource", "Result", "Term", "Var", "instantiate"]
