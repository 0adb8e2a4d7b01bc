"""Joins on variables that may be unbound: keys where they are bound, and the rows that the definition gives."""

from itertools import product

import pytest

from quadrille.graph import Dataset
from quadrille.sources import readers

DATA = """
@prefix : <http://x/> .
:a :k 1 ; :p :u . :b :k 2 . :c :k 3 ; :p :v . :d :k 4 ; :p :w . :d2 :k 4 ; :p :w .
:u :q "U" ; :r :one . :v :q "V" . :w :r :two . :z :q "Z" ; :r :two .
:one :n 10 . :two :n 20 .
"""


@pytest.fixture(scope="module")
def ds(spark):
    return Dataset(spark, readers.read_text(spark, DATA, "turtle"))


def rows(ds, text):
    return sorted((tuple(r) for r in ds.query("PREFIX : <http://x/> " + text).native().collect()), key=repr)


def solutions(ds, pattern):
    """Solutions of one triple pattern as dictionaries."""
    found = ds.query(f"PREFIX : <http://x/> SELECT * WHERE {{ {pattern} }}").native()
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()]


def agree(x, y):
    return all(x[k] == y[k] for k in x.keys() & y.keys())


def optional(left, right, on=lambda m: True):
    out = []
    for x in left:
        met = [x | y for y in right if agree(x, y) and on(x | y)]
        out += met or [x]
    return out


def shown(names, found):
    return sorted((tuple(m.get(n) for n in names) for m in found), key=repr)


def parts(ds):
    k, p, q, r = (solutions(ds, t) for t in ("?s :k ?k", "?s :p ?m", "?m :q ?t", "?m :r ?o"))
    left = optional(k, p)
    return left, q, r, optional(solutions(ds, "?i :n ?num"), [{"i": x["o"], "m": x["m"]} for x in r if x["m"] == "http://x/u"])


LEFT = "?s :k ?k OPTIONAL { ?s :p ?m }"


def test_optional_after_optional(ds):
    left, q, r, _ = parts(ds)
    assert rows(ds, f"SELECT ?s ?k ?m ?t {{ {LEFT} OPTIONAL {{ ?m :q ?t }} }}") == shown("skmt", optional(left, q))
    assert rows(ds, f"SELECT ?s ?k ?m ?t {{ {LEFT} OPTIONAL {{ ?m :q ?t FILTER(?k > 2) }} }}") == shown("skmt", optional(left, q, lambda m: int(m["k"]) > 2))


def test_both_sides_unsure(ds):
    left, q, r, _ = parts(ds)
    right = optional([{"t": x["t"], "y": x["m"]} for x in q], [{"y": x["m"], "m": x["m"]} for x in r])
    inner = "?y :q ?t OPTIONAL { ?y :r ?any BIND(?y AS ?m) }"
    assert rows(ds, f"SELECT ?s ?k ?m ?t {{ {LEFT} OPTIONAL {{ {inner} }} }}") == shown("skmt", optional(left, right))
    gone = [x for x in left if not any(agree(x, y) and x.keys() & y.keys() for y in right)]
    assert rows(ds, f"SELECT ?s ?k ?m {{ {LEFT} MINUS {{ {inner} }} }}") == shown("skm", gone)
    there = [x for x in left if any(agree(x, y) for y in right)]
    assert rows(ds, f"SELECT ?s ?k ?m {{ {LEFT} FILTER EXISTS {{ {inner} }} }}") == shown("skm", there)
    joined = [x | y for x, y in product(left, right) if agree(x, y)]
    assert rows(ds, f"SELECT ?s ?k ?m ?t {{ {{ {LEFT} }} {{ {inner} }} }}") == shown("skmt", joined)


def test_negation_on_an_optional_variable(ds):
    left, q, _, _ = parts(ds)
    assert rows(ds, f"SELECT ?s ?m {{ {LEFT} MINUS {{ ?m :q ?t }} }}") == shown("sm", [x for x in left if not any("m" in x and agree(x, y) for y in q)])
    assert rows(ds, f"SELECT ?s ?m {{ {LEFT} FILTER NOT EXISTS {{ ?m :q ?t }} }}") == shown("sm", [x for x in left if not any(agree(x, y) for y in q)])
    assert rows(ds, f"SELECT ?s ?m {{ {LEFT} FILTER EXISTS {{ ?m :q ?t }} }}") == shown("sm", [x for x in left if any(agree(x, y) for y in q)])


def test_minus_has_no_nested_loop(ds, spark):
    plan = ds.query(f"PREFIX : <http://x/> SELECT ?s ?m {{ {LEFT} MINUS {{ ?m :q ?t }} }}").native()
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


INSIDE = {
    # the filter reads a variable that only the outside binds
    "SELECT ?s ?k ?e { ?s :k ?k BIND(EXISTS { ?o :n ?n FILTER(?n > ?k * 9) } AS ?e) }": lambda: [("http://x/a", "1", "true"), ("http://x/b", "2", "true"), ("http://x/c", "3", "false"), ("http://x/d", "4", "false"), ("http://x/d2", "4", "false")],
    "SELECT ?s { ?s :k ?k FILTER(?k = 4 || EXISTS { ?s :p ?m FILTER(?k < 2) }) }": lambda: [("http://x/a",), ("http://x/d",), ("http://x/d2",)],
    "SELECT ?s { ?s :k ?k FILTER(?k = 4 || NOT EXISTS { ?s :p ?m FILTER(?k < 2) }) }": lambda: [("http://x/b",), ("http://x/c",), ("http://x/d",), ("http://x/d2",)],
    "SELECT ?s (IF(EXISTS { ?s :p ?m . ?m :q ?t FILTER(STRLEN(?t) = ?k) }, 'y', 'n') AS ?e) { ?s :k ?k }": lambda: [("http://x/a", "y"), ("http://x/b", "n"), ("http://x/c", "n"), ("http://x/d", "n"), ("http://x/d2", "n")],
    "SELECT ?s { ?s :k ?k FILTER(EXISTS { ?s :p ?m } && (EXISTS { ?s :p :w } || ?k = 1)) }": lambda: [("http://x/a",), ("http://x/d",), ("http://x/d2",)],
    "SELECT ?s ?e { ?s :k ?k BIND(EXISTS { :z :q ?t } AS ?e) FILTER(?k < 3) }": lambda: [("http://x/a", "true"), ("http://x/b", "true")],
    "SELECT ?k (COUNT(*) AS ?c) { ?s :k ?k } GROUP BY ?k HAVING(EXISTS { ?x :k ?k ; :p ?m })": lambda: [("1", "1"), ("3", "1"), ("4", "2")],
    "SELECT ?s { ?s :k ?k } ORDER BY EXISTS { ?s :p :w } DESC(?k) LIMIT 1": lambda: [("http://x/c",)],
    # the key may be unbound
    "SELECT ?s ?e { ?s :k ?k OPTIONAL { ?s :p ?m } BIND(EXISTS { ?m :r ?o FILTER(?k > 0) } AS ?e) }": lambda: [("http://x/a", "true"), ("http://x/b", "true"), ("http://x/c", "false"), ("http://x/d", "true"), ("http://x/d2", "true")],
}


@pytest.mark.parametrize("text", INSIDE)
def test_exists_inside_expressions(ds, text):
    found = [tuple(str(x).lower() if isinstance(x, bool) else str(x) for x in r) for r in ds.query("PREFIX : <http://x/> " + text).native().collect()]
    assert sorted(found) == sorted(INSIDE[text]())


def test_exists_inside_expressions_is_one_existence_join(ds):
    text = "SELECT ?s ?e { ?s :k ?k BIND(EXISTS { ?s :p ?m FILTER(?k > 1) } AS ?e) }"
    plan = ds.query("PREFIX : <http://x/> " + text).native()._jdf.queryExecution().executedPlan().toString()
    assert "ExistenceJoin" in plan and "NestedLoop" not in plan and plan.count("MergeJoin") + plan.count("HashJoin") == 1


def chain(n):
    """n variables that may each be unbound on the left, and are all shared with the right."""
    left = " ".join(f"OPTIONAL {{ ?s :a{i} ?v{i} }}" for i in range(n))
    right = " ".join(f"OPTIONAL {{ ?t :a{i} ?v{i} }}" for i in range(n))
    return f"?s :left ?x {left}", f"?t :right ?y {right}"


@pytest.fixture(scope="module")
def sparse(spark):
    """Left and right nodes with some of four properties each."""
    lines = []
    for i in range(16):
        for side in ("left", "right"):
            lines.append(f":{side}{i} :{side} {i} .")
            lines += [f":{side}{i} :a{k} {(i + k) % (3 if side == 'left' else 2)} ." for k in range(4) if i >> k & 1]
    return Dataset(spark, readers.read_text(spark, "@prefix : <http://x/> .\n" + "\n".join(lines), "turtle"))


@pytest.mark.parametrize("form", ["{{ {left} }} {{ {right} }}", "{left} OPTIONAL {{ {right} }}", "{left} MINUS {{ {right} }}", "{left} FILTER EXISTS {{ {right} }}", "{left} FILTER NOT EXISTS {{ {right} FILTER(?y > ?x) }}", "{left} OPTIONAL {{ {right} FILTER(?y > ?x) }}"])
@pytest.mark.parametrize("n", [1, 3])
def test_many_unsure_keys(sparse, form, n):
    left, right = chain(n)
    names = ["x", *(f"v{i}" for i in range(n))]
    solved = lambda p: [{k: v for k, v in r.asDict().items() if v is not None} for r in sparse.query(f"PREFIX : <http://x/> SELECT * {{ {p} }}").native().collect()]
    a, b = solved(left), solved(right)
    late = (lambda m: int(m["y"]) > int(m["x"])) if "?y > ?x" in form else (lambda m: True)
    if "MINUS" in form:
        want = [x for x in a if not any(agree(x, y) and x.keys() & y.keys() for y in b)]
    elif "EXISTS" in form:
        want = [x for x in a if any(agree(x, y) and late(x | y) for y in b) != ("NOT" in form)]
    elif "OPTIONAL {{" in form:
        want, names = optional(a, b, late), [*names, "y"]
    else:
        want, names = [x | y for x, y in product(a, b) if agree(x, y)], [*names, "y"]
    text = f"SELECT {' '.join('?' + v for v in names)} {{ {form.format(left=left, right=right)} }}"
    assert rows(sparse, text) == shown(names, want)


def test_plans_grow_with_the_keys_not_their_subsets(sparse):
    sizes = []
    for n in (2, 4):
        left, right = chain(n)
        plan = sparse.query(f"PREFIX : <http://x/> SELECT ?s {{ {left} FILTER EXISTS {{ {right} }} }}").native()._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Join"))
    assert sizes[1] - sizes[0] == 4 and sizes[0] <= 6  # a left and a right OPTIONAL for each key more
