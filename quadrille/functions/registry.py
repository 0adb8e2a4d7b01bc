"""Functions by IRI: callables of term columns that give a term column, or a Python function on terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..terms import TERM, Term

FUNCTIONS: dict[str, Callable] = {}


def register(iri: str, function: Callable, override: bool = False) -> None:
    """Make ``function(*term columns) -> term column`` callable by IRI."""
    if iri in FUNCTIONS and not override:
        raise ValueError(f"{iri} is registered already")
    FUNCTIONS[iri] = function


def register_python(iri: str, function: Callable, override: bool = False) -> None:
    """Make ``function(*terms) -> term or None`` callable by IRI, in Arrow batches."""

    def of(value) -> Term | None:
        return None if value is None else Term(value["k"], value["lex"], value["dt"], value["lang"])

    def batch(*columns):
        import pandas as pd

        rows = zip(*(c.to_dict("records") for c in columns))
        out = [function(*(None if r["lex"] is None else of(r) for r in row)) for row in rows]
        return pd.DataFrame([tuple(t) if t is not None else (None,) * 4 for t in out], columns=["k", "lex", "dt", "lang"])

    batch.__annotations__ = {}
    register(iri, lambda *args: F.pandas_udf(batch, TERM, F.PandasUDFType.SCALAR)(*args), override)


def unregister(iri: str) -> None:
    if iri not in FUNCTIONS:
        raise KeyError(iri)
    del FUNCTIONS[iri]


def custom_function(iri: str, override: bool = False):
    """Decorator form of ``register``."""

    def keep(f):
        register(iri, f, override)
        return f

    return keep
