"""Named plug-ins: chunkers, searches, exporters, counters, scorers and models.

A plug-in is a function of DataFrames or columns, or a vectorised model: ``load``
runs once in each Python worker, ``apply`` gets the loaded model and a batch as pandas
series.  What a model returns (its type and, for vectors, their dimension) is part of
its entry, so that a plan is checked before it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("chunker", "search", "exporter", "token_counter", "scorer", "embedder", "model")
#: What each kind of vectorised model must return.
RETURNS = {"token_counter": "bigint", "scorer": "double", "embedder": "array<float>", "model": "string"}


@dataclass(frozen=True)
class Model:
    """A vectorised model; calling it on columns gives the column of its results."""

    kind: str
    name: str
    load: Callable
    apply: Callable
    returns: str
    dimension: int | None = None

    def __call__(self, *columns: Column) -> Column:
        return _vectorised(self)(*columns)


_held: dict[tuple[str, str], Callable] = {}


def register_strategy(kind: str, name: str, function: Callable) -> None:
    """Functions take and return DataFrames or Columns, by kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
    _held[kind, name] = function


def register_model(kind: str, name: str, load: Callable, apply: Callable, dimension: int | None = None) -> Model:
    """A vectorised model of a kind: ``load()`` once in a worker, ``apply(model, *series)``
    for each batch.  Embedders name their dimension."""
    if kind not in RETURNS:
        raise ValueError(f"models are of the kinds {', '.join(RETURNS)}, not {kind!r}")
    if (kind == "embedder") != (dimension is not None):
        raise ValueError("embedders have a dimension, other models none")
    made = Model(kind, name, load, apply, RETURNS[kind], dimension)
    register_strategy(kind, name, made)
    return made


def strategy(kind: str, name: str) -> Callable:
    if (kind, name) not in _held:
        names = sorted(n for k, n in _held if k == kind)
        raise KeyError(f"no {kind} named {name!r}; there are: {', '.join(names) or 'none'}")
    return _held[kind, name]


def dimension_of(name: str, wanted: int | None = None) -> int | None:
    """The dimension of an embedder; an error if another one is wanted."""
    held = getattr(strategy("embedder", name), "dimension", None)
    if wanted is not None and held is not None and held != wanted:
        raise ValueError(f"embedder {name!r} has {held} dimensions, not {wanted}")
    return held


def _vectorised(model: Model) -> Callable:
    load, apply, name, dimension = model.load, model.apply, model.name, model.dimension

    def results(loaded, batch) -> pd.Series:
        made = apply(loaded, *batch)
        if dimension is None:
            return pd.Series(made)
        rows = [list(map(float, v)) for v in made]
        if any(len(v) != dimension for v in rows):
            raise ValueError(f"embedder {name!r} gave a vector of another dimension than {dimension}")
        return pd.Series(rows, dtype=object)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        loaded = load()
        for batch in batches:
            yield results(loaded, batch)

    def call(*columns: Column) -> Column:
        from pyspark.sql.session import SparkSession

        from ..shipping import ship

        ship(SparkSession.active())
        # The iterator of tuples is Spark's form for any number of columns.
        given = [F.coalesce(c, F.lit("")) if model.kind != "scorer" else c for c in columns]
        return F.pandas_udf(_of_one(run) if len(given) == 1 else run, model.returns)(*given)

    return call


def _of_one(run):
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run((b,) for b in batches)

    return one


def sizer(name: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """How a Python worker counts the tokens of many texts at once by a registered
    counter: a function that loads it."""
    counter = strategy("token_counter", name)
    if isinstance(counter, Model):
        load, apply = counter.load, counter.apply

        def loaded():
            model = load()
            return lambda texts: [int(n) for n in apply(model, pd.Series(texts, dtype=object))] if texts else []

        return loaded
    plain = getattr(counter, "plain", None)
    if plain is None:
        raise ValueError(f"token counter {name!r} has no plain form for one text")
    return lambda: lambda texts: [plain(t) for t in texts]
