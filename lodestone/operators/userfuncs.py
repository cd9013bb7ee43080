"""User functions over prompts, completions and groups: rewards, group filters, formatting.

A reward is a column expression, or a Python function that takes a batch's columns as lists by keyword (``prompts``,
``completions`` and every other column by its name) and gives a list of numbers or Nones, one for each row; it may be a
coroutine function. Python functions of one call share one pass over Arrow batches; column rewards stay with Spark.

Results for odd input: None and NaN are null; a list of another length, or a value that is no number, is an error that
names the function; rows none of whose rewards is there are marked ``unscored`` and have the reward 0; a null prompt or
completion is handed over as None; an empty table calls nothing; a column that bears a result's name is replaced, and
the functions do not see it.
"""

from __future__ import annotations

import asyncio
import inspect
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROWS = 1000
BYTES = 4 << 20


class Registry:
    """Functions by name: ``@registry.add`` or ``registry.add("name", function)``."""

    def __init__(self) -> None:
        self.known: dict[str, Callable | Column] = {}

    def add(self, name: str | Callable, function: Callable | Column | None = None):
        if callable(name) and not isinstance(name, str):
            return self.add(name.__name__, name)
        if function is None:
            return lambda f: self.add(name, f)
        if name in self.known:
            raise ValueError(f"there is a function {name!r} already")
        self.known[name] = function
        return function

    def named(self, names: Sequence[str]) -> dict[str, Callable | Column]:
        if missing := [n for n in names if n not in self.known]:
            raise KeyError(f"unknown functions {missing}; there are {sorted(self.known)}")
        return {n: self.known[n] for n in names}


def _numbers(name: str, given: Sequence, n: int) -> list[float | None]:
    """What a function gave as nullable numbers."""
    out = list(given)
    if len(out) != n:
        raise ValueError(f"reward function {name!r} gave {len(out)} values for {n} rows")
    for k, v in enumerate(out):
        if v is not None:
            try:
                out[k] = float(v)
            except (TypeError, ValueError):
                raise ValueError(f"reward function {name!r} gave {v!r}, which is no number") from None
            if math.isnan(out[k]):
                out[k] = None
    return out


def _called(functions: Mapping[str, Callable], told: dict[str, list]) -> dict[str, Sequence]:
    """The results of all functions on a batch; coroutines wait together."""

    async def together(waiting: dict[str, Callable]) -> dict[str, Sequence]:
        return dict(zip(waiting, await asyncio.gather(*(f(**told) for f in waiting.values())), strict=True))

    waiting = {n: f for n, f in functions.items() if inspect.iscoroutinefunction(f)}
    out = {n: f(**told) for n, f in functions.items() if n not in waiting}
    return out | (asyncio.run(together(waiting)) if waiting else {})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``ROWS`` rows and, as rows are on average, ``BYTES``; an empty batch as it is."""
    for batch in batches:
        rows = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def rewards(df: DataFrame, functions: Mapping[str, Callable | Column], weights: Mapping[str, float] | None = None, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """Adds ``reward_<name>`` for each function, ``reward`` (their weighted sum, missing ones left out) and ``unscored``.

    A function without a weight has 1. Batches have at most ``ROWS`` rows, and about ``BYTES`` of columns where rows are long, so
    that what a worker holds does not grow with the input.
    """
    if not functions:
        raise ValueError("no reward functions")
    if unknown := set(weights or {}) - set(functions):
        raise ValueError(f"weights without a function: {sorted(unknown)}")
    results = {n: f"reward_{n}" for n in functions}
    df = df.drop(*results.values(), "reward", "unscored")
    columns = {n: f for n, f in functions.items() if isinstance(f, Column)}
    called = {n: f for n, f in functions.items() if n not in columns}
    if called:
        schema = T.StructType([*df.schema.fields, *[T.StructField(results[n], T.DoubleType()) for n in called]])
        names = [{prompt: "prompts", completion: "completions"}.get(c, c) for c in df.columns]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                told = {n: c.to_pylist() for n, c in zip(names, batch.columns, strict=True)}
                found = _called(called, told) if batch.num_rows else {}
                added = [pa.array(_numbers(n, found.get(n, ()), batch.num_rows), pa.float64()) for n in called]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.fieldNames())

        df = df.mapInArrow(each, schema)
    df = df.withColumns({results[n]: F.nanvl(c.cast("double"), F.lit(None)) for n, c in columns.items()})
    there = [F.col(results[n]) for n in functions]
    total = F.lit(0.0)
    for n in functions:
        total = total + F.coalesce(F.col(results[n]), F.lit(0.0)) * float((weights or {}).get(n, 1.0))
    return df.withColumns({"reward": total, "unscored": F.coalesce(*there).isNull()})


def filtered_groups(df: DataFrame, group: str, order: str, function: Callable, keep: int, completion: str = "completion", reward: str = "reward", most: int = 4096) -> DataFrame:
    """Of each group of completions the ``keep`` that the user's function scores highest, with ``group_score``; of equal scores the first by ``order``.

    The function is called as ``function(group_completions=[[...]], group_rewards=[[...]])`` and gives a list of one list
    of scores; a None or NaN is below all others. Groups are the generations of one prompt: a task holds one whole, and one
    of more than ``most`` rows is an error rather than cut.
    """
    df = df.drop("group_score")
    schema = T.StructType([*df.schema.fields, T.StructField("group_score", T.DoubleType())])

    def each(table: pa.Table) -> pa.Table:
        if table.num_rows > most:
            raise ValueError(f"a group of {table.num_rows} rows is larger than {most}")
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        given = function(group_completions=[table.column(completion).to_pylist()], group_rewards=[table.column(reward).to_pylist()])
        if len(given) != 1:
            raise ValueError(f"the group filter gave scores of {len(given)} groups for 1")
        scores = _numbers("group filter", given[0], table.num_rows)
        best = sorted(range(table.num_rows), key=lambda k: (scores[k] is None, -(scores[k] or 0.0), k))[:keep]
        return table.take(sorted(best)).append_column("group_score", pa.array([scores[k] for k in sorted(best)], pa.float64()))

    return df.groupBy(group).applyInArrow(each, schema)


def formatted(df: DataFrame, function: Callable[[dict], str | None] | Column, name: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the text that a column, or a function of the row as a dict, makes of each row.

    Something other than a text or None is an error.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    if isinstance(function, Column):
        return df.select(*[F.col(f"`{c}`") for c in kept], function.cast("string").alias(name))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [function(row) for row in batch.to_pylist()]
            for t in texts:
                if t is not None and not isinstance(t, str):
                    raise TypeError(f"the formatting function gave {type(t).__name__}, not a text")
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(each, schema)
