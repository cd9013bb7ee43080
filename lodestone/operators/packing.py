"""Packing token sequences into rows of bounded length, within declared batches."""

from __future__ import annotations

import bisect
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truncate(df: DataFrame, n: int) -> DataFrame:
    """Every array column cut to n; others as they are."""
    return df.select(*[F.slice(f.name, 1, n).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema])


def pack_wrapped(df: DataFrame, column: str, batch: str, ordinal: str, length: int) -> DataFrame:
    """(batch, row, column): a batch's arrays one after another, cut every ``length``; the last row is what is left."""
    w = Window.partitionBy(batch).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select(batch, F.coalesce(F.sum(F.size(column)).over(w), F.lit(0)).alias("_start"), column)
    tokens = placed.select(batch, "_start", F.posexplode(column).alias("_i", "_x")).withColumn("_at", F.col("_start") + F.col("_i"))
    rows = tokens.groupBy(batch, F.floor(F.col("_at") / length).alias("row")).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_a"))
    return rows.select(batch, "row", F.transform("_a", lambda x: x["_x"]).alias(column))


def best_fit_decreasing(lengths: list[int], limit: int, overflow: str = "drop") -> list[list[tuple[int, int, int]]]:
    """Bins of fragments (row, start, end), longest first into the fullest bin that still has room, the oldest of equal ones.

    A row beyond the limit is cut there; the rest is dropped or (``requeue``) packed as fragments of their own.
    """
    pieces = []
    for row, n in enumerate(lengths):
        for start in range(0, n if overflow == "requeue" else min(n, 1), limit):
            pieces.append((row, start, min(start + limit, n)))
    pieces.sort(key=lambda p: p[1] - p[2])
    bins: list[list[tuple[int, int, int]]] = []
    by_space: dict[int, deque[int]] = defaultdict(deque)
    spaces: list[int] = []
    for piece in pieces:
        size = piece[2] - piece[1]
        at = bisect.bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            chosen = by_space[space].popleft()
            if not by_space[space]:
                del spaces[at]
        else:
            space, chosen = limit, len(bins)
            bins.append([])
        bins[chosen].append(piece)
        left = space - size
        if left:
            if not by_space[left]:
                bisect.insort(spaces, left)
            by_space[left].append(chosen)
    return bins


def pack_bfd(df: DataFrame, columns: list[str], batch: str, ordinal: str, length: int, overflow: str = "drop") -> DataFrame:
    """(batch, row, columns, seq_lengths): best-fit decreasing within each batch, one task a batch. A bigger batch packs better."""
    source = df.select(batch, ordinal, *columns)
    schema = T.StructType([source.schema[batch], T.StructField("row", T.LongType()), *[source.schema[c] for c in columns], T.StructField("seq_lengths", T.ArrayType(T.IntegerType()))])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(ordinal)
        lists = {c: table.column(c).to_pylist() for c in columns}
        lengths = [len(x or []) for x in lists[columns[0]]]
        bins = best_fit_decreasing(lengths, length, overflow)
        out = {batch: [key[0].as_py()] * len(bins), "row": list(range(len(bins)))}
        for c in columns:
            out[c] = [[x for row, a, b in pieces for x in lists[c][row][a:b]] for pieces in bins]
        out["seq_lengths"] = [[b - a for _, a, b in pieces] for pieces in bins]
        kinds = {c: table.schema.field(c).type for c in (batch, *columns)} | {"row": pa.int64(), "seq_lengths": pa.list_(pa.int32())}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return source.groupBy(batch).applyInArrow(pack, schema)


def with_batches(df: DataFrame, order: str, size: int, name: str = "batch") -> DataFrame:
    """Numbers batches of ``size`` rows in an order; needs an integer column that is dense from 0, see groups.numbered."""
    return df.withColumn(name, F.floor(F.col(order) / size))
