"""Two tokenisations of one text brought together: groups of tokens that spell the same, and probabilities of groups.

A group ends where both sides have spelled the same text so far, so the ends are the offsets that both sides reach, as long as
the texts agree; what follows the last such end is one more group. The work of a row is linear in its tokens, by arrays.

Results for odd input: a null side gives null; no tokens give no groups; tokens that spell nothing belong to the group of the
next one that does; where the texts differ, all from the last common end on is one group, which may be empty on a
side; a null token spells nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 1e-8
ROWS = 500


def ends(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Where groups end: the numbers of tokens of both sides up to there; the last are all tokens."""
    a, b = (np.cumsum([len(p or "") for p in side], dtype=np.int64) for side in (left, right))
    x, y = "".join(p or "" for p in left), "".join(p or "" for p in right)
    common = np.intersect1d(a, b)
    common = common[common > 0]
    if x != y:
        agree = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        common = common[common <= agree]
    out = list(zip((np.searchsorted(a, common) + 1).tolist(), (np.searchsorted(b, common) + 1).tolist(), strict=True))
    if (out[-1] if out else (0, 0)) != (len(left), len(right)):
        out.append((len(left), len(right)))
    return out


def groups(left: list[str], right: list[str]) -> list[dict[str, list[int]]]:
    """Of one row."""
    return grouped(pa.array([left], pa.list_(pa.string())), pa.array([right], pa.list_(pa.string()))).to_pylist()[0]


_KIND = pa.list_(pa.struct([("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))]))


def _plain(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where the rows of a column of arrays of texts start and end, the lengths of its texts one after another, and the rows' whole texts; null texts are empty."""
    flat = pc.fill_null(column.flatten(), "")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), "")
    return at, pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64), whole


def grouped(left: pa.ListArray, right: pa.ListArray) -> pa.Array:
    """The groups of all rows of a batch: places are counted and cut by arrays, no place is a Python object."""
    left, right = left.cast(pa.list_(pa.string())), right.cast(pa.list_(pa.string()))
    (at, n, x), (bt, m, y) = _plain(left), _plain(right)
    null = pc.or_(left.is_null(), right.is_null()).to_numpy(zero_copy_only=False)
    same = pc.equal(x, y).to_numpy(zero_copy_only=False)
    counts, sides = np.zeros(len(null), np.int64), ([], [])
    for r in np.flatnonzero(~null):
        i, p, j, q = at[r], at[r + 1], bt[r], bt[r + 1]
        if same[r]:
            a, b = np.cumsum(n[i:p]), np.cumsum(m[j:q])
            common = np.intersect1d(a, b)
            common = common[common > 0]
            u, v = np.searchsorted(a, common) + 1, np.searchsorted(b, common) + 1
            if (u[-1] if len(u) else 0, v[-1] if len(v) else 0) != (p - i, q - j):
                u, v = np.append(u, p - i), np.append(v, q - j)
        else:
            u, v = np.array(ends(left[r].as_py(), right[r].as_py()), np.int64).T
        counts[r] = len(u)
        sides[0].append(np.diff(u, prepend=0))
        sides[1].append(np.diff(v, prepend=0))

    def places(lengths: list[np.ndarray], starts: np.ndarray) -> pa.ListArray:
        sizes = np.where(null, 0, np.diff(starts))
        values = np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    pairs = pa.StructArray.from_arrays([places(sides[0], at), places(sides[1], bt)], names=["left", "right"])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(null, False)), pairs).cast(_KIND)


def aligned(df: DataFrame, left: str, right: str, name: str = "groups") -> DataFrame:
    """Adds ``name``: an array of (left, right), the places of the tokens of each group in the arrays of texts ``left`` and ``right``."""
    df = df.drop(name)
    kind = T.ArrayType(T.StructType([T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType()))]))
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    source = df.withColumns({"_left": F.col(left), "_right": F.col(right)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], grouped(part.column(part.num_columns - 2), part.column(part.num_columns - 1))], names=schema.fieldNames())

    return source.mapInArrow(each, schema)


def merged(probabilities: np.ndarray, ids: list[int], group: list[int]) -> np.ndarray:
    """The distribution of a group: that of its first token, times the probabilities of the tokens that did follow."""
    if not group:
        return np.zeros(probabilities.shape[1] if probabilities.ndim == 2 else 0)
    out = probabilities[group[0]]
    for k in group[1:]:
        out = out * max(probabilities[k, ids[k]], LEAST)
    return out


def with_merged(df: DataFrame, probabilities: str, ids: str, side: str, name: str = "merged", of: str = "groups") -> DataFrame:
    """Adds ``name``: for each group of ``of`` the merged distribution of its ``side`` (left or right), from a token's distributions and the ids that were chosen.

    Null where distributions or groups are; a group without tokens on that side has zeros.
    """
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.DoubleType())))])
    source = df.withColumns({"_p": F.col(probabilities).cast("array<array<double>>"), "_i": F.col(ids).cast("array<int>"), "_g": F.col(of)[side]})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, i, g in zip(*(batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1)), strict=True):
                table = None if p is None else np.array(p, np.float64)
                found.append(None if p is None or g is None else [merged(table, i or [], group).tolist() for group in g])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(found, pa.list_(pa.list_(pa.float64())))], names=schema.fieldNames())

    return source.mapInArrow(each, schema)
