"""Exact interpolated quantiles without a task that holds all values.

Over a whole table the wanted ranks are narrowed down: a sketch gives bounds around each rank, the values below and
within them are counted exactly, and of each rank only the values within its bounds go on, until they are few or one. Over
groups the distinct values are counted, sorted by ranges of (group, value), and each range begins at a rank that the
counts of the ranges before it tell; a hot group covers many ranges.

Results for odd input: nulls and NaNs are left out; no value at all gives null; equal values count each; a single value is
every quantile of itself; infinities are values, interpolation between infinities of both signs is NaN, which becomes
null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.groups import _checkpoint_dir

#: So many values of a rank's range at most are sorted in one task.
FEW = 20_000
ACCURACY = 1_000
_SAFE = 3.0 / ACCURACY


def _ranks(q: float, n: int) -> tuple[int, int, float]:
    """The two ranks around a quantile of n values, and how far it is from the first to the second."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is not within 0 and 1")
    at = q * (n - 1)
    low = math.floor(at)
    return low, min(low + 1, n - 1), at - low


def at_ranks(df: DataFrame, value: Column, ranks: Sequence[int], few: int = FEW) -> dict[int, float]:
    """The values at 0-based ranks of the sorted values. Each round is two aggregations over all rows, whatever the number of ranks."""
    v = value.cast("double")
    rows = df.select(v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    first = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    open_ = {r: (first.lo, first.hi, 0, first.n) for r in set(ranks)}  # lowest and highest value, values below, values within
    found: dict[int, float] = {}
    if any(not 0 <= r < first.n for r in open_):
        raise ValueError(f"ranks of {first.n} values")
    while open_:
        for r, (lo, hi, below, n) in list(open_.items()):
            if lo == hi:
                found[r] = lo
                del open_[r]
        small = {r: x for r, x in open_.items() if x[3] <= few}
        if small:
            spans = sorted({(x[0], x[1]) for x in small.values()})
            lists = rows.agg(*[F.sort_array(F.collect_list(F.when(F.col("_v").between(lo, hi), F.col("_v")))).alias(f"s{k}") for k, (lo, hi) in enumerate(spans)]).first()
            for r, (lo, hi, below, _) in small.items():
                found[r] = lists[f"s{spans.index((lo, hi))}"][r - below]
                del open_[r]
        if not open_:
            break
        order = sorted(open_)
        sketched = []
        for r in order:
            lo, hi, below, n = open_[r]
            share = (r - below) / n
            near = [max(0.0, share - _SAFE), share, min(1.0, share + _SAFE)]
            sketched.append(F.percentile_approx(F.when(F.col("_v").between(lo, hi), F.col("_v")), near, ACCURACY).alias(f"b{r}"))
        bounds = rows.agg(*sketched).first()
        points = sorted({p for r in order for p in bounds[f"b{r}"]})
        counted = []
        for k, p in enumerate(points):
            counted += [F.count(F.when(F.col("_v") < p, 1)).alias(f"l{k}"), F.count(F.when(F.col("_v") <= p, 1)).alias(f"u{k}")]
            counted += [F.max(F.when(F.col("_v") < p, F.col("_v"))).alias(f"x{k}"), F.min(F.when(F.col("_v") > p, F.col("_v"))).alias(f"y{k}")]
        counts = rows.agg(*counted).first()
        for r in order:  # every point that is not the value itself is left out, so a round never ends as it began
            lo, hi, below, n = open_[r]
            upto = below + n
            for p in bounds[f"b{r}"]:
                k = points.index(p)
                if counts[f"l{k}"] <= r < counts[f"u{k}"]:
                    lo = hi = p
                    break
                if r < counts[f"l{k}"]:
                    if counts[f"l{k}"] < upto:
                        hi, upto = counts[f"x{k}"], counts[f"l{k}"]
                elif counts[f"u{k}"] > below:
                    lo, below = counts[f"y{k}"], counts[f"u{k}"]
            open_[r] = (lo, hi, below, upto - below)
    return found


def quantiles(df: DataFrame, value: Column, qs: Sequence[float], few: int = FEW) -> list[float | None]:
    """The quantiles of a whole table, interpolated between neighbouring values."""
    v = value.cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).count()
    wanted = [_ranks(q, max(n, 1)) for q in qs]
    if not n:
        return [None] * len(qs)
    found = at_ranks(df, value, [r for low, high, _ in wanted for r in (low, high)], few)
    out = [found[low] + (found[high] - found[low]) * share if share else found[low] for low, high, share in wanted]
    return [None if math.isnan(x) else x for x in out]


def group_quantiles(df: DataFrame, by: Sequence[str], value: Column, qs: Sequence[float]) -> DataFrame:
    """One row a group with a value: ``by`` and q0, q1..., its quantiles. Groups may be of any size and any number."""
    for q in qs:
        _ranks(q, 1)
    v = value.cast("double")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], (v + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    _checkpoint_dir(df)
    placed = counted.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_part", F.spark_partition_id()).checkpoint()
    group = Window.partitionBy(*keys)
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(group)})
    parts = parts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_part").alias("_part_"), "_before", "_all")
    same = F.col("_part") == F.col("_part_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(parts, same).withColumn("_to", upto + F.col("_before"))
    holds = lambda r: (F.col("_to") > r) & (F.col("_to") - F.col("_c") <= r)
    taken = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_all") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_all") - 1)
        taken += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_a{i}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_b{i}"), F.max(at - low).alias(f"_s{i}")]
    out = ranked.groupBy(*keys).agg(*taken)
    mixed = [F.when(F.col(f"_s{i}") == 0, F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_s{i}")) for i in range(len(qs))]
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *[F.when(~F.isnan(m), m).alias(f"q{i}") for i, m in enumerate(mixed)])
