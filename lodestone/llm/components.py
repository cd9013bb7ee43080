"""Distributed connected components with DataFrame operations only (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialise

#: So few edges are one task's work. Dealt out by the session's number of partitions, a round of them would be thousands of
#: tasks of a few rows each, and the driver keeps account of every one.
FEW = 100_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` has columns src and dst of one orderable type. Returns node, component: the least node that is reachable.

    Each round replaces the edges by as many stars at most, so no neighbourhood is ever collected: neighbours meet their
    minimum through a grouped minimum (combined before the shuffle) and an equi join, whose hot keys the adaptive
    planner can split. A round of at most ``FEW`` edges is one partition, without exchanges. Rounds are stored in the
    shared folder. Nodes of self loops only, nulls and repeated edges are dropped first; an empty input gives an empty result. It raises if ``most_rounds`` do not suffice (never seen: rounds
    grow with the square of the logarithm of the largest component).
    """
    now = materialise(_ordered(edges.where("src is not null and dst is not null and src <> dst")), "edges")
    before = _fingerprint(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        after = materialise(_round(now, before[0] <= FEW), "stars")
        mark = _fingerprint(after)
        discard(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(now.select("low", "low").distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _round(edges: DataFrame, few: bool) -> DataFrame:
    if few:
        return _small_star(_large_star(edges.coalesce(1), few), few).coalesce(1)
    return _small_star(_large_star(edges))


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood (itself included). ``few``: in one partition."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(edges.select("low", "low"))
    least = (both.coalesce(1) if few else both).groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, edges.low == least.u).select("high", F.col("m").alias("low")).distinct()


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of these. ``few``: in one partition."""
    least = edges.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
    moved = edges.join(least, edges.high == least.u).select(F.col("low").alias("high"), F.col("m").alias("low")).where("high <> low")
    both = moved.union(least.select("u", "m"))
    return (both.coalesce(1) if few else both).distinct()
