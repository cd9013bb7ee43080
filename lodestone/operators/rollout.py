"""Analytics of rollouts: pass@k, cumulative and repeated evaluation, reward windows, priors and pools.

A rollout's nodes have a generation order; every operator takes it as an ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k(df: DataFrame, rollout: str, ordinal: str, rate: str, ks: list[int]) -> DataFrame:
    """By rollout: for each k whether one of the first k nodes passes all, and the best pass rate."""
    w = Window.partitionBy(rollout).orderBy(ordinal)
    ranked = df.withColumn("_n", F.row_number().over(w))
    flags = [F.max(((F.col("_n") <= k) & (F.col(rate) >= 1.0)).cast("int")).alias(f"pass_at_{k}") for k in ks]
    return ranked.groupBy(rollout).agg(*flags, F.max(rate).alias("best"))


def cumulative_eval(df: DataFrame, rollout: str, round_: str, rate: str, rounds: int) -> DataFrame:
    """For each round 1..rounds: solved within, best within; carried forward past an early stop."""
    per = df.groupBy(rollout, F.col(round_).alias("round")).agg(F.max(rate).alias("_best"))
    grid = df.select(rollout).distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    w = Window.partitionBy(rollout).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    best = F.coalesce(F.max("_best").over(w), F.lit(0.0))
    return grid.join(per, [rollout, "round"], "left").withColumn("best_within", best).withColumn("solved_within", (F.col("best_within") >= 1.0).cast("int")).drop("_best")


def repeat_eval(df: DataFrame, repeat: str, metrics: list[str]) -> DataFrame:
    """By metric: mean of each repeat, then mean and population deviation over the repeats; absent values count 0."""
    means = df.groupBy(repeat).agg(*[F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics])
    long = means.unpivot([repeat], metrics, "metric", "_v")
    return long.groupBy("metric").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def rollout_summary(df: DataFrame, rollout: str, reward: str, rate: str) -> DataFrame:
    """By rollout: nodes, means, least and greatest, shares of passing and of zero rewards, and whether rewards differ."""
    share = lambda c: F.avg(c.cast("int"))
    std = F.coalesce(F.stddev_pop(reward), F.lit(0.0))
    return df.groupBy(rollout).agg(
        F.count(F.lit(1)).alias("nodes"), F.avg(reward).alias("mean_reward"), F.min(reward).alias("min_reward"), F.max(reward).alias("max_reward"), F.avg(rate).alias("mean_pass"),
        F.max(rate).alias("best_pass"), share(F.col(rate) >= 1.0).alias("pass_share"), share(F.abs(reward) <= 1e-12).alias("zero_share"), (std <= 1e-8).alias("zero_variance"),
        ((F.count(F.lit(1)) == 2) & (F.max(reward) - F.min(reward) < 1e-8)).alias("pair_equal"),
    )


def reward_window(df: DataFrame, step: str, value: str, interval: int) -> DataFrame:
    """Means over tumbling windows of steps; a window is named by its last step (the final one by the last there is)."""
    w = df.groupBy(F.ceil(F.col(step) / interval).alias("window")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.max(step).alias("upto"))
    return w


def ema(values: str, momentum: float) -> Column:
    """SQL array of values in order: the first, then momentum times old plus the rest times new."""
    return F.expr(f"aggregate(slice({values}, 2, greatest(size({values}) - 1, 0)), double({values}[0]), (s__, x__) -> {momentum!r}D * s__ + {1 - momentum!r}D * x__)")


def ema_prior(df: DataFrame, key: str, order: list[str], value: str, momentum: float) -> DataFrame:
    """By key: the moving mean of all its values in order, and how many. A key's series is folded in one row."""
    series = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_a"))
    series = series.withColumn("_a", F.transform("_a", lambda x: x["_v"]))
    return series.select(key, ema("_a", momentum).alias("ema"), F.size("_a").alias("seen"))


def streak(df: DataFrame, key: str, order: list[str], passed: str) -> DataFrame:
    """By key: how many entries in a row at the end do not pass."""
    at = F.struct(*order)
    last = df.groupBy(key).agg(F.max(F.when(F.col(passed), at)).alias("_last"))
    return df.join(last, key).groupBy(key).agg(F.sum(F.when(F.col("_last").isNull() | (at > F.col("_last")), 1).otherwise(0)).alias("streak"))


def pool(df: DataFrame, order: str, now: int, ttl: int, capacity: int, solved: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """Entries younger than ``ttl`` of questions that are not solved, the latest ``capacity`` of them."""
    kept = df.where(F.lit(now) - F.col(order) < ttl)
    if solved is not None:
        kept = kept.join(solved.select(base).distinct(), base, "left_anti")
    return kept.orderBy(F.col(order).desc()).limit(capacity)


def running_moments(df: DataFrame, order: list[str], value: str, partition: str) -> DataFrame:
    """Mean, sample deviation and count of all values up to each row of a partition."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"mean": F.avg(value).over(w), "std": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)), "count": F.count(value).over(w)})


def last_best(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """By key: the last and the greatest value that is not null."""
    there = df.where(F.col(value).isNotNull())
    return there.groupBy(key).agg(F.max_by(value, order).alias("last"), F.max(value).alias("best"))


def kl_mismatch(df: DataFrame, batch: str, ordinal: str, completion: str) -> DataFrame:
    """Adds mismatched: the completion before in the batch, for the first the last."""
    w = Window.partitionBy(batch).orderBy(ordinal)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("mismatched", F.coalesce(F.lag(completion).over(w), F.last(completion).over(whole)))


def fifo_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, value: str) -> DataFrame:
    """Each row of the left takes the next unused right row of its key, in order; null when they are used up."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.select(key, value, F.row_number().over(Window.partitionBy(key).orderBy(right_order)).alias("_n"))
    return a.join(b, [key, "_n"], "left").drop("_n")


def vocabulary_map(left: DataFrame, right: DataFrame, token: str, left_id: str, right_id: str) -> DataFrame:
    """(token, left id, right id): full outer, so unmatched ones of either side are the rows with a null."""
    return left.select(token, left_id).join(right.select(token, right_id), token, "full_outer")


def win_rate(df: DataFrame, score: str) -> DataFrame:
    """Share of rows whose reference score is not above one half, and the mean soft win probability."""
    return df.agg(F.avg((F.col(score) <= 0.5).cast("int")).alias("win_rate"), (1 - F.avg(score)).alias("soft_win"))
