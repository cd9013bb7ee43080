"""Metrics of batches: completion lengths, clip rates, tool use, accuracies, averaged logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completion_lengths(df: DataFrame, by: Sequence[str], length: Column, terminated: Column) -> DataFrame:
    """Mean, least and greatest length, the share cut off, and the same of terminated ones (0 where there are none)."""
    done = F.when(terminated, length)
    return df.groupBy(*by).agg(
        F.avg(length).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"),
        F.avg((~terminated).cast("int")).alias("clipped_ratio"), F.coalesce(F.avg(done), F.lit(0.0)).alias("mean_terminated"),
        F.coalesce(F.min(done), F.lit(0)).alias("min_terminated"), F.coalesce(F.max(done), F.lit(0)).alias("max_terminated"),
    )


def tool_frequency(df: DataFrame, by: Sequence[str], calls: str, failures: str) -> DataFrame:
    """Calls for each row, and failures for each call (0 without calls)."""
    n, bad = F.coalesce(F.sum(calls), F.lit(0)), F.coalesce(F.sum(failures), F.lit(0))
    return df.groupBy(*by).agg((n / F.count(F.lit(1))).alias("call_frequency"), F.when(n > 0, bad / n).otherwise(0.0).alias("failure_frequency"))


def pair_accuracy(df: DataFrame, by: Sequence[str], chosen: str, rejected: str) -> DataFrame:
    """Share of pairs whose chosen side scores higher; ties are left out (null where all are ties)."""
    differs = F.col(chosen) != F.col(rejected)
    return df.groupBy(*by).agg(F.avg(F.when(differs, (F.col(chosen) > F.col(rejected)).cast("int"))).alias("accuracy"), F.sum((~differs).cast("long")).alias("ties"))


def label_sums(df: DataFrame, by: Sequence[str], label: str, values: Sequence[str]) -> DataFrame:
    """Counts, and sums of each value by label, missing ones left out; an absent label has 0."""
    out = []
    for name, here in (("chosen", F.col(label)), ("rejected", ~F.col(label))):
        out.append(F.count(F.when(here, 1)).alias(f"count_{name}"))
        out += [F.coalesce(F.sum(F.when(here, F.col(v))), F.lit(0.0)).alias(f"{v}_{name}") for v in values]
    return df.groupBy(*by).agg(*out)


def split_sum_means(df: DataFrame, value: str) -> DataFrame:
    """Of batches of ``label_sums``: sum of the sums over sum of the counts of each side, and the margin between them."""
    mean = lambda side: F.sum(f"{value}_{side}") / F.nullif(F.sum(f"count_{side}"), F.lit(0))
    return df.agg(mean("chosen").alias("chosen"), mean("rejected").alias("rejected"), (mean("chosen") - mean("rejected")).alias("margin"))


def sequence_policy_loss(df: DataFrame, by: Sequence[str], logp: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """The clipped loss of whole sequences, with the shares clipped below, above and on either side."""
    ratio = F.exp(logp - old)
    clipped = F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    below, above = (ratio < 1 - low) & (advantage < 0), (ratio > 1 + high) & (advantage > 0)
    share = lambda c, name: F.avg(c.cast("int")).alias(name)
    return df.groupBy(*by).agg(F.avg(-F.least(ratio * advantage, clipped * advantage)).alias("loss"), share(below, "low"), share(above, "high"), share(below | above, "region"))


def averaged_logs(df: DataFrame, step: str, every: int, key: str, value: str, evaluating: bool = False) -> DataFrame:
    """Each metric's mean over the steps of a flush; names of evaluation begin with eval_."""
    name = F.concat(F.lit("eval_"), F.col(key)) if evaluating else F.col(key)
    return df.groupBy(F.ceil(F.col(step) / every).alias("flush"), name.alias("key")).agg(F.avg(value).alias("mean"))


#: From where on a moving value is high, and up to where low.
HIGH, LOW = 0.7, 0.3


def prior_summary(df: DataFrame, code: str, reason: str, weight: str, seen: str, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Over seen questions (``seen`` above 0): means of both moving values and the weight; questions of high value (reason high, code low) and of low value (both low).

    Without a seen question there is no row.
    """
    reasoned, failing = F.col(reason), F.col(code) <= low
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.where(F.col(seen) > 0).agg(
        F.avg(code).alias("code"), F.avg(reason).alias("reason"), F.avg(weight).alias("weight"),
        count((reasoned >= high) & failing).alias("high_value"), count((reasoned <= low) & failing).alias("low_value"), F.count(F.lit(1)).alias("seen"),
    ).where("seen > 0")


def batch_metrics(df: DataFrame, by: Sequence[str], rollout: str, reward: str, rate: str, advantage: str, main: Column, resamples: str) -> DataFrame:
    """Of the samples of a batch: means over its rollouts of each rollout's mean reward, mean pass rate and population spread of rewards; sums of nodes and resamples;
    extremes over samples; the share of advantages of 0; auxiliary samples for each main one (null without main ones).

    ``resamples`` is told by every sample of a rollout, the same. A hot rollout is combined before the shuffle.
    """
    mains = F.sum(main.cast("long"))
    each = df.groupBy(*by, rollout).agg(
        F.avg(reward).alias("_mean"), F.avg(rate).alias("_rate"), F.stddev_pop(reward).alias("_std"), F.count(F.lit(1)).alias("_n"), F.max(resamples).alias("_again"),
        F.min(reward).alias("_lo"), F.max(reward).alias("_hi"), F.min(rate).alias("_rlo"), F.max(rate).alias("_rhi"),
        F.sum((F.abs(advantage) < 1e-8).cast("long")).alias("_zero"), F.count(advantage).alias("_told"), mains.alias("_main"), F.sum((~main).cast("long")).alias("_aux"),
    )
    return each.groupBy(*by).agg(
        F.avg("_mean").alias("mean_reward"), F.avg("_rate").alias("mean_rate"), F.avg("_std").alias("std_reward"), F.sum("_n").alias("nodes"), F.sum("_again").alias("resamples"),
        F.min("_lo").alias("min_reward"), F.max("_hi").alias("max_reward"), F.min("_rlo").alias("min_rate"), F.max("_rhi").alias("max_rate"),
        (F.sum("_zero") / F.nullif(F.sum("_told"), F.lit(0))).alias("zero_advantage"), (F.sum("_aux") / F.nullif(F.sum("_main"), F.lit(0))).alias("aux_per_main"),
    )
