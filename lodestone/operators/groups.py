"""Statistics within groups of samples of one prompt: advantages, leave-one-out, top-k, replay and sampling.

Missing rewards are NULL, never NaN. Every order-dependent operator takes an ordinal column.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-4
CODE_EPS = 1e-8


def weighted_sum(rewards: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted sum over the rewards that apply; 0 when none does."""
    total = F.lit(0.0)
    for r, w in zip(rewards, weights, strict=True):
        total = total + F.lit(float(w)) * F.coalesce(F.col(r).cast("double"), F.lit(0.0))
    return total


def _std(value: Column, window) -> Column:
    """Sample standard deviation, 0 for one row."""
    return F.coalesce(F.stddev_samp(value).over(window), F.lit(0.0))


def with_batch(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Adds aggregates over all rows: one row of numbers, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def group_advantage(df: DataFrame, rewards: Sequence[str], weights: Sequence[float], group: str, scale: str = "group", eps: float = EPS) -> DataFrame:
    """Adds reward, advantage and is_std_zero: reward less the group's mean, scaled by the group's, the batch's or no deviation."""
    w = Window.partitionBy(group)
    df = df.withColumn("reward", weighted_sum(rewards, weights))
    centred = F.col("reward") - F.avg("reward").over(w)
    if scale == "batch":
        df = with_batch(df, F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("_std"))
    else:
        df = df.withColumn("_std", _std(F.col("reward"), w))
    advantage = centred if scale == "none" else centred / (F.col("_std") + eps)
    return df.withColumns({"advantage": advantage, "is_std_zero": F.abs("_std") <= 1e-8}).drop("_std")


def normalize_then_sum(df: DataFrame, rewards: Sequence[str], weights: Sequence[float], group: str, eps: float = EPS) -> DataFrame:
    """Adds advantage: each reward standardised in its group, weighted sum, standardised over the batch."""
    w = Window.partitionBy(group)
    total = F.lit(0.0)
    for r, weight in zip(rewards, weights, strict=True):
        z = (F.col(r) - F.avg(r).over(w)) / (F.stddev_samp(r).over(w) + eps)
        total = total + F.coalesce(z * float(weight), F.lit(0.0))
    df = with_batch(df.withColumn("_z", total), F.avg("_z").alias("_m"), F.coalesce(F.stddev_samp("_z"), F.lit(0.0)).alias("_s"))
    return df.withColumn("advantage", (F.col("_z") - F.col("_m")) / (F.col("_s") + eps)).drop("_z", "_m", "_s")


def code_advantage(df: DataFrame, base: str, group: str, mode: str = "zscore", eps: float = CODE_EPS) -> DataFrame:
    """Adds advantage by population statistics: zscore, mean_only, or sign (pairs only; other sizes as mean_only)."""
    w = Window.partitionBy(group)
    mean, std, n = F.avg(base).over(w), F.coalesce(F.stddev_pop(base).over(w), F.lit(0.0)), F.count(base).over(w)
    centred = F.col(base) - mean
    if mode == "zscore":
        out = centred / (std + eps)
    elif mode == "mean_only":
        out = centred
    elif mode == "sign":
        out = F.when(n != 2, centred).when(std <= 1e-8, 0.0).otherwise(F.signum(centred))
    else:
        raise ValueError(f"mode {mode!r}")
    return df.withColumn("advantage", out)


def leave_one_out(df: DataFrame, reward: str, kl: str, group: str, beta: float, clip: tuple[float, float] | None = None, standardise: bool = False) -> DataFrame:
    """Adds advantage: clipped reward less beta times KL, against the mean of the others of the group; 0 where there are none."""
    w = Window.partitionBy(group)
    r = F.col(reward) if clip is None else F.greatest(F.least(F.col(reward), F.lit(clip[1])), F.lit(clip[0]))
    df = df.withColumn("_r", r - beta * F.col(kl))
    n = F.count("_r").over(w)
    df = df.withColumn("advantage", F.when(n > 1, F.col("_r") - (F.sum("_r").over(w) - F.col("_r")) / (n - 1)).otherwise(0.0)).drop("_r")
    if standardise:
        df = with_batch(df, F.avg("advantage").alias("_m"), F.coalesce(F.stddev_samp("advantage"), F.lit(0.0)).alias("_s"))
        df = df.withColumn("advantage", (F.col("advantage") - F.col("_m")) / (F.col("_s") + EPS)).drop("_m", "_s")
    return df


def top_in_group(df: DataFrame, group: str, score: str, ordinal: str, k: int) -> DataFrame:
    """The k rows of each group with the highest scores, the earlier of equal ones."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(ordinal))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def replay_top(df: DataFrame, score: str, ordinal: str, size: int) -> DataFrame:
    """What a bounded buffer holds that replaces its least only by something greater: the first of the highest."""
    return df.orderBy(F.col(score).desc(), F.col(ordinal)).limit(size)


def replay_score(df: DataFrame, group: str, advantage: str, reward: str) -> DataFrame:
    """One row a group: sum of absolute advantages times the group's deviation; zero deviation marks it for replacement."""
    out = df.groupBy(group).agg(F.sum(F.abs(advantage)).alias("abs_sum"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("std"))
    return out.select(group, (F.col("abs_sum") * F.col("std")).alias("replay_score"), (F.col("std") <= 1e-8).alias("replace"))


def hash_uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) from the keys, the same on every engine: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", *keys))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, in proportion to the weight (floored at 1e-6): Efraimidis-Spirakis keys, least first."""
    u = hash_uniform(F.lit(str(seed)), F.col(key).cast("string"))
    race = -F.log(u) / F.greatest(F.col(weight).cast("double"), F.lit(1e-6))
    return df.withColumn("_race", race).orderBy("_race", key).limit(n).drop("_race")


def numbered(df: DataFrame, *order: Column | str, name: str = "_n", bucket: Column | None = None) -> DataFrame:
    """Adds the global ordinal from 0, without bringing all rows to one task. Rows are distinct in ``order``.

    ``bucket``: a string that grows with the order and cuts the rows into parts of like size, such as the first letters of
    a hash. Its counts (one row a bucket) give each bucket its start, and rows are ranked within their bucket; a row's
    bucket and rank come from the row alone, so nothing depends on which task sees it. Without one, the sorted rows are
    stored first (a reliable checkpoint in spark.checkpoint.dir), and their parts, fixed then, are the buckets.
    """
    if bucket is None:
        _checkpoint_dir(df)
        placed = df.orderBy(*order).withColumn("_part", F.format_string("%010d", F.spark_partition_id())).checkpoint()
    else:
        placed = df.withColumn("_part", bucket)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, F.col("_rank") - 1 + F.col("_before")).drop("_part", "_rank", "_before")


def _checkpoint_dir(df: DataFrame) -> None:
    """Checkpoints go where the session says; only on one machine, and only where it says nothing, to a folder of our own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            named = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def shared_folder(df: DataFrame) -> str:
    """A folder that the whole cluster shares, below the checkpoint folder of the session."""
    _checkpoint_dir(df)
    return df.sparkSession.sparkContext.getCheckpointDir()


def repeat_sampler(df: DataFrame, ordinal: str, mini_repeat: int, batch: int, repeats: int) -> DataFrame:
    """Rows in batches of ``batch`` by ordinal (0-based, dense), the last partial one dropped; each batch ``repeats`` times, each row ``mini_repeat`` times.

    Adds batch, repeat, copy; their order with the ordinal is the sampler's.
    """
    last = df.agg((F.floor(F.count(F.lit(1)) / batch)).alias("_full"))
    out = df.crossJoin(F.broadcast(last)).withColumn("batch", F.floor(F.col(ordinal) / batch)).where("batch < _full").drop("_full")
    out = out.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(mini_repeat - 1))))


def candidate_picks(df: DataFrame, group: str, ordinal: str, passed: str, final: str, raw: str, normal: str, n: int, novelty: str | None = None) -> DataFrame:
    """Picks by group: the best by (passed, final), the best other by (raw, normal, final), with ``novelty`` the best other by (novelty, raw), then others by final, n in all.

    Groups are the few candidates of one rollout.
    """
    w = Window.partitionBy(group)
    first = w.orderBy(F.col(passed).desc(), F.col(final).desc(), F.col(ordinal))
    df = df.withColumn("_first", F.row_number().over(first) == 1)
    second = w.orderBy("_first", F.col(raw).desc(), F.col(normal).desc(), F.col(final).desc(), F.col(ordinal))
    df = df.withColumn("_second", ~F.col("_first") & (F.row_number().over(second) == 1))
    taken = F.col("_first") | F.col("_second")
    third = w.orderBy(taken, F.col(novelty).desc(), F.col(raw).desc(), F.col(ordinal)) if novelty else None
    df = df.withColumn("_third", ~taken & (F.row_number().over(third) == 1) if novelty else F.lit(False))
    place = F.when(F.col("_first"), 0).when(F.col("_second"), 1).when(F.col("_third"), 2).otherwise(3)
    rest = w.orderBy(place, F.col(final).desc(), F.col(ordinal))
    out = df.withColumn("pick", F.row_number().over(rest)).where(F.col("pick") <= n)
    return out.withColumn("reason", F.when(F.col("_first"), "best_pass").when(F.col("_second"), "best_soft").when(F.col("_third"), "novel").otherwise("fallback")).drop("_first", "_second", "_third")
