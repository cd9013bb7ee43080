"""Sampling from a replay buffer by score, and filling a batch's holes from it.

With replacement, a draw is a uniform number on the scores laid end to end. The buffer is dealt by ranges of its key; the sums
of the ranges, one row a task, tell each draw its range; there draws and rows are sorted together by position and each
draw takes the next row's key. No draw meets every row, and the same seed gives the same draws, however the rows lie.

Results for odd input: rows without a positive score are never drawn; a buffer without one gives no draws; scores must be finite;
keys should be distinct; a null key is not drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import tokens as t
from lodestone.operators.groups import _checkpoint_dir, hash_uniform, weighted_sample


def draws(buffer: DataFrame, score: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key) for draws 0 to n - 1, with replacement, in proportion to the scores."""
    _checkpoint_dir(buffer)
    rows = buffer.select(F.col(key).alias("_key"), F.col(score).cast("double").alias("_w")).where("_key is not null and _w > 0")
    placed = rows.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = sums.withColumns({"_before": before, "_total": F.sum("_sum").over(Window.partitionBy())})
    made = buffer.sparkSession.range(n).select(F.col("id").alias("draw"), hash_uniform(F.lit(str(seed)), F.col("id").cast("string")).alias("_u"))
    here = (F.col("_u") * F.col("_total") >= F.col("_before")) & (F.col("_u") * F.col("_total") < F.col("_before") + F.col("_sum"))
    dealt = made.join(F.broadcast(parts), here).select("_part", (F.col("_u") * F.col("_total") - F.col("_before")).alias("_at"), F.lit(1).alias("_kind"), "draw", F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"))
    along = Window.partitionBy("_part").orderBy("_key")
    upto = F.sum("_w").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ends = F.when(F.lead("_key").over(along).isNull(), F.lit(float("inf"))).otherwise(upto)  # no rounding leaves a draw without a row
    laid = placed.select("_part", ends.alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("draw"), "_key")
    # from the far end on: a frame that only grows is read once, one that shrinks is read anew for each row
    line = Window.partitionBy("_part").orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_key")).rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last("_key", ignorenulls=True).over(line)
    return laid.unionByName(dealt).withColumn("_next", nearest).where("_kind = 1").select("draw", F.col("_next").alias(key))


def sampled(buffer: DataFrame, score: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key): without replacement as long as enough rows have a positive score, else with it."""
    good = buffer.where(F.col(score) > 0)
    if good.limit(n).count() < n:
        return draws(buffer, score, key, n, seed)
    chosen = weighted_sample(good.select(score, key), score, key, n, seed)
    ranked = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed} order"), F.col(key).cast("string"))), key)) - 1
    return chosen.select(ranked.cast("long").alias("draw"), key)


def refilled(batch: DataFrame, buffer: DataFrame, group: str, replace: str, score: str, prompt: str, completion: str, pad: int = 0, seed: int = 0) -> DataFrame:
    """The batch with each group marked ``replace`` (a column that is the same for a whole group) exchanged for a group drawn from the buffer; ``drawn_from`` names it (null: kept).

    Prompts (arrays of ids) are padded on the left and completions on the right to the longest of the new batch. Both
    tables have the same columns but for ``replace``; the buffer has a score for each row, the same for a whole group. Without
    a group that can be drawn the batch stays, padded. A batch has as many groups as a step trains on.
    """
    columns = [c for c in batch.columns if c != replace]
    marked = F.coalesce(F.col(replace), F.lit(False))
    holes = batch.where(marked).select(group).distinct().withColumn("draw", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))
    scored = buffer.groupBy(group).agg(F.max(score).alias("_score"))
    n = holes.count()
    rows = batch.select(*columns, F.lit(None).cast(batch.schema[group].dataType).alias("drawn_from"), marked.alias("_hole"))
    if n and not scored.where("_score > 0").isEmpty():
        picks = holes.withColumnRenamed(group, "_to").join(sampled(scored, "_score", group, n, seed).withColumnRenamed(group, "drawn_from"), "draw")
        taken = buffer.join(F.broadcast(picks), F.col(group) == F.col("drawn_from"))
        taken = taken.select(*[F.col("_to").alias(group) if c == group else F.col(c) for c in columns], "drawn_from", F.lit(False).alias("_hole"))
        rows = rows.where(~F.col("_hole")).unionByName(taken)
    longest = rows.agg(F.coalesce(F.max(F.size(prompt)), F.lit(0)).alias("_p"), F.coalesce(F.max(F.size(completion)), F.lit(0)).alias("_c"))
    rows = rows.crossJoin(F.broadcast(longest))
    filled = {prompt: t.padded(prompt, "_p", str(pad), "left"), completion: t.padded(completion, "_c", str(pad), "right")}
    return rows.withColumns(filled).drop("_p", "_c", "_hole")
