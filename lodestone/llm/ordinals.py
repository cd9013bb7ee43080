"""Ordinals within groups without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialise, without_prefix

#: Spark's row ids hold the partition above this bit.
_PART_BIT = 33


def indexed(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``df`` with ``_o_at``, the place of each row in its group by ``order`` (from 0), and ``_o_of``, the group's rows.

    Rows are dealt by ranges of (group, order), so a group of any size covers as many partitions as it fills; of each
    partition only the rows of each group are counted, and a window over these counts tells where it begins. ``df`` is
    read twice (its ranges are sampled first), so it should be stored; ``group`` must not be null. Rows that are equal
    in ``order`` follow each other in any order. The result is stored, a file's rows in order
    of (group, place); columns of ``df`` that begin with ``_o_`` are replaced.
    """
    df = without_prefix(df, "_o_")
    sort = [F.col(group), *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = materialise(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_o_row", F.monotonically_increasing_id()), label)
    part = F.shiftright("_o_row", _PART_BIT).alias("_o_part")
    spans = dealt.groupBy(F.col(group).alias("_o_group"), part).agg(F.min("_o_row").alias("_o_first"), F.count(F.lit(1)).alias("_o_n"))
    earlier = Window.partitionBy("_o_group").orderBy("_o_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"_o_before": F.coalesce(F.sum("_o_n").over(earlier), F.lit(0)), "_o_of": F.sum("_o_n").over(Window.partitionBy("_o_group"))})
    found = dealt.withColumn("_o_part", part).join(spans.withColumnRenamed("_o_part", "_o_p"), (F.col(group) == F.col("_o_group")) & (F.col("_o_part") == F.col("_o_p")))
    found = found.withColumn("_o_at", F.col("_o_row") - F.col("_o_first") + F.col("_o_before")).select(*df.columns, "_o_at", "_o_of")
    out = materialise(found.sortWithinPartitions(group, "_o_at"), label)
    discard(dealt)
    return out
