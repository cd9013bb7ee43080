import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import quantiles

QS = [0.0, 0.001, 0.25, 0.5, 0.8, 0.999, 1.0]


def test_ten_million_values(spark):
    """No task holds all: values are narrowed down to few, and the result is numpy's."""
    df = spark.range(10_000_000, numPartitions=8).select(F.expr("pow((id * 7919 % 10000019) / 10000019D, 9) * if(id % 2 = 0, 1, -1000)").alias("x"))
    i = np.arange(10_000_000, dtype=np.int64)
    want = np.quantile(((i * 7919 % 10000019) / 10000019.0) ** 9 * np.where(i % 2 == 0, 1, -1000), QS)
    assert np.allclose(quantiles.quantiles(df, F.col("x"), QS), want, rtol=1e-9, atol=1e-300)


@pytest.mark.parametrize("few", [7, 20_000])
def test_ties_and_odd_values(spark, few):
    r = random.Random(few)
    for make in (lambda: 5.0, lambda: r.choice([1.0, 2.0, 2.0, 2.0]), lambda: r.gauss(0, 1), lambda: 10.0 ** r.randrange(-300, 300), lambda: r.choice([None, float("nan"), 1.5, -0.0, 0.0])):
        values = [make() for _ in range(r.choice([1, 2, 90]))] + [3.25]
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        clean = [v for v in values if v is not None and not math.isnan(v)]
        assert np.allclose(quantiles.quantiles(df, F.col("x"), QS, few), np.quantile(clean, QS), rtol=1e-12)
    infinite = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    assert quantiles.quantiles(infinite, F.col("x"), [0.0, 0.5, 1.0], few) == [float("-inf"), 1.0, float("inf")]
    assert quantiles.quantiles(infinite.where("x = 7"), F.col("x"), [0.5], few) == [None]
    with pytest.raises(ValueError, match="not within"):
        quantiles.quantiles(infinite, F.col("x"), [1.5])


def test_groups(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 20 + ["a", None, "b"]), r.randrange(3), r.choice([None, float("nan"), 1.0, r.random(), r.random()])) for _ in range(1500)] + [("lone", 0, 2.5), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    got = {(x.g, x.h): [x[f"q{i}"] for i in range(len(QS))] for x in quantiles.group_quantiles(df, ["g", "h"], F.col("x"), QS).collect()}
    want = {}
    for g, h, x in rows:
        if x is not None and not math.isnan(x):
            want.setdefault((g, h), []).append(x)
    assert got.keys() == want.keys() and all(np.allclose(got[k], np.quantile(want[k], QS), rtol=1e-12) for k in want)
    assert quantiles.group_quantiles(df.limit(0), ["g"], F.col("x"), [0.5]).count() == 0
