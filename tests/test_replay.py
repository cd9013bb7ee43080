import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import density, replay


def test_draws_by_score(spark):
    buffer = spark.createDataFrame([(k, float(k % 5)) for k in range(40)] + [(None, 9.0), (99, None)], "k int, s double").repartition(5)
    n = 20000
    got = replay.draws(buffer, "s", "k", n, 7).collect()
    assert sorted(r.draw for r in got) == list(range(n))
    seen, total = collections.Counter(r.k for r in got), sum(k % 5 for k in range(40))
    assert set(seen) == {k for k in range(40) if k % 5}
    for k, c in seen.items():
        p = k % 5 / total
        assert abs(c - n * p) < 5 * (n * p * (1 - p)) ** 0.5
    again = {r.draw: r.k for r in replay.draws(buffer.repartition(2), "s", "k", n, 7).collect()}
    assert again == {r.draw: r.k for r in got} != {r.draw: r.k for r in replay.draws(buffer, "s", "k", n, 8).collect()}
    assert replay.draws(buffer.where("s = 0"), "s", "k", 5).count() == 0
    few = [r.k for r in replay.sampled(buffer, "s", "k", 10, 3).collect()]
    assert len(set(few)) == 10 and len(replay.sampled(buffer, "s", "k", 33, 3).collect()) == 33


def test_refilled(spark):
    schema = "g string, i int, p array<int>, c array<int>, s double"
    batch = spark.createDataFrame([(g, i, [1] * (i + 1), [2], 0.0) for g in "abc" for i in range(2)], schema).withColumn("hole", F.when(F.col("g") == "a", False).when(F.col("g") == "b", True))
    buffer = spark.createDataFrame([(g, i, [3] * 4, [4] * (i + 2), s) for g, s in (("x", 1.0), ("y", 0.0)) for i in range(2)], schema)
    out = replay.refilled(batch, buffer, "g", "hole", "s", "p", "c", pad=9).orderBy("g", "i").collect()
    assert [(r.g, r.i, r.drawn_from) for r in out] == [("a", 0, None), ("a", 1, None), ("b", 0, "x"), ("b", 1, "x"), ("c", 0, None), ("c", 1, None)]
    assert out[0].p == [9, 9, 9, 1] and out[0].c == [2, 9, 9] and out[2].p == [3] * 4 and out[2].c == [4, 4, 9] and out[3].c == [4, 4, 4]
    kept = replay.refilled(batch, buffer.where("s = 0"), "g", "hole", "s", "p", "c").orderBy("g", "i").collect()
    assert [(r.g, r.p) for r in kept] == [(g, [0] * (1 - i) + [1] * (i + 1)) for g in "abc" for i in range(2)]


def plain(x, y, w):
    """Newton's method on half the squared coefficients plus the weighted loss."""
    x1, beta = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ beta))
        beta -= np.linalg.solve(x1.T @ (x1 * (w * p * (1 - p))[:, None]) + ridge, x1.T @ (w * (p - y)) + ridge @ beta)
    return beta


def test_density_ratio(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), [float(v) for v in r.normal(0.8 if k < 60 else 0.0, 1, 5)]) for k in range(200)]
    df = spark.createDataFrame([*rows, (900, None), (901, [1.0] * 4 + [None]), (902, [1.0])], "k int, e array<double>").repartition(4)
    a, b = df.where("k < 60 or k = 900"), df.where("k >= 60 and k < 200 or k = 901")
    found = density.fit(a, b, "k", "e", 50, 3)
    clean = df.where("size(e) = 5 and not exists(e, x -> x is null)")
    xs, ys = [], []
    for k, side in enumerate((clean.where("k < 60"), clean.where("k >= 60"))):
        for row in density.sample(side, "k", "e", 50, 3 + k).collect():
            xs.append(row["_e"])
            ys.append(1 - k)
    beta = plain(np.array(xs), np.array(ys, float), np.ones(len(ys)))
    assert np.allclose([*found.coefficients, found.intercept], beta, atol=1e-4)
    out = {x.k: (x.p_desirable, x.weight) for x in density.with_weights(df, found, "e").collect()}
    for k, e in rows:
        p = 1 / (1 + np.exp(-(np.array(e) @ beta[:-1] + beta[-1])))
        assert out[k][0] == pytest.approx(p, abs=1e-4) and out[k][1] == pytest.approx(min(10, max(0.1, p / (1 - p + 1e-8))), rel=1e-3)
    assert out[900] == out[901] == out[902] == (None, None)
    with pytest.raises(ValueError, match="no rows"):
        density.fit(a.limit(0), b, "k", "e")


def test_unequal_sides_weigh_the_same(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(k, [r.gauss(0, 1)]) for k in range(120)], "k int, e array<double>")
    found = density.fit(df.where("k < 20"), df.where("k >= 20"), "k", "e", 1000, 1)
    p = density.with_weights(df, found, "e").agg(F.avg("p_desirable")).first()[0]
    assert 0.4 < p < 0.6
