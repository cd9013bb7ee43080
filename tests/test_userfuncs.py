import pytest
from pyspark.sql import functions as F

from lodestone.operators import userfuncs

ROWS = [(1, "p", "aaa", 7), (2, None, None, 8), (3, "q", "", 9), (3, "q", "", 9)]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "i int, prompt string, completion string, reward int").withColumn("answer", F.lit("aaa"))


def test_rewards_keep_nulls_and_weights(spark):
    async def slow(prompts, completions, **_):
        return [None if p is None else 2 for p in prompts]

    functions = {"same": lambda completions, answer, **_: [float(c == a) if c else None for c, a in zip(completions, answer, strict=True)], "slow": slow, "nan": lambda i, **_: [float("nan")] * len(i), "col": F.when(F.col("i") == 3, F.lit(float("nan"))).otherwise(F.col("i"))}
    out = userfuncs.rewards(table(spark), functions, {"slow": 0.5, "col": -1.0}).orderBy("i").collect()
    assert [(r.reward_same, r.reward_slow, r.reward_nan, r.reward_col, r.reward, r.unscored) for r in out] == [(1.0, 2.0, None, 1.0, 1.0, False), (None, None, None, 2.0, -2.0, False), *[(None, 2.0, None, None, 1.0, False)] * 2]
    none = userfuncs.rewards(table(spark), {"none": lambda i, **_: [None] * len(i)}).collect()
    assert all(r.unscored and r.reward == 0.0 and r.reward_none is None for r in none)
    assert userfuncs.rewards(table(spark, []), functions).count() == 0


@pytest.mark.parametrize(("bad", "message"), [(lambda i, **_: [1.0], "gave 1 values for"), (lambda i, **_: ["x"] * len(i), "no number"), (lambda i, **_: [1.0] * (len(i) + 1), "values for")])
def test_wrong_results_are_errors(spark, bad, message):
    with pytest.raises(Exception, match=message):
        userfuncs.rewards(table(spark, [ROWS[0], ROWS[2]]).coalesce(1), {"bad": bad}).collect()


def test_registry_and_weights(spark):
    known = userfuncs.Registry()

    @known.add
    def one(i, **_):
        return [1] * len(i)

    with pytest.raises(ValueError, match="already"):
        known.add("one", one)
    with pytest.raises(KeyError, match="two"):
        known.named(["two"])
    with pytest.raises(ValueError, match="without a function"):
        userfuncs.rewards(table(spark), known.named(["one"]), {"two": 1.0})
    with pytest.raises(ValueError, match="no reward"):
        userfuncs.rewards(table(spark), {})


def test_group_filter(spark):
    rows = [(g, k, f"c{k}" if k % 4 else None, float(k % 3)) for g in ("a", "b", None) for k in range(6)]
    df = spark.createDataFrame(rows, "g string, k int, completion string, reward double").repartition(3)

    def score(group_completions, group_rewards):
        return [[r if c else None for c, r in zip(group_completions[0], group_rewards[0], strict=True)]]

    out = userfuncs.filtered_groups(df, "g", "k", score, 3).orderBy("g", "k").collect()
    assert [(r.g, r.k, r.group_score) for r in out] == [(g, k, s) for g in (None, "a", "b") for k, s in ((1, 1.0), (2, 2.0), (5, 2.0))]
    assert userfuncs.filtered_groups(df, "g", "k", score, 99).count() == 18
    for bad, message in ((lambda **_: [[1.0]], "values for"), (lambda **_: [], "scores of 0 groups")):
        with pytest.raises(Exception, match=message):
            userfuncs.filtered_groups(df, "g", "k", bad, 1).collect()
    with pytest.raises(Exception, match="larger than 5"):
        userfuncs.filtered_groups(df, "g", "k", score, 1, most=5).collect()


def test_formatting(spark):
    df = table(spark)
    want = ["1:aaa", None, "3:", "3:"]
    for function in (lambda row: None if row["completion"] is None else f"{row['i']}:{row['completion']}", F.concat(F.col("i").cast("string"), F.lit(":"), "completion")):
        out = userfuncs.formatted(df, function, "prompt", ["i", "prompt"]).orderBy("i").collect()
        assert [r.prompt for r in out] == want and out[0].asDict().keys() == {"i", "prompt"}
    with pytest.raises(Exception, match="not a text"):
        userfuncs.formatted(df, lambda row: 5).collect()
