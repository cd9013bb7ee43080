import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import losses, prepare, rewards, text, tokens
from lodestone.operators import convert, curate, execute, groups, metrics, packing, problems, rollout
from lodestone.sources import records
from lodestone.streaming import state


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_bfd_goldens():
    bins = lambda lengths, limit, overflow="drop": [[(r, a, b) for r, a, b in x] for x in packing.best_fit_decreasing(lengths, limit, overflow)]
    assert bins([3, 4, 1], 4) == [[(1, 0, 4)], [(0, 0, 3), (2, 0, 1)]]
    assert [[b - a for _, a, b in x] for x in bins([5, 2, 4, 1], 4, "requeue")] == [[4], [4], [2, 1, 1]]
    assert [[b - a for _, a, b in x] for x in bins([5, 2, 4, 1], 4)] == [[4], [4], [2, 1]]
    assert bins([0, 0], 4) == []


def test_packing(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4, 5, 6, 7]), (0, 3, [8])], "b int, i int, ids array<int>")
    rows = lambda x: [r.ids for r in x.orderBy("row").collect()]
    assert rows(packing.pack_wrapped(df, "ids", "b", "i", 3)) == [[1, 2, 3], [4, 5, 6], [7, 8]]
    out = packing.pack_bfd(df, ["ids"], "b", "i", 4).orderBy("row").collect()
    assert [(r.ids, r.seq_lengths) for r in out] == [([4, 5, 6, 7], [4]), ([1, 2, 3, 8], [3, 1])]
    assert [r.ids for r in packing.truncate(df, 2).orderBy("i").collect()] == [[1, 2], [4, 5], [8]]


def test_extract_prompt(spark):
    df = spark.createDataFrame([("The sky is blue.", "The sky is green.")], "chosen string, rejected string")
    assert tuple(convert.extract_prompt(df).select("prompt", "chosen", "rejected").first()) == ("The sky is", " blue.", " green.")
    same = spark.createDataFrame([("ab", "ab"), ("x", "y")], "chosen string, rejected string")
    assert sorted(tuple(r) for r in convert.extract_prompt(same).select("prompt", "chosen", "rejected").collect()) == [("", "x", "y"), ("a", "b", "b")]


def test_unpair(spark):
    df = spark.createDataFrame([("p1", "blue", "green"), ("p2", "in the sky", "in the sea")], "prompt string, chosen string, rejected string")
    assert sorted((r.completion, r.label) for r in convert.unpair(df).collect()) == sorted([("blue", True), ("in the sky", True), ("green", False), ("in the sea", False)])


def test_think_format(spark):
    good = ["<think>a</think>b", "<think>\na\n</think>\n", "<think></think>"]
    bad = ["a", "<think>a", " <think>a</think>", "<think><think>a</think>", "</think>"]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string").orderBy("i").select(text.think_format(F.col("t")).alias("x")).collect()]
    assert got == [1.0] * 3 + [0.0] * 5


def test_scalar_rewards(spark):
    assert [value(spark, rewards.overlong_penalty(F.lit(n), 100, 20)) for n in (50, 90, 110)] == [0.0, -0.5, -1.0]
    assert value(spark, losses.logsigmoid(F.lit(-800.0))) == -800.0
    assert value(spark, rewards.numeric_equal(F.lit("1/2"), F.lit("0.5"))) == 1.0
    assert value(spark, rewards.numeric_equal(F.lit("1/2"), F.lit("about half"))) is None
    assert value(spark, rewards.reasoning_answer(F.lit("a</think>b</think> c"), ["</think>"])) == " c"


def test_gae(spark):
    got = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.5, 0.5])], "r array<double>, v array<double>").select(tokens.gae("r", "v", 0.9, 0.95).alias("g")).first().g
    assert got == pytest.approx([4.4448125, 4.0875, 2.5])


def test_lambda_names_do_not_capture(spark):
    df = spark.createDataFrame([([1.0, 3.0, 9.0], [1.0, 1.0, 0.0])], "m array<double>, x array<double>")
    row = df.select(tokens.masked_mean("m", "x").alias("mean"), tokens.masked_var("m", "x").alias("var")).first()
    assert (row["mean"], row["var"]) == (2.0, 2.0)


def test_numbered(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.hash("id"))
    got = groups.numbered(df, "k", name="n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)


def test_representative(spark):
    cases = [{"input": "x" * n, "output": ""} for n in (7, 1, 5, 3, 9, 2, 8)]
    df = spark.createDataFrame([(cases,)], "c array<struct<input:string,output:string>>")
    assert [len(x.input) for x in df.select(curate.representative("c", 3).alias("r")).first().r] == [1, 5, 9]
    assert len(df.select(curate.representative("c", 0).alias("r")).first().r) == 7


def test_cumulative(spark):
    df = spark.createDataFrame([("q", 1, 0.25)], "q string, round int, rate double")
    got = rollout.cumulative_eval(df, "q", "round", "rate", 4).orderBy("round").collect()
    assert [(r.best_within, r.solved_within) for r in got] == [(0.25, 0)] * 4


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\nbroken\n{"id": 3}\n')
    schema = T.StructType([T.StructField("id", T.LongType())])
    lines = records.numbered_lines(spark, str(tmp_path / "a.jsonl"))
    ids = lambda mode: [r.id for r in records.parsed(lines, schema, mode).orderBy("line").collect()]
    assert ids("prefix") == [1, 2] and ids("lossy") == [1, 2, 3]
    with pytest.raises(Exception, match="bad record"):
        ids("strict")
    for name, content in (("l.json", [{"id": 5}, {"id": 6}]), ("d.json", {"meta": 1, "data": [{"id": 5}, {"id": 6}]}), ("one.json", {"id": 5})):
        (tmp_path / name).write_text(json.dumps(content))
        got = [r.id for r in records.load(spark, str(tmp_path / name), schema).collect()]
        assert got == ([5] if name == "one.json" else [5, 6])
    spark.range(10).write.parquet(str(tmp_path / "t.parquet"))
    assert records.load(spark, str(tmp_path / "t.parquet"), limit=4).count() == 4
    with pytest.raises(ValueError, match="unsupported"):
        records.load(spark, "x.csv")
    (tmp_path / "log.jsonl").write_text('{"nodeid": "t1", "outcome": "failed", "duration": 0.5}\n{"nodeid": "t2", "outcome": "passed"}\n')
    row = records.test_report(records.numbered_lines(spark, str(tmp_path / "log.jsonl"))).first()
    assert (row.records, row.failed, row.failures) == (2, 1, ["t1 0.5000"])


def test_execution(spark):
    assert execute.run_cases("print(int(input()) * 2)", ["2", "x"])[0] == ("OK", "4\n", "")
    assert execute.run_cases("print(int(input()) * 2)", ["x"])[0][0] == "RUNTIME_ERROR"
    assert execute.run_cases("def solve(a): return [a, a]", ["3"], stdio=False) == [("OK", "[3, 3]", "")]
    assert execute.run_cases("def (", ["1", "2"])[1][0] == "SYNTAX_ERROR"
    assert execute.run_cases("while True: pass", ["1"], seconds=0.5) == [("TIMEOUT", "", "")]
    df = spark.createDataFrame([("print(input())", ["a", "b"])], "code string, given array<string>")
    with pytest.raises(PermissionError):
        execute.execute(df, "code", "given")
    assert [x.value for x in execute.execute(df, "code", "given", allowed=True).first().results] == ["a\n", "b\n"]


def test_literals():
    assert execute.values_equal("[1, 2, 3]", (1, 2, 3)) and execute.values_equal({"a": 1.0}, {"a": 1.0 + 1e-7}) and execute.values_equal(" a   b ", "a b")
    assert not execute.values_equal("[1]", "[1, 2]") and execute.values_equal(True, 1)
    assert execute.novelty(["x"]) == [1.0] and execute.novelty(["ab", "ab"]) == [0.0, 0.0]
    assert execute.parse_assert("assert f(1, [2], k=3) == 'x'") == ("f", [1, [2]], {"k": 3}, "x")
    assert execute.parse_assert("assert 5 == g()") == ("g", [], {}, 5) and execute.parse_assert("assert not h(1)") == ("h", [1], {}, False)
    assert execute.parse_assert("x = 1") is None and execute.input_mode([("f", [1], {}, 1), ("f", [], {}, 1)]) == "args_list"
    assert execute.has_entry("def solve(x):\n return x") and not execute.has_entry("def (")
    assert execute.aligned_groups(["ab", "c", "d"], ["a", "bc", "d"]) == [([0, 1], [0, 1]), ([2], [2])]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 0.0), ("a", 3, 0.0), ("b", 2, None)]
    df = spark.createDataFrame(rows, "k string, step long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = state.ema_prior_stream(stream, "k", "v", "step", 0.8).writeStream.outputMode("update").format("memory").queryName("priors").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.k: (r.ema, r.seen, r.streak) for r in spark.table("priors").collect()}
    batch = {r.k: (r.ema, r.seen) for r in rollout.ema_prior(df, "k", ["step"], "v", 0.8).collect()}
    assert {k: v[:2] for k, v in got.items()} == batch and got["a"][2] == 2


def test_numbered_on_many_parts(spark):
    """Every row once, in order, with an unused wide column and parts whose sort could fall differently."""
    df = spark.range(0, 200_000, 1, 16).select((F.col("id") * 7919 % 200_003).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    got = groups.numbered(df, "k", name="n").agg(F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert tuple(got) == (200_000, 200_000, 0, 199_999)
    ordered = groups.numbered(df.select("k"), "k", name="n").orderBy("n").limit(1000).collect()
    assert [r.n for r in ordered] == list(range(1000)) and [r.k for r in ordered] == sorted(r.k for r in ordered)
    parts = {r.split: r["count"] for r in curate.ratio_split(df, "k", ("train", "validation", "test"), (0.7, 0.15, 0.15)).groupBy("split").count().collect()}
    assert parts == {"train": 140_000, "validation": 30_000, "test": 30_000}


def test_priors_by_literals(spark):
    weight = lambda c, r, n: value(spark, rewards.prior_weight(F.lit(c), F.lit(r), F.lit(n)))
    assert [weight(0.9, 0.8, 1), weight(0.1, 0.2, 3), weight(0.1, 0.2, 2), weight(0.2, 0.5, 9), weight(0.6, 0.3, 9), weight(0.5, 0.4, 1)] == [0.4, 0.2, 0.8, 1.0, 0.7, 0.8]
    keep = lambda p, s, a, **k: round(value(spark, rewards.keep_probability(F.lit(p), F.lit(s).cast("int"), F.lit(a), **k)), 9)
    assert keep(0.8, None, 5) == 0.8 and keep(0.8, 2, 5) == 0.8 and keep(0.8, 3, -1) == 0.4 and keep(0.8, 9, 0) == 0.1
    assert keep(0.8, 4, 10, per_step=0.02, most=0.1) == 0.3 and keep(0.01, 0, 0) == 0.05
    assert value(spark, rewards.composite(F.lit(0.0), F.lit(True), F.lit(1.0), F.lit(0.0), F.lit(True), 7.0, -1.0, 0.0)) == 1.0


def test_losses_by_literals(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1, 1]), ([3.0, 0.0, 6.0], [1, 0, 1])], "l array<double>, m array<int>")
    # sequence level: mean of (3/2 * 2, 9/3 * 2); token level: (3 * 2 + 9 * 2) / (2 * 3)
    assert losses.reduce_policy("luspo", df, "l", "m", level="sequence").first().loss == pytest.approx(4.5)
    assert losses.reduce_policy("luspo", df, "l", "m").first().loss == pytest.approx(4.0)
    assert value(spark, losses.nash_md_loss("array(-1D, -2D)", "array(-1.5D, -1D)", F.lit(0.75), 0.1)) == pytest.approx(0.1 * (0.5 * -1 + -1 * -2) - 0.25 * -3)
    assert value(spark, losses.xpo_loss(F.lit(1.0), F.lit(3.0), F.lit(-4.0), 0.1, 0.5, "ipo")) == pytest.approx(49 - 2)
    assert value(spark, losses.divergence_scores("alpha_divergence", F.lit(0.7), 1.0)) == 0.7
    assert value(spark, tokens.discounted_suffix("array(1D, 2D, 4D)", 0.5)) == [3.0, 2.0, 1.0]
    assert value(spark, tokens.discounted_suffix("array(1D, 2D, 4D)", 0.5, "array(1, 1, 0)", True)) == pytest.approx([2 / 1.500025, 1 / 0.500025, 0.0])
    assert value(spark, tokens.discounted_suffix("array(1D, 2D)", 0.0)) == [1.0, 2.0]


def test_code_blocks(spark):
    cases = [
        ("```python\nx = 1\n```", "x = 1", True), ("a ```x``` b", "x", False), ("```\na\n```\n```py\nb\n```", "py\nb", False), ("```python\nopen", "open", False),
        ("text ```python\nopen", "text ```python\nopen", False), ("<CODE> y </CODE>", "y", True), ("<code>y</code><code>z</code>", "z", False), ("﻿ plain ", "plain", False),
    ]
    got = [tuple(r) for r in spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").orderBy("i").select(text.code_of(F.col("t")), text.format_ok(F.col("t"))).collect()]
    assert got == [c[1:] for c in cases]
    assert value(spark, text.signature(F.lit("One\rTwo\r\n<b>3!"))) == "one two 3"
    assert value(spark, rewards.reasoning_accuracy(F.lit("no end 4"), F.lit("4"), ["</think>"])) == 0.0
    assert value(spark, curate.mentions(F.lit("Use File Output here"), curate.FILE_IO)) and value(spark, curate.imports_packages(F.lit("x\nfrom requests import get")))


def test_token_preparation(spark):
    one = lambda *columns: tuple(spark.range(1).select(*columns).first())
    assert one(prepare.completion_mask("array(7, 8)", "array(7, 8, 9)"), prepare.is_prefix("array(7, 9)", "array(7, 8, 9)")) == ([0, 0, 1], False)
    assert one(prepare.with_bos("array(1, 2)", 1), prepare.with_bos("cast(array() as array<int>)", 1), prepare.with_eos("array(1)", 2), prepare.with_bos("array(5)", None)) == ([1, 2], [1], [1, 2], [5])
    assert one(prepare.after_stop("array(4, 9, 9, 5)", 9, 0), prepare.after_stop_mask("array(4, 5)", 9)) == ([4, 9, 0, 0], [1, 1])
    assert one(*prepare.collated("array(1, 2, 3)", "array(4, 5)", 3)) == ([3, 4, 5], [-100, 4, 5])
    assert one(*prepare.matches("array(1, 2, 3)", "array(1, -100, 4)")) == (1, 2)
    assert one(prepare.sequence_logp("array(-1D, -3D)", "array(-100, 5)", True), prepare.sequence_logp("array(-1D)", "array(-100)", True)) == (-3.0, None)
    assert one(prepare.shared_prefix("array(1, 2, 3)", "array(1, 2)"), prepare.shared_prefix("array(1)", "array(2)")) == (2, 0)
    pairs = spark.createDataFrame([(0, 1.0, 0.0), (0, 0.0, 1.0), (0, 2.0, 2.0)], "g int, c double, r double")
    assert metrics.pair_accuracy(pairs, ["g"], "c", "r").first().accuracy == 0.5
    lengths = spark.createDataFrame([(0, 3, False), (0, 5, False)], "g int, n int, done boolean")
    assert tuple(metrics.completion_lengths(lengths, ["g"], F.col("n"), F.col("done")).first()) == (0, 4.0, 3, 5, 1.0, 0.0, 0, 0)


def test_code_problems(spark):
    raw = [
        ("add two numbers", ["1 2\n", "7 8\n", "10 5\n", "1 2\n"], ["3\n", "15\n", "15\n", "3\n"], ["print(sum(map(int, input().split())))"], ["Python3"], None),
        ("x", ["1"], ["1"], ["print(1)"], ["python"], "solve"), ("x", [], [], ["print(1)"], ["py"], None), (" ", ["1"], ["1"], ["print(1)"], ["py"], None), ("x", ["1"], ["1", "2"], ["int main() {}"], ["3"], None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "i int, prompt string, a array<string>, b array<string>, s array<string>, l array<string>, fn string")
    rows = df.withColumns({"cases": problems.paired_cases("a", "b"), "solutions": problems.python_solutions("s", "l")})
    got = problems.normalised(rows, "prompt", "cases", "solutions", "fn").orderBy("i").collect()
    assert [r.reject_reason for r in got] == [None, "non_stdio_task", "missing_tests", "missing_prompt", "missing_python_reference_solution"]
    assert (got[0].source_test_count, got[0].selected_test_count, got[0].oversized_test_count) == (3, 3, 0)
    assert [c.input for c in got[0].diagnostics] == ["1 2\n", "7 8\n", "10 5\n"]
