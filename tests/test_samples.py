"""Rows, samples and token preparation: literals, and what is an error."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import losses, prepare
from lodestone.operators import rows, samples


def one(spark, column, **values):
    made = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return made.select(column.alias("x")).first().x


def test_source_and_splits(spark):
    assert rows.choose_source(None, "n") == ("name", "n")
    with pytest.warns(UserWarning):
        assert rows.choose_source(["a"], "n") == ("mixture", ["a"])
    with pytest.raises(ValueError):
        rows.choose_source([], None)
    part = spark.range(1)
    assert rows.adapted_splits({"train": part}, "train", "test") == (part, None)
    assert rows.adapted_splits({"train": part, "test": part}, "train", "test", testing=True) == (None, part)
    assert rows.shared_columns(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), ["c", "z", "a"]).columns == ["a", "c"]


def test_strict_lengths(spark):
    assert one(spark, rows.strictly_zipped(a="a", b="b"), a="array(1, 2)", b="array('x', 'y')")[1].b == "y"
    with pytest.raises(PySparkException):
        one(spark, rows.strictly_zipped(a="a", b="b"), a="array(1, 2)", b="array('x')")
    left, right = spark.range(3).withColumn("a", F.lit(1)), spark.range(3).withColumn("b", F.lit(2))
    assert rows.positional_join(left, right, "id").count() == 3
    with pytest.raises(PySparkException):
        rows.positional_join(left, right.where("id < 2"), "id").collect()
    assert rows.positional_join(left.limit(0), right.limit(0), "id").count() == 0


def test_checked(spark):
    good = spark.createDataFrame([("a", "t", 1, 0.5)], "question_id string, prompt string, n int, score double")
    assert rows.checked(good, "question_id", ["prompt"], ["n"], ["score", "n"]).count() == 1
    with pytest.raises(ValueError):
        rows.checked(good, "question_id", ["n"])
    with pytest.raises(ValueError):
        rows.checked(good, "question_id", ["missing"])
    with pytest.raises(PySparkException):
        rows.checked(spark.createDataFrame([("a", None)], "question_id string, prompt string"), "question_id", ["prompt"]).collect()


def test_prompt_extraction_is_skipped_where_there_is_one(spark):
    plain = spark.createDataFrame([("p", "p a", "p b")], "prompt string, chosen string, rejected string")
    assert rows.maybe_extract_prompt(plain) is plain
    assert rows.maybe_extract_prompt(plain.select("prompt")).columns == ["prompt"]
    assert rows.maybe_extract_prompt(plain.drop("prompt")).first().prompt == "p"


def test_dialogue(spark):
    df = spark.createDataFrame([("\n\nHuman: hi\n\nAssistant: yes: a", "\n\nHuman: hi\n\nAssistant: yes: b")], "chosen string, rejected string")
    r = rows.dialogue(df, "chosen", "rejected").first()
    assert [(m.role, m.content) for m in r.prompt] == [("user", "hi")] and (r.chosen, r.rejected) == ("yes: a", "yes: b")
    assert one(spark, rows.common_start(F.lit("abcd"), F.lit("abxd"))) == "ab" and one(spark, rows.common_start(F.lit(""), F.lit("a"))) == ""
    assert one(spark, rows.common_start(F.lit("same"), F.lit("same"))) == "same"


def test_json_and_modes(spark):
    assert one(spark, rows.without_nulls(F.expr("struct(cast(null as int) as a, array(null, 1) as b)"))) == '{"b":[null,1]}'
    assert one(spark, rows.io_mode(F.lit(" STDIO "), F.lit(False))) == "stdio"
    with pytest.raises(PySparkException):
        one(spark, rows.io_mode(F.lit("file"), F.lit(False)))
    images = one(spark, rows.renamed_images("c"), c="array(named_struct('type', 'image', 'value', 'v'), named_struct('type', 'text', 'value', 't'))")
    assert [i.type for i in images] == ["image_pil", "text"]
    assert one(spark, rows.nested_prefixes("r"), r="array('a', 'ab', 'abc')") and not one(spark, rows.nested_prefixes("r"), r="array('a', 'xb')") and one(spark, rows.nested_prefixes("r"), r="array('a')")


def test_token_caps(spark):
    made = prepare.unpaired("p", "a", 6, 1, 2)
    assert one(spark, made["ids"], p="array(7, 8)", a="array(5, 6, 9, 9)") == [1, 7, 8, 5, 6, 2]
    assert one(spark, made["labels"], p="array(7, 8)", a="array(5, 6, 9, 9)") == [-100, -100, -100, 5, 6, 2]
    assert one(spark, made["ids"], p="array(1, 8)", a="array(5, 2)") == [1, 8, 5, 2]
    # the prompt alone is over the cap by one: the bound counts from the answer's end
    assert one(spark, made["ids"], p="array(1, 2, 3, 4, 5, 6, 7)", a="array(5, 6, 2)") == [1, 2, 3, 4, 5, 6, 7, 5, 6, 2]
    assert one(spark, made["ids"], p="cast(array() as array<int>)", a="cast(array() as array<int>)") == [1, 2]
    a, b = prepare.pair_answers(("3", "3"), ("a", "b"), 6)
    assert one(spark, a, a="array(1, 2, 3, 4)", b="array(1)") == [1, 2] and one(spark, b, a="array(1, 2, 3, 4)", b="array(1)") == [1]
    with pytest.raises(PySparkException):
        one(spark, prepare.shared_prompt("c", "c", "r"), c="array(1, 2, 3)", r="array(1, 9, 9)")


def test_history(spark):
    item = "named_struct('status', '{}', 'failed_input', {}, 'failed_actual', cast(null as string), 'error', '{}', 'compile_score', {})"
    rounds = [item.format("TIMEOUT", "'2'", "", "1D"), item.format("OK", "'1'", "", "1D"), item.format("TIMEOUT", "'1'", "", "0D"), item.format("WRONG", "'3'", " e ", "1D")]
    latest, earlier = samples.history_summary("h")
    assert one(spark, latest, h=f"array({', '.join(rounds)})") == "- latest_status=WRONG\n- failed_input=3\n- error_summary=e"
    assert one(spark, earlier, h=f"array({', '.join(rounds)})") == "- earlier_rounds=3\n- status_counts=OK:1, TIMEOUT:2\n- repeated_failure_input=1\n- some_earlier_attempts_failed_to_compile"
    assert one(spark, earlier, h=f"array({rounds[0]})") == ""
    assert one(spark, samples.history_start("n", "10", "50", 100, 40), n="array(30, 30, 20)") == 1
    assert one(spark, samples.history_start("n", "90", "50", 100, 40), n="array(30, 30, 20)") == 3
    assert one(spark, samples.history_start("n", "10", "50", 0, 40), n="array(30)") == 0


def test_weights(spark):
    # one place, two equal logits: probability 1/2, squared sum 1/2, so the weight is 1
    x = one(spark, losses.pair_weight("p", "z", "m"), p="array(ln(0.5D))", z="array(array(3D, 3D))", m="array(1D)")
    assert abs(x - 1.0) < 1e-12
    assert one(spark, losses.perception_terms("p", "q"), p="array(0D, 0D)", q="array(0D, 5D)") == [0.0, 0.2]


def test_traces_and_manifests(spark):
    nodes = spark.createDataFrame([("a", "TIMEOUT", 0.0, 1.0, True, 0.5, True), ("a", "OK", 1.0, 1.0, True, 0.9, False), ("b", None, None, None, None, None, None)], "q string, s string, p double, c double, f boolean, r double, t boolean")
    got = {r.q: tuple(r[c] for c in samples.SCORES) for r in samples.trace_scores(nodes, "q", "s", "p", "c", "f", "r", "t").collect()}
    assert got == {"a": (1.0, 0.0, 1.0, 0.5, 1.0, 1.0), "b": (0.0, 1.0, 0.0, 0.0, 1.0, 0.0)}
    scores = samples.trace_scores(nodes, "q", "s", "p", "c", "f", "r", "t")
    assert [r.q for r in samples.selected_traces(scores, "q", 1).collect()] == ["a"] and [r.q for r in samples.selected_traces(scores, "q", 5, ["b"]).collect()] == ["b"]
    assert one(spark, samples.same_manifest("a", "b"), a="map('x', 1, 'y', cast(null as int))", b="map('y', cast(null as int), 'x', 1)")
    assert not one(spark, samples.same_manifest("a", "b"), a="map('x', 1)", b="map('z', 1)")
