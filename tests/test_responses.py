import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import responses

CALL = '<tool_call>\n{"name": "multiply", "arguments": {"a": 3, "b": 4}}\n</tool_call>'
MULTIPLY = {"type": "function", "function": {"name": "multiply", "arguments": {"a": 3, "b": 4}}}
BROKEN = '<tool_call>\n{"name": "multiply", "arguments": {"a": 3, "b": 4}\n</tool_call>'


@pytest.mark.parametrize(("text", "want"), [
    ("12<|im_end|>\n", ("12", None, None)), ("12", ("12", None, None)), ("", ("", None, None)), ("<think>\n\n</think>\n\n12<|im_end|>", ("12", None, None)),
    ("<think>\nHmmm.\n</think>\n\n12<|im_end|>\n", ("12", "Hmmm.", None)), (CALL + "<|im_end|>\n", ("", None, [MULTIPLY])), ("Let's call the tool.\n" + CALL + "<|im_end|>", ("Let's call the tool.", None, [MULTIPLY])),
    (CALL + "\n" + CALL.replace("multiply", "addition") + "<|im_end|>", ("", None, [MULTIPLY, {"type": "function", "function": {"name": "addition", "arguments": {"a": 3, "b": 4}}}])),
    (CALL.replace('{"a": 3, "b": 4}', '{"deep": [{"x": null}, 1.5, "s"]}'), ("", None, [{"type": "function", "function": {"name": "multiply", "arguments": {"deep": [{"x": None}, 1.5, "s"]}}}])),
    (BROKEN + "<|im_end|>", (BROKEN, None, "failed")), (CALL.replace('"name": "multiply", ', "") + "<|im_end|>", (CALL.replace('"name": "multiply", ', ""), None, "failed")),
    (CALL.replace('{"a": 3, "b": 4}', "null"), (CALL.replace('{"a": 3, "b": 4}', "null"), None, "failed")), (CALL.replace('"multiply"', "5"), (CALL.replace('"multiply"', "5"), None, "failed")),
    ("<tool_call>[1]</tool_call>", ("<tool_call>[1]</tool_call>", None, "failed")), ("a <tool_call> b<|im_end|>", ("a <tool_call> b", None, None)), ("<think>a</think>" + BROKEN, ("<think>a</think>" + BROKEN, None, "failed")),
])
def test_parsed(spark, text, want):
    row = responses.parsed(spark.createDataFrame([(text, "clash")], "t string, parsed string"), "t").select("t", "parsed.role", "parsed.content", "parsed.reasoning_content", F.to_json("parsed.tool_calls").alias("calls"), "parsed.failed").first()
    calls = None if row.calls is None else json.loads(row.calls)
    assert (row.role, row.content, row.reasoning_content, "failed" if row.failed else calls) == ("assistant", *want)


def test_valid_calls(spark):
    rows = [('[{"type": "function", "function": {"name": "f", "arguments": {}}}]', True), ('[{"type": "function"}]', False), ('[{"function": 5}]', False), ('[{"function": {"name": "f"}}]', False), ('[{"name": "f", "arguments": "x"}]', True), ("[]", True), ("[5]", False), (None, True)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").withColumn("c", F.expr("try_variant_get(try_parse_json(t), '$', 'array<variant>')"))
    assert [r.v for r in df.orderBy("k").select(responses.valid_calls("c").alias("v")).collect()] == [w for _, w in rows]
    assert responses.parsed(spark.createDataFrame([(None,)], "t string"), "t").first().parsed is None
