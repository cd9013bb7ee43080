import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import adapters

CASES = [{"input": [1, 2], "output": {"a": None}}]


def adapted(spark, *records, **more):
    df = spark.createDataFrame([(k, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(records)], "i int, record string")
    out = adapters.code_examples(df, "record", "i", **more)
    return out.orderBy("i").select("question_id", "prompt", F.to_json("test_cases").alias("cases"), "io_mode", "problem").collect()


def test_code_examples(spark):
    got = adapted(
        spark,
        {"question_id": "", "id": 7, "prompt": "", "question": "Q?", "test_cases": CASES}, {"problem": "P", "tests": [{"stdin": "1", "stdout": "2"}, 5, {"input": 1}]}, {"prompt": "p", "input": [1, "x"], "output": [True, [2]], "io_mode": " STDIO "},
        {"prompt": " ", "tests": CASES}, {"prompt": 5, "question": "q", "tests": CASES}, {"prompt": "p", "input": [1], "output": [1, 2]}, {"prompt": "p", "tests": CASES, "io_mode": "socket"}, {"prompt": "p", "tests": [], "input": "1"}, "{broken", None,
        {"prompt": "p", "test_cases": None, "tests": CASES, "input": [], "output": []}, {"prompt": "p", "tests": [{"input": 1, "output": 2, "stdin": "s", "stdout": "t"}], "io_mode": None},
    )
    assert [r.problem for r in got] == [None, None, None, "empty_prompt", "empty_prompt", "no_test_cases", "unsupported_io_mode", "no_test_cases", "empty_prompt", "empty_prompt", None, None]
    assert [(r.question_id, r.prompt, r.io_mode) for r in got[:3]] == [("7", "Q?", "call"), ("q_1", "P", "stdio"), ("q_2", "p", "stdio")]
    assert [json.loads(r.cases) for r in got[:3]] == [CASES, [{"input": "1", "output": "2"}], [{"input": 1, "output": True}, {"input": "x", "output": [2]}]]
    assert json.loads(got[10].cases) == [] and json.loads(got[11].cases) == [{"input": 1, "output": 2}] and got[11].io_mode == "stdio"
    with pytest.raises(Exception, match="example q_1: empty_prompt"):
        adapted(spark, {"prompt": "p", "tests": CASES}, {"tests": CASES}, strict=True)
    assert adapted(spark, {"prompt": "p", "tests": CASES}, strict=True)[0].question_id == "q_0"


def test_supervised_examples(spark):
    rows = [(" p ", None, " done ", None), (None, "q", "", "x = 1"), ("", "", "c", "d"), ("p", None, None, " "), ("p", "q", " ", "y")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, prompt string, query string, answer string, program string")
    got = adapters.supervised_examples(df, keep=["i"]).orderBy("i").collect()
    assert [(r.prompt, r.completion, r.problem) for r in got] == [("p", "done", None), ("q", "```python\nx = 1\n```", None), (None, None, "empty_prompt"), (None, None, "no_completion"), ("p", "```python\ny\n```", None)]
    assert adapters.supervised_examples(df, " Do. ").where("prompt is not null").first().prompt == "Do.\n\nQuestion:\np"
    assert adapters.supervised_examples(df.select("i")).where("problem = 'empty_prompt'").count() == 5


def test_by_name():
    assert adapters.adapter("default") is adapters.code_examples
    assert adapters.adapter("lodestone.operators.curate:pending") is adapters.adapter("lodestone.operators.curate.pending")
    for name, error in (("nothing", ValueError), ("lodestone.operators.curate:PACKAGES", TypeError), ("no.such.module:x", ImportError)):
        with pytest.raises(error):
            adapters.adapter(name)
