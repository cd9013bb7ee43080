"""Raw records to problems, and what running programs tells."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import problems

ADD, MULTIPLY = "a, b = map(int, input().split())\nprint(a + b)\n", "a, b = map(int, input().split())\nprint(a * b)\n"


def record(spark, *rows):
    df = spark.createDataFrame([(i, source, r if isinstance(r, str) or r is None else json.dumps(r)) for i, (source, r) in enumerate(rows)], "i int, src string, record string")
    return problems.normalised_records(df, "src", "record", "i").orderBy("i").collect()


def io(inputs, outputs, **more):
    return {"inputs": inputs, "outputs": outputs, **more}


def pairs(row):
    return [(c.input, c.output) for c in row.test_cases]


def test_single_source_fields(spark):
    heavy = io([*[f"{k}\n" for k in range(1, 7)], "x" * 6001], [*[f"{k}\n" for k in range(1, 7)], "y\n"])
    good = {"problem_id": "apps_1", "question": "Add <b>two</b>\tintegers.\r\n\n\n\nEnd ", "input_output": json.dumps(io(["1 2\n", "10 5\n", "7 8\n"], ["3\n", "15\n", "15\n"], fn_name=None)), "solutions": json.dumps([ADD]), "difficulty": " easy ", "url": None}
    a, b = record(spark, (" Apps ", good), ("taco", {"id": 7, "question": "", "prompt": "Echo.", "input_output": heavy, "solutions": "", "reference_solution": "print(input())"}))
    assert (a.reject_reason, a.question_id, a.io_mode, a.difficulty, a.source_url, a.reference_solution) == (None, "apps_apps_1", "stdio", "easy", "", ADD)
    assert a.prompt == "Solve the following programming problem in Python.\nRead from standard input and write to standard output.\nDo not add explanations.\n\nProblem:\nAdd two integers.\n\nEnd"
    assert [d.input for d in a.diagnostics] == ["1 2\n", "7 8\n", "10 5\n"] and (a.source_test_count, a.selected_test_count, a.oversized_test_count) == (3, 3, 0)
    assert (b.reject_reason, b.question_id, b.reference_solution) == (None, "taco_7", "print(input())") and (b.source_test_count, b.selected_test_count, b.oversized_test_count) == (7, 6, 1)


def test_contest_fields(spark):
    lists = {"name": "cc_1", "description": "Multiply.", "public_tests": {"input": ["2 3\n"], "output": ["6\n"]}, "private_tests": json.dumps({"input": "5 5\n", "output": "25\n"}), "generated_tests": [{"input": 7, "output": True}, {"inputs": ["a", None], "outputs": ["b", 2]}], "solutions": {"language": [3, "python3", "cpp"], "solution": ["first", MULTIPLY, "x"]}}
    objects = {"name": "cc_2", "problem": "P", "tests": [{"input": "1", "output": "2"}], "solutions": [{"lang": "C++", "code": "x"}, {"language": " PyThon3 ", "text": "y"}, {"language": "3", "code": "z"}, "loose", {"language": 1, "solution": "one"}]}
    invalid = lists | {"generated_tests": [{"input": [1], "output": "2"}]}
    a, b, c = record(spark, ("codecontests", lists), ("codecontests", objects), ("codecontests", invalid))
    assert pairs(a) == [("2 3\n", "6\n"), ("5 5\n", "25\n"), ("7", "True"), ("a", "b"), ("", "2")] and a.reference_solution == "first" and a.reject_reason is None
    assert pairs(b) == [("1", "2")] and b.reference_solution == "y" and b.question_id == "codecontests_cc_2"
    assert c.reject_reason == "missing_tests" and pairs(c) == []


def test_reasons_and_their_order(spark):
    cases = io(["1"], ["2"])
    base = {"question": "Q", "input_output": cases, "solutions": ["s"]}
    rows = [
        ("apps", base, None), ("apps", base | {"input_output": "no json"}, "missing_input_output"), ("apps", {}, "missing_input_output"), ("apps", None, "missing_input_output"), ("apps", "{broken", "missing_input_output"),
        ("apps", base | {"input_output": cases | {"fn_name": "solve"}, "question": ""}, "non_stdio_task"), ("apps", base | {"input_output": cases | {"fn_name": ""}}, None),
        ("codeforces", base | {"input_output": io([], []), "question": None}, "missing_tests"), ("apps", base | {"input_output": io(["1", ["2"]], ["1", "2"])}, "missing_tests"), ("apps", base | {"question": " \n"}, "missing_prompt"),
        ("apps", base | {"solutions": [" "]}, "missing_python_reference_solution"), ("codecontests", {"tests": []}, "missing_prompt"), ("codecontests", {"prompt": "p"}, "missing_tests"),
        ("codecontests", {"prompt": "p", "tests": cases, "solutions": []}, "missing_python_reference_solution"), ("elsewhere", base, "unsupported_source"), (None, base, "unsupported_source"),
    ]
    assert [r.reject_reason for r in record(spark, *[x[:2] for x in rows])] == [x[2] for x in rows]
    assert [r.question_id for r in record(spark, ("apps", base | {"id": None}), ("taco", base))] == ["apps_None", "taco_taco_1"]


def test_cascade_before_running(spark):
    rows = [("w " * 2001, "s", 3), ("Please FLUSH", "s", 3), ("Read from file", "s", 0), ("p", "import os", 2), ("p", "x = 1\nfrom numpy import array", 3), ("p", "import numpyx", 3)]
    df = spark.createDataFrame(rows, "p string, s string, n int").withColumn("k", F.monotonically_increasing_id())
    got = df.orderBy("k").select(problems.corpus_reason(F.col("p"), F.col("s"), F.col("n"), F.size(F.split(F.trim("p"), " "))).alias("r")).collect()
    assert [r.r for r in got] == ["prompt_too_long", "interactive_task", "file_io_task", "too_few_tests", "disallowed_imports", None]


@pytest.fixture(scope="module")
def programs():
    zeros, three = [("1\n", "0\n"), ("2\n", "0\n"), ("3\n", "0\n")], [("1 2\n", "3\n"), ("3 4\n", "7\n"), ("5 6\n", "11")]
    return [
        ("good", ADD, three, None, 1.0, []), ("spaces", ADD + "print()", three, None, 1.0, []), ("wrong", MULTIPLY, three, "reference_solution_failed", 0.0, None),
        ("partly", ADD, [*three[:2], ("1 1", "3")], "reference_solution_failed", 2 / 3, None), ("raises", "1 / 0", three, "reference_solution_failed", 0.0, None), ("syntax", "(", three, "reference_solution_failed", 0.0, None),
        ("endless", "while True: pass", three[:1], "reference_solution_failed", 0.0, None), ("zero", "print(0)", zeros, "trivial_baseline_passed", 1.0, ["print_0"]),
        ("echo", "print(input())", [("a", "a"), ("1", "1")], "trivial_baseline_passed", 1.0, ["print_1", "echo_input"]), ("silent", "pass", [("x", " \n")], "trivial_baseline_passed", 1.0, ["empty_output", "placeholder"]),
        ("before", ADD, three, "too_few_tests", None, None), ("none", ADD, [], "reference_solution_failed", 0.0, None),
    ]


def test_execution_filters(spark, programs):
    rows = [(name, code, [{"input": i, "output": o} for i, o in cases], reason if name == "before" else None, "clash") for name, code, cases, reason, _, _ in programs]
    df = spark.createDataFrame(rows, "name string, reference_solution string, test_cases array<struct<input:string,output:string>>, reject_reason string, baseline_hits string").repartition(4)
    with pytest.raises(PermissionError):
        problems.execution_reasons(df)
    out = problems.execution_reasons(df, allowed=True, seconds=1.5).cache()
    got = {r.name: (r.reject_reason, r.reference_pass_rate, r.baseline_hits) for r in out.collect()}
    assert got == {name: (reason, pytest.approx(rate) if rate else rate, hits) for name, _, _, reason, rate, hits in programs}
    assert {r.baseline: r.problems for r in problems.baseline_tally(out).collect()} == {"print_0": 1, "print_1": 1, "echo_input": 1, "empty_output": 1, "placeholder": 1}
    rates = {r.name: r.baseline_rates for r in out.collect()}
    assert rates["echo"] == {"print_0": 0.0, "print_1": 0.5, "empty_output": 0.0, "echo_input": 1.0, "placeholder": 0.0} and rates["wrong"] is None
    out.unpersist()
    assert problems.execution_reasons(df.limit(0), allowed=True).count() == 0


def test_equal_and_near_problems(spark):
    case = lambda *x: [{"input": i, "output": "o"} for i in x]
    long = " ".join(f"w{k}" for k in range(90))
    rows = [
        (0, "Add <b>two</b> numbers!", case("1", "2", "3"), "apps"), (1, "add two numbers", case("1", "2", "3"), "codecontests"), (2, "Add two numbers", case(" 1", "2\n", "3", "4"), "taco"), (3, "Add two numbers", case("9"), "taco"),
        (4, long, case("1"), "apps"), (5, long + " more", case("1"), "apps"), (6, long, case("1"), "apps"), (7, "", [], None),
    ]
    df = spark.createDataFrame([(i, p, c, s, None) for i, p, c, s in rows], "i int, prompt string, test_cases array<struct<input:string,output:string>>, source string, io_mode string").repartition(3)
    got = problems.deduplicated(df, "i").collect()
    assert sorted((r.i, r.position) for r in got) == [(2, 0), (3, 3), (4, 4), (7, 7)] and set(got[0].asDict()) == {*df.columns, "position"}
