"""Python semantics that SQL has none of: running programs on test cases, comparing literal values, novelty, assert parsing.

Programs are not trusted. Running them is off unless asked for; each runs in a process of its own, without inherited
environment, with limits of CPU time, memory, files and processes, in an empty folder, and its process group is killed
after the time for all its cases.
"""

from __future__ import annotations

import ast
import json
import os
import resource
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUNNER = r"""
import contextlib, io, json, sys
task = json.load(sys.stdin)
out = []
def say(kind, value="", error=""):
    out.append([kind, value, error])
try:
    code = compile(task["code"], "<program>", "exec")
except SyntaxError as e:
    for _ in task["inputs"]:
        say("SYNTAX_ERROR", error=f"SyntaxError: {e}")
else:
    for given in task["inputs"]:
        try:
            caught, scope = io.StringIO(), {"__name__": "__main__"}
            if task["stdio"]:
                sys.stdin = io.StringIO(given)
                with contextlib.redirect_stdout(caught):
                    exec(code, scope)
                say("OK", caught.getvalue())
            else:
                import ast
                with contextlib.redirect_stdout(caught):
                    exec(code, scope)
                    f = scope.get("solve") or scope.get("main")
                    if f:
                        value = f(ast.literal_eval(given))
                    elif "output" in scope:
                        value = scope["output"]
                    else:
                        raise NameError("no solve, main or output")
                say("OK", repr(value))
        except SystemExit:
            say("OK", caught.getvalue())
        except BaseException as e:
            say("RUNTIME_ERROR", error=f"{type(e).__name__}: {e}")
sys.stdout.write("\x00" + json.dumps(out))
"""


def run_cases(code: str, inputs: list[str], stdio: bool = True, seconds: float = 2.0, megabytes: int = 512) -> list[tuple[str, str, str]]:
    """(kind, value, error) of each case. The time is for all cases together; past it every case is a TIMEOUT."""
    if not inputs:
        return []
    budget = seconds * len(inputs)

    def limits() -> None:
        resource.setrlimit(resource.RLIMIT_CPU, (int(budget) + 1, int(budget) + 1))
        resource.setrlimit(resource.RLIMIT_AS, (megabytes << 20, megabytes << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))
        resource.setrlimit(resource.RLIMIT_NOFILE, (32, 32))

    with tempfile.TemporaryDirectory() as empty:
        child = subprocess.Popen([sys.executable, "-I", "-S", "-c", _RUNNER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=empty, env={}, start_new_session=True, preexec_fn=limits)
        try:
            said, _ = child.communicate(json.dumps({"code": code, "inputs": inputs, "stdio": stdio}).encode(), timeout=budget)
        except subprocess.TimeoutExpired:
            return [("TIMEOUT", "", "")] * len(inputs)
        finally:
            try:
                os.killpg(child.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            child.wait()
    try:
        out = [tuple(x) for x in json.loads(said.rpartition(b"\x00")[2])]
    except ValueError:
        out = []
    return out + [("RUNTIME_ERROR", "", "no result")] * (len(inputs) - len(out))


def execute(df: DataFrame, code: str, inputs: str, allowed: bool = False, stdio: bool = True, seconds: float = 2.0) -> DataFrame:
    """Adds results: array of (kind, value, error) of running the program in column ``code`` on the array ``inputs``."""
    if not allowed:
        raise PermissionError("running programs is off; pass allowed=True where the workers may run them")
    kind = "array<struct<kind:string,value:string,error:string>>"
    schema = df.withColumn("results", F.expr(f"cast(null as {kind})")).schema
    source = df.withColumns({"_code": F.col(code), "_inputs": F.col(inputs)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("error", pa.string())]))
        for batch in batches:
            programs, given = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            found = [[dict(zip(("kind", "value", "error"), x, strict=True)) for x in run_cases(p or "", list(g or []), stdio, seconds)] for p, g in zip(programs, given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, told)], names=[f.name for f in schema.fields])

    return source.mapInArrow(each, schema)


def execute_programs(df: DataFrame, programs: str, inputs: str, name: str = "results", allowed: bool = False, stdio: bool = True, seconds: float = 2.0) -> DataFrame:
    """Adds, for each program of the array ``programs`` (SQL), the array of (kind, value, error) of running it on the array ``inputs`` (SQL).

    A row without programs starts no process. A null program is run as an empty one; null programs or inputs are none.
    """
    if not allowed:
        raise PermissionError("running programs is off; pass allowed=True where the workers may run them")
    kind = "array<array<struct<kind:string,value:string,error:string>>>"
    df = df.drop(name)
    schema = df.withColumn(name, F.expr(f"cast(null as {kind})")).schema
    source = df.withColumns({"_programs": F.expr(programs), "_inputs": F.expr(inputs)})
    told = pa.list_(pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("error", pa.string())])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes, given in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                runs = [run_cases(code or "", list(given or []), stdio, seconds) for code in codes or []]
                found.append([[dict(zip(("kind", "value", "error"), x, strict=True)) for x in run] for run in runs])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, told)], names=[f.name for f in schema.fields])

    return source.mapInArrow(each, schema)


def literal(text):
    """A Python literal, or the text itself."""
    if not isinstance(text, str):
        return text
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return text


def values_equal(a, b, tolerance: float = 1e-6) -> bool:
    """Equality by structure of literals: numbers (and truth values) within a tolerance, lists as tuples, white space in strings as one space."""
    a, b = literal(a), literal(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= tolerance
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(values_equal(x, y, tolerance) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(values_equal(a[k], b[k], tolerance) for k in a)
    if isinstance(a, str) and isinstance(b, str):
        return " ".join(a.split()) == " ".join(b.split())
    return type(a) is type(b) and a == b


def novelty(codes: list[str]) -> list[float]:
    """Of each program of a group, 1 less its mean similarity with the others; a lone one is new."""
    n = len(codes)
    if n < 2:
        return [1.0] * n
    ratio = [[SequenceMatcher(None, codes[i], codes[j]).ratio() if i != j else 0.0 for j in range(n)] for i in range(n)]
    return [1 - sum(row) / (n - 1) for row in ratio]


def parse_assert(statement: str) -> tuple[str, list, dict, object] | None:
    """(function, arguments, keyword arguments, expected) of ``assert f(..) == x`` either way round, ``assert f(..)`` and ``assert not f(..)``; else none."""
    try:
        node = ast.parse(statement.strip()).body[0]
        test, expected = node.test, True
        if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
            test, expected = test.operand, False
        elif isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], (ast.Eq, ast.Is)):
            call, value = test.left, test.comparators[0]
            if not isinstance(call, ast.Call):
                call, value = value, call
            test, expected = call, ast.literal_eval(value)
        if not isinstance(test, ast.Call) or not isinstance(test.func, ast.Name):
            return None
        return test.func.id, [ast.literal_eval(x) for x in test.args], {k.arg: ast.literal_eval(k.value) for k in test.keywords if k.arg}, expected
    except (SyntaxError, ValueError, IndexError, AttributeError):
        return None


def input_mode(calls: list[tuple[str, list, dict, object]]) -> str:
    """How cases hand over their arguments: args_kwargs, args_list, no_args or single_arg."""
    if any(kwargs for _, _, kwargs, _ in calls):
        return "args_kwargs"
    counts = {len(args) for _, args, _, _ in calls}
    return {frozenset({0}): "no_args", frozenset({1}): "single_arg"}.get(frozenset(counts), "args_list")


def has_entry(code: str) -> bool:
    """Whether a program defines solve at its top level."""
    try:
        return any(isinstance(n, ast.FunctionDef) and n.name == "solve" for n in ast.parse(code).body)
    except (SyntaxError, ValueError):
        return False


def aligned_groups(a: list[str], b: list[str]) -> list[tuple[list[int], list[int]]]:
    """Groups of neighbouring tokens of two tokenisations that spell the same text."""
    out, i, j = [], 0, 0
    left, right, x, y = [], [], "", ""
    while i < len(a) or j < len(b):
        if len(x) <= len(y) and i < len(a) or j >= len(b):
            x, left, i = x + a[i], [*left, i], i + 1
        else:
            y, right, j = y + b[j], [*right, j], j + 1
        if x == y and x:
            out.append((left, right))
            left, right, x, y = [], [], "", ""
    if left or right:
        out.append((left, right))
    return out
