"""Adapters from datasets' own columns to those of the library: code examples, supervised examples, and adapters by name.

An adapter takes a DataFrame and gives one. Code examples come as JSON records with aliases and free types, taken as
VARIANT; their cases keep values of any type. A row that cannot be adapted has a ``problem``, or is an error where asked.

Results for odd input: a null or unreadable record has an empty prompt; fields that are null, empty, 0 or false count as
missing where an alias follows; a repeated row is adapted each time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import curate
from lodestone.operators.problems import _any_text, _blank, _given, _has, _is_text, _let, _list, _map, _member, _stripped

# Aliases of fields, and the modes of a program's input.
PROMPTS = ("prompt", "question", "instruction", "problem")
MODES = ("call", "stdio")
QUESTIONS = (*PROMPTS, "query")
COMPLETIONS = ("completion", "answer")
CODES = ("code", "solution", "program", "answer_code")

CASES = "array<struct<input:variant,output:variant>>"


def _first(m: str, *names: str) -> str:
    """The first value of the names that is not null, empty, 0 or false."""
    tries = [f"if({m}['{n}'] is null or is_variant_null({m}['{n}']), null, if({_given(m, n)} is null, null, {m}['{n}']))" for n in names]
    return f"coalesce({', '.join(tries)})"


def _cases(source: str, record: str) -> str:
    """The cases of a list of objects, else those of parallel lists of inputs and outputs; null where there are none or the lists differ in length."""
    pair = lambda a, b: f"named_struct('input', k__['{a}'], 'output', k__['{b}'])"
    one = f"case when {_has('k__', 'input')} and {_has('k__', 'output')} then {pair('input', 'output')} when {_has('k__', 'stdin')} and {_has('k__', 'stdout')} then {pair('stdin', 'stdout')} end"
    listed = f"filter(transform(filter(transform({_list(source)}, x__ -> {_map('x__')}), k__ -> k__ is not null), k__ -> {one}), c__ -> c__ is not null)"
    member = lambda name: _list(f"{record}['{name}']")
    zipped = f"if(size({member('input')}) = size({member('output')}), zip_with({member('input')}, {member('output')}, (a__, b__) -> named_struct('input', a__, 'output', b__)), null)"
    return f"cast({_let('l__', listed, f'if(coalesce(size(l__), 0) > 0, l__, {zipped})')} as {CASES})"


def code_examples(df: DataFrame, record: str, index: str, strict: bool = False) -> DataFrame:
    """Adds question_id, prompt, test_cases (values as VARIANT), io_mode and problem (null: adapted) of JSON records.

    ``index`` names a row without an id. ``strict``: a row with a problem is an error when it is read.
    """
    df = df.withColumn("_a", F.expr(_map(f"try_parse_json({record})")))
    df = df.withColumns({"_s": F.expr(_member("_a", "test_cases", "tests")), "_p": F.expr(_first("_a", *PROMPTS))})
    prompt = F.when(F.expr(f"{_is_text('_p')} and not {_blank('cast(_p as string)')}"), F.expr("cast(_p as string)"))
    explicit = F.expr(f"if(_a['io_mode'] is null or is_variant_null(_a['io_mode']), null, nullif(lower({_stripped(_any_text('''_a['io_mode']'''))}), ''))")
    streams = F.expr(f"coalesce(exists(transform({_list('_s')}, x__ -> {_map('x__')}), k__ -> {_has('k__', 'stdin')} and {_has('k__', 'stdout')}), false)")
    df = df.withColumns({
        "question_id": F.expr(f"coalesce({_given('_a', 'question_id', 'id')}, concat('q_', cast({index} as string)))"), "prompt": prompt, "test_cases": F.expr(_cases("_s", "_a")),
        "io_mode": F.coalesce(explicit, F.when(streams, "stdio").otherwise("call")),
    })
    problem = curate.first_reason([("empty_prompt", F.col("prompt").isNull()), ("no_test_cases", F.col("test_cases").isNull()), ("unsupported_io_mode", ~F.col("io_mode").isin(*MODES))])
    df = df.withColumn("problem", problem).drop("_a", "_s", "_p")
    if strict:
        said = F.raise_error(F.concat(F.lit("example "), F.col("question_id"), F.lit(": "), F.col("problem")))
        df = df.withColumn("question_id", F.when(F.col("problem").isNull(), F.col("question_id")).otherwise(said))
    return df


def _filled(df: DataFrame, names: Sequence[str]) -> Column:
    there = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def supervised_examples(df: DataFrame, instruction: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """prompt, completion and problem (null: adapted) from columns under their aliases; without a completion the code in a fence.

    ``instruction``: a text that goes before every prompt.
    """
    ink = lambda c: c.rlike(f"[^{t.SPACE[1:-1]}]")
    asked, told, code = _filled(df, QUESTIONS), _filled(df, COMPLETIONS), _filled(df, CODES)
    prompt = t.strip(asked) if instruction is None else F.concat(F.lit(f"{instruction.strip()}\n\nQuestion:\n"), t.strip(asked))
    completion = F.when(ink(told), t.strip(told)).when(ink(code), t.fenced(t.strip(code)))
    problem = curate.first_reason([("empty_prompt", ~F.coalesce(ink(asked), F.lit(False))), ("no_completion", completion.isNull())])
    return df.select(*keep, F.when(problem.isNull(), prompt).alias("prompt"), F.when(problem.isNull(), completion).alias("completion"), problem.alias("problem"))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {"default": code_examples, "supervised": supervised_examples}


def adapter(name: str) -> Callable[..., DataFrame]:
    """An adapter by its name, or by a path such as ``package.module:function`` or ``package.module.function``."""
    if name in ADAPTERS:
        return ADAPTERS[name]
    module, mark, function = name.partition(":") if ":" in name else name.rpartition(".")
    if not mark:
        raise ValueError(f"{name!r} is no adapter; give one of {sorted(ADAPTERS)} or the path of a function")
    found = getattr(import_module(module), function)
    if not callable(found):
        raise TypeError(f"{name} cannot be called")
    return found
