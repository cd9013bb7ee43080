"""Raw code problems in a common form: test cases, Python solutions, reasons to reject, and what running them tells.

Records come as JSON whose fields have no fixed type: a text may hold JSON, a list may be of texts or of objects, a key
has aliases. They are taken as VARIANT values and told apart by built-in functions, so no record goes through Python.

Results for odd input: a null or unreadable record lacks everything, so it is rejected with the first reason; a null
value of a case is the empty text; a truth value is written True or False; numbers are written as SQL writes them (1.0 as
1); a case with a list or an object where a text belongs makes its mapping invalid; a null source is not supported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import curate, execute

# Sources, the prompt's head, programs that solve nothing, names and numbers of the language.
SOURCES = ("apps", "taco", "codeforces")
CONTESTS = "codecontests"
PREFIX = "Solve the following programming problem in Python.\nRead from standard input and write to standard output.\nDo not add explanations.\n\nProblem:\n"
BASELINES = {
    "print_0": "print(0)",
    "print_1": "print(1)",
    "empty_output": "pass",
    "echo_input": "import sys\nprint(sys.stdin.read(), end='')",
    "placeholder": "def solve(x):\n    return None\n",
}
PYTHON_NAMES = ("py", "python", "python3", "cpython")
PYTHON_NUMBERS = (1, 3)
CASES = "array<struct<input:string,output:string>>"


def paired_cases(inputs: str, outputs: str) -> Column:
    """Cases of two arrays of strings, as long as the shorter one; a null is an empty string, a null array has no cases."""
    n = f"least(size({inputs}), size({outputs}))"
    made = f"zip_with(slice({inputs}, 1, greatest({n}, 0)), slice({outputs}, 1, greatest({n}, 0)), (i__, o__) -> named_struct('input', coalesce(i__, ''), 'output', coalesce(o__, '')))"
    return F.expr(f"coalesce({made}, cast(array() as {CASES}))")


def expected_output(cases: str, given: str) -> Column:
    """The output of the first case with that input; null for none."""
    return F.expr(f"try_element_at(filter({cases}, c__ -> c__.input = {given}), 1).output")


def is_python(language: Column) -> Column:
    """Whether a language's name is one of Python's; a number as text is none."""
    return F.lower(t.strip(language)).isin(*PYTHON_NAMES)


def python_solutions(solutions: str, languages: str | None = None) -> Column:
    """The solutions with content, of Python where their languages (names) are told."""
    full = "s__ is not null and length(trim(s__)) > 0"
    if languages is None:
        return F.expr(f"filter({solutions}, s__ -> {full})")
    names = ", ".join(f"'{n}'" for n in PYTHON_NAMES)
    n = f"least(size({solutions}), size({languages}))"
    return F.expr(f"filter(transform(filter(zip_with(slice({solutions}, 1, {n}), slice({languages}, 1, {n}), (s__, l__) -> named_struct('s', s__, 'l', l__)), x__ -> lower(trim(x__.l)) in ({names})), x__ -> x__.s), s__ -> {full})")


def normalised(df: DataFrame, prompt: str, cases: str, solutions: str, function_name: str | None = None, most: int = 10, letters: int = 5000, diagnostic: int = 4) -> DataFrame:
    """Adds reject_reason (null: a usable problem), reference_solution, and prepares the cases (see ``curate.prepared_cases``).

    Reasons, the first that holds: non_stdio_task, missing_tests, missing_prompt, missing_python_reference_solution.
    """
    rules = [("missing_tests", F.coalesce(F.size(cases), F.lit(0)) <= 0), ("missing_prompt", F.coalesce(t.strip(F.col(prompt)), F.lit("")) == ""), ("missing_python_reference_solution", F.coalesce(F.size(solutions), F.lit(0)) <= 0)]
    if function_name:
        rules.insert(0, ("non_stdio_task", F.coalesce(F.col(function_name), F.lit("")) != ""))
    out = df.withColumn("reject_reason", curate.first_reason(rules)).withColumn("reference_solution", F.try_element_at(F.col(solutions), F.lit(1)))
    return curate.prepared_cases(out, cases, most, letters, diagnostic)


_NONE = f"cast(array() as {CASES})"
_INK = f"[^{t.SPACE[1:-1]}]"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is found once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _map(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def _list(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _is_text(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) = 'STRING', false)"


def _blank(s: str) -> str:
    return f"not coalesce({s} rlike r'{_INK}', false)"


def _stripped(s: str) -> str:
    return f"btrim({s}, '{t.SPACES}')"


def _has(m: str, name: str) -> str:
    return f"coalesce(map_contains_key({m}, '{name}'), false)"


def _member(m: str, *names: str) -> str:
    """The value of the first of the names that a map has, be it null."""
    out = "cast(null as variant)"
    for name in reversed(names):
        out = f"if({_has(m, name)}, {m}['{name}'], {out})"
    return out


def _parsed(v: str) -> str:
    """What a text holds as JSON; other values, and texts that hold none, as they are."""
    text = _stripped(f"cast({v} as string)")
    return f"if({_is_text(v)}, coalesce(try_parse_json(nullif({text}, '')), {v}), {v})"


def _text(v: str) -> str:
    """A value as text: a null is empty; null for lists and objects."""
    kind = f"schema_of_variant({v})"
    truth = f"if(cast({v} as boolean), 'True', 'False')"
    return f"case when {v} is null or is_variant_null({v}) then '' when {kind} = 'BOOLEAN' then {truth} when {kind} like 'ARRAY%' or {kind} like 'OBJECT%' then null else cast({v} as string) end"


def _any_text(v: str) -> str:
    """A value as text, lists and objects as JSON."""
    return f"coalesce({_text(v)}, cast({v} as string))"


def _given(m: str, *names: str) -> str:
    """The first value that is not null, empty, 0 or false, as text; null for none."""
    tries = []
    for name in names:
        v = f"{m}['{name}']"
        other = f"if({_any_text(v)} in ('', 'False', '0', '[]', '{{}}'), null, {_any_text(v)})"
        tries.append(f"if({_is_text(v)}, nullif(cast({v} as string), ''), {other})")
    return f"coalesce({', '.join(tries)})"


def _mapping_cases(m: str) -> str:
    """Cases of a mapping of inputs and outputs; none if either is no list or text, or a value is no scalar."""

    def texts(*names: str) -> str:
        listed = f"if({_is_text('v__')}, array(v__), {_list('v__')})"
        return _let("v__", _member("m__", *names), f"transform({listed}, x__ -> {_text('x__')})")

    both = f"named_struct('i', {texts('inputs', 'input', 'stdin')}, 'o', {texts('outputs', 'output', 'stdout')})"
    n = "least(size(p__.i), size(p__.o))"
    zipped = f"zip_with(slice(p__.i, 1, {n}), slice(p__.o, 1, {n}), (a__, b__) -> named_struct('input', a__, 'output', b__))"
    checked = _let("z__", zipped, f"if(exists(z__, c__ -> c__.input is null or c__.output is null), {_NONE}, z__)")
    return _let("m__", m, _let("p__", both, f"if(p__.i is null or p__.o is null, {_NONE}, {checked})"))


def _listed_cases(v: str) -> str:
    """Cases of a mapping or of a list of mappings and single cases; null if one of a list is invalid."""
    pair = f"named_struct('input', {_text('''k__['input']''')}, 'output', {_text('''k__['output']''')})"
    single = _let("s__", pair, "if(s__.input is null or s__.output is null, null, array(s__))")
    several = _let("w__", _mapping_cases("k__"), "if(size(w__) = 0, null, w__)")
    item = _let("k__", _map("y__"), f"if({_has('k__', 'input')} and {_has('k__', 'output')}, {single}, {several})")
    parts = f"transform(filter({_list('q__')}, y__ -> {_map('y__')} is not null), y__ -> {item})"
    whole = _let("r__", parts, "if(exists(r__, e__ -> e__ is null), null, flatten(r__))")
    return _let("q__", _parsed(v), f"case when {_list('q__')} is not null then {whole} when {_map('q__')} is not null then {_mapping_cases(_map('q__'))} else {_NONE} end")


def record_cases(record: str) -> Column:
    """The cases of a contest record, in order of their kinds; none at all if one kind has an invalid item."""
    kinds = ", ".join(_listed_cases(f"{record}['{k}']") for k in ("public_tests", "private_tests", "generated_tests", "tests"))
    return F.expr(_let("g__", f"array({kinds})", f"if(exists(g__, e__ -> e__ is null), {_NONE}, flatten(g__))"))


def record_solutions(record: str, name: str) -> Column:
    """Python solutions with content under a key: a text, a list of texts, a list of objects, or lists of languages and solutions."""

    def python(v: str) -> str:
        text = f"cast({v} as string)"
        names = ", ".join(f"'{n}'" for n in PYTHON_NAMES)
        return f"({_is_text(v)} and lower({_stripped(text)}) in ({names}) or schema_of_variant({v}) = 'BIGINT' and try_cast({text} as bigint) in {PYTHON_NUMBERS})"

    def full(v: str) -> str:
        return f"({_is_text(v)} and not {_blank(f'cast({v} as string)')})"

    def picked(pairs: str) -> str:
        return f"transform(filter({pairs}, x__ -> coalesce({python('x__.l')}, false) and {full('x__.s')}), x__ -> cast(x__.s as string))"

    strings = f"transform(filter(l__, x__ -> {full('x__')}), x__ -> cast(x__ as string))"
    maps = f"filter(transform(l__, x__ -> {_map('x__')}), k__ -> k__ is not null)"
    objects = picked(f"transform({maps}, k__ -> named_struct('l', {_member('k__', 'language', 'lang')}, 's', {_member('k__', 'solution', 'code', 'text')}))")
    listed = f"if(forall(l__, x__ -> {_is_text('x__')}), {strings}, {objects})"
    languages = _let("v__", _member("k__", "language", "languages", "lang"), _list("v__"))
    solutions = _let("v__", _member("k__", "solution", "solutions", "code"), _list("v__"))
    n = "least(size(d__.l), size(d__.s))"
    zipped = f"zip_with(slice(d__.l, 1, {n}), slice(d__.s, 1, {n}), (a__, b__) -> named_struct('l', a__, 's', b__))"
    none = "cast(array() as array<string>)"
    mapped = _let("k__", _map("q__"), _let("d__", f"named_struct('l', {languages}, 's', {solutions})", f"if(d__.l is null or d__.s is null, {none}, {picked(zipped)})"))
    one = f"if({_blank('cast(q__ as string)')}, {none}, array(cast(q__ as string)))"
    body = f"case when {_is_text('q__')} then {one} when {_list('q__')} is not null then {_let('l__', _list('q__'), listed)} when {_map('q__')} is not null then {mapped} else {none} end"
    return F.expr(_let("q__", _parsed(f"{record}['{name}']"), body))


def normalised_records(df: DataFrame, source: str, record: str, index: str, most: int = 10, letters: int = 5000, letters_out: int = 5000, diagnostic: int = 4) -> DataFrame:
    """Problems of raw JSON records (column ``record``, a text) from known sources, each with its own fields and order of reasons.

    Adds reject_reason (null: usable), question_id, prompt, test_cases, diagnostics, reference_solution, io_mode,
    source_problem_id, difficulty, source_url, source_prompt and the counts of cases; ``index`` names a record without an id.
    """
    member = lambda name: f"_p_r['{name}']"

    def named(*names: str) -> Column:
        written = [f"if({_has('_p_r', n)}, if({member(n)} is null or is_variant_null({member(n)}), 'None', {_any_text(member(n))}), null)" for n in names]
        return F.expr(f"coalesce({', '.join(written)}, concat(_p_s, '_', cast({index} as string)))")

    df = df.withColumns({"_p_s": F.expr(f"lower({_stripped(source)})"), "_p_r": F.expr(_map(f"try_parse_json({record})"))})
    df = df.withColumn("_p_io", F.expr(_let("q__", _parsed(member("input_output")), _map("q__"))))
    contest = F.col("_p_s") == CONTESTS
    prompt = F.when(contest, F.expr(_given("_p_r", "description", "prompt", "problem"))).otherwise(F.expr(_given("_p_r", "question", "prompt", "problem")))
    cases = F.when(contest, record_cases("_p_r")).otherwise(F.expr(f"coalesce({_mapping_cases('_p_io')}, {_NONE})"))
    df = df.withColumns({
        "source_prompt": F.coalesce(t.strip(prompt), F.lit("")), "test_cases": cases,
        "_p_a": record_solutions("_p_r", "solutions"), "_p_b": record_solutions("_p_r", "reference_solution"),
    })
    df = df.withColumn("_p_sol", F.when(F.size("_p_a") > 0, F.col("_p_a")).otherwise(F.col("_p_b")))
    no_prompt, no_tests = ("missing_prompt", F.col("source_prompt") == ""), ("missing_tests", F.size("test_cases") <= 0)
    no_solution = ("missing_python_reference_solution", F.size("_p_sol") <= 0)
    called = F.expr(f"coalesce({_given('_p_io', 'fn_name')}, '') <> ''")
    single = curate.first_reason([("missing_input_output", F.col("_p_io").isNull()), ("non_stdio_task", called), no_tests, no_prompt, no_solution])
    reason = F.when(contest, curate.first_reason([no_prompt, no_tests, no_solution])).when(F.col("_p_s").isin(*SOURCES), single).otherwise("unsupported_source")
    ident = F.when(contest, named("name", "problem_id", "id")).otherwise(named("problem_id", "id"))
    df = df.withColumns({
        "reject_reason": reason, "source_problem_id": ident, "question_id": F.concat("_p_s", F.lit("_"), ident),
        "prompt": F.concat(F.lit(PREFIX), t.cleaned(F.col("source_prompt"))), "reference_solution": F.try_element_at("_p_sol", F.lit(1)), "io_mode": F.lit("stdio"),
        "difficulty": F.expr(_stripped(_any_text(member("difficulty")))), "source_url": F.expr(_stripped(_any_text(member("url")))),
    })
    return curate.prepared_cases(df, "test_cases", most, letters, diagnostic, letters_out).drop("_p_s", "_p_r", "_p_io", "_p_a", "_p_b", "_p_sol")


def corpus_reason(prompt: Column, solution: Column, n_tests: Column, tokens: Column, most_tokens: int = 2000, least_tests: int = 3) -> Column:
    """Why a normalised problem does not go into a corpus, the first reason that can be told without running it; null where there is none."""
    return curate.first_reason([
        ("prompt_too_long", tokens > most_tokens), ("interactive_task", curate.mentions(prompt, curate.INTERACTIVE)), ("file_io_task", curate.mentions(prompt, curate.FILE_IO)),
        ("too_few_tests", n_tests < least_tests), ("disallowed_imports", curate.imports_packages(solution)),
    ])


def _rates(results: str, cases: str) -> str:
    """For each program the share of cases that it passes: it ended well and wrote the output, white space at the ends aside."""
    right = f"x__.kind = 'OK' and {_stripped('x__.value')} = {_stripped('c__.output')}"
    passed = f"zip_with(r__, {cases}, (x__, c__) -> int({right}))"
    return f"transform({results}, r__ -> coalesce(aggregate({passed}, 0, (a__, b__) -> a__ + coalesce(b__, 0)) / nullif(size({cases}), 0), 0D))"


def execution_reasons(df: DataFrame, solution: str = "reference_solution", cases: str = "test_cases", reason: str = "reject_reason", allowed: bool = False, seconds: float = 2.0, baselines: dict[str, str] | None = None) -> DataFrame:
    """Rejects by running programs: reference_solution_failed where the solution does not pass all cases, then trivial_baseline_passed where a baseline passes any.

    Adds reference_pass_rate, baseline_rates (a map) and baseline_hits, null where nothing was run; a row that already
    has a reason is not run. Rows are worked off one by one where they lie, so nothing is shuffled and no program runs
    twice in a plan; deal them out first (``repartition``) where they lie unevenly. Programs run in sandboxed processes.
    """
    bank = BASELINES if baselines is None else baselines
    names = "array(" + ", ".join(f"'{n}'" for n in bank) + ")"
    given = f"transform({cases}, c__ -> c__.input)"
    df = execute.execute_programs(df, f"if({reason} is null, array({solution}), array())", given, "_x_own", allowed, seconds=seconds)
    df = df.withColumn("reference_pass_rate", F.expr(f"try_element_at({_rates('_x_own', cases)}, 1)")).drop("_x_own")
    df = df.withColumn("_x_bank", F.when(F.col("reference_pass_rate") >= 1, F.array(*[F.lit(code) for code in bank.values()])))
    df = execute.execute_programs(df, "_x_bank", given, "_x_base", allowed, seconds=seconds)
    df = df.withColumn("baseline_rates", F.expr(f"if(size(_x_base) > 0, map_from_arrays({names}, {_rates('_x_base', cases)}), null)")).drop("_x_base", "_x_bank")
    df = df.withColumn("baseline_hits", F.expr(f"if(baseline_rates is null, null, filter({names}, n__ -> baseline_rates[n__] > 0))"))
    ran = curate.first_reason([("reference_solution_failed", F.col("reference_pass_rate") < 1), ("trivial_baseline_passed", F.size("baseline_hits") > 0)])
    return df.withColumn(reason, F.coalesce(F.col(reason), ran))


def baseline_tally(df: DataFrame, hits: str = "baseline_hits") -> DataFrame:
    """How many problems each baseline passed at least one case of."""
    return df.select(F.explode(hits).alias("baseline")).groupBy("baseline").agg(F.count(F.lit(1)).alias("problems"))


def candidate_score(prompt: str = "prompt", cases: str = "test_cases", source: str = "source") -> Column:
    """What makes one of several equal problems the better one: more cases, then a shorter prompt, then the contest source."""
    return F.struct(F.size(cases).alias("cases"), (-t.token_count(F.col(prompt))).alias("shorter"), F.coalesce(F.col(source) == CONTESTS, F.lit(False)).alias("contest"))


def exact_key(prompt: str = "prompt", cases: str = "test_cases", mode: str = "io_mode") -> Column:
    """The signature of the prompt, all cases and the mode of input."""
    return F.md5(F.concat_ws("\x1f", t.signature(F.col(prompt)), F.to_json(cases), F.coalesce(F.col(mode), F.lit("stdio"))))


def near_key(prompt: str = "prompt", cases: str = "test_cases", words: int = 80, pairs: int = 3) -> Column:
    """The first words of the prompt's signature and the first cases without white space at their ends."""
    bare = F.transform(F.slice(cases, 1, pairs), lambda c: F.struct(t.strip(c["input"]).alias("input"), t.strip(c["output"]).alias("output")))
    return F.md5(F.concat_ws("\x1f", t.first_words(t.signature(F.col(prompt)), words), F.to_json(bare)))


def deduplicated(df: DataFrame, order: str, prompt: str = "prompt", cases: str = "test_cases", source: str = "source", mode: str = "io_mode") -> DataFrame:
    """Of equal problems, then of near ones, the best stays and takes the earliest place, ``position``; of equally good ones the first by ``order``."""
    curate._checkpoint_dir(df)
    # scores and keys are found once and stored; the rows themselves meet the last winners once
    scored = df.select(order, candidate_score(prompt, cases, source).alias("_score"), exact_key(prompt, cases, mode).alias("_exact"), near_key(prompt, cases).alias("_near")).checkpoint()
    first = curate.dedupe(scored, ["_exact"], "_score", order).withColumnRenamed("position", "_place")
    kept = curate.dedupe(first, ["_near"], "_score", "_place").select(F.col(order).alias("_kept"), "position")
    return df.join(kept, df[order] == F.col("_kept")).drop("_kept")
