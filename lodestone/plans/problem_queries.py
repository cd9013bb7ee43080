"""Raw problem records and execution filters over the driver's tables.

Documents become JSON records of several sources and shapes; benchmark items become problems whose cases are their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import problems
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def records(s: SparkSession, d: str) -> DataFrame:
    """Each document as a record of one of five sources: its lines are inputs, reversed they are outputs; some fields are missing, some are JSON texts."""
    docs = read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"i": F.split("text", "\n"), "src": F.expr("array('apps', 'TACO ', 'codeforces', 'codecontests', 'other')[doc_id % 5]")})
    docs = docs.withColumns({"o": F.transform("i", F.reverse), "q": F.expr("if(doc_id % 7 = 0, null, text)"), "f": F.expr("if(doc_id % 11 = 0, 'solve', '')"), "s": F.expr("if(doc_id % 13 = 0, ' ', text)")})
    texts = F.to_json(F.struct(F.col("doc_id").alias("problem_id"), F.col("q").alias("question"), F.to_json(F.struct(F.col("i").alias("inputs"), F.col("o").alias("outputs"), F.col("f").alias("fn_name"))).alias("input_output"), F.to_json(F.array(F.lit(" "), "s")).alias("solutions")))
    nested = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("q").alias("problem"), F.struct(F.col("i").alias("stdin"), F.col("o").alias("stdout"), F.col("f").alias("fn_name")).alias("input_output"), F.array(F.struct(F.lit("C++").alias("lang"), F.lit("x").alias("code")), F.struct(F.lit("PYTHON3 ").alias("lang"), F.col("s").alias("code"))).alias("solutions")))
    again = F.expr("transform(slice(i, 1, 2), x -> named_struct('input', x, 'output', reverse(x)))")
    contest = F.to_json(F.struct(F.concat(F.lit("c"), "doc_id").alias("name"), F.col("q").alias("description"), F.struct(F.col("i").alias("input"), F.col("o").alias("output")).alias("public_tests"), F.to_json(again).alias("private_tests"), F.struct(F.array(F.lit(2), F.lit(3)).alias("language"), F.array(F.lit("x"), "s").alias("solution")).alias("reference_solution")))
    return docs.select("doc_id", "src", F.when(F.col("doc_id") % 5 == 3, contest).when(F.col("doc_id") % 2 == 0, texts).otherwise(nested).alias("record"))


_add(
    "problem_records",
    lambda s, d: problems.normalised_records(records(s, d), "src", "record", "doc_id", 5, 300, 200, 2).select("doc_id", "reject_reason", "question_id", F.md5("reference_solution").alias("solution"), "source_test_count", "oversized_test_count", "selected_test_count"),
    """with t as (select doc_id, coalesce(text, '') as text, doc_id % 5 as k from documents),
    l as (select doc_id, unnest(string_split(text, chr(10))) as x from t),
    n as (select doc_id, count(distinct x) as n, count(distinct x) filter (where length(x) <= 200) as fit from l group by 1)
    select doc_id, case when k = 4 then 'unsupported_source' when k < 3 and doc_id % 11 = 0 then 'non_stdio_task' when doc_id % 7 = 0 or not regexp_matches(text, '[^\\s\\x0b]') then 'missing_prompt' when doc_id % 13 = 0 then 'missing_python_reference_solution' end as reject_reason,
    (['apps', 'taco', 'codeforces', 'codecontests', 'other'])[k + 1] || '_' || case when k = 3 then 'c' else '' end || doc_id as question_id,
    case when doc_id % 13 > 0 and regexp_matches(text, '[^\\s\\x0b]') then md5(text) end as solution,
    case when k = 3 or k < 5 then n end as source_test_count, n - fit as oversized_test_count, least(fit, 5) as selected_test_count from t join n using (doc_id)""",
)


def word_problems(s: SparkSession, d: str) -> DataFrame:
    """Benchmark items as problems of four kinds: upper case; upper case with a solution that changes the first letter only; echo; length of the word."""
    items = read(s, d, "benchmark").select("item_id", "text", F.expr("array_distinct(regexp_extract_all(text, '([A-Za-z]+)', 1))").alias("w"), (F.col("item_id") % 4).alias("k"))
    wanted = F.transform("w", lambda x: F.struct(F.concat(x, F.lit("\n")).alias("input"), F.when(F.col("k") <= 1, F.upper(x)).when(F.col("k") == 2, x).otherwise(F.length(x).cast("string")).alias("output")))
    programs = F.array(F.lit("print(input().upper())"), F.lit("w = input()\nprint(w[0].upper() + w[1:])"), F.lit("print(input())"), F.lit("print(len(input()), '\\n')"))
    told = problems.corpus_reason(F.col("text"), F.lit(""), F.size("w"), F.size(F.split("text", " ")), 2000, 20)
    return items.select("item_id", wanted.alias("test_cases"), F.get(programs, F.col("k").cast("int")).alias("reference_solution"), told.alias("reject_reason"))


def executed(s: SparkSession, d: str) -> DataFrame:
    return problems.execution_reasons(word_problems(s, d).repartition("item_id"), allowed=True, seconds=5.0)


_WORDS = """w as (select distinct item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from benchmark),
    c as (select item_id, w, case when item_id % 4 <= 1 then upper(w) when item_id % 4 = 2 then w else length(w)::varchar end as o, case item_id % 4 when 0 then upper(w) when 1 then upper(w[1]) || w[2:] when 2 then w else length(w)::varchar end as own from w),
    p as (select item_id, count(*) as n, avg((o = own)::int) as rate, avg((o = '0')::int) as zero, avg((o = '1')::int) as one, avg((o = w)::int) as echo from c group by 1),
    e as (select item_id, case when n >= 20 then rate end as rate, case when n >= 20 and rate >= 1 then list_filter([case when zero > 0 then 'print_0' end, case when one > 0 then 'print_1' end, case when echo > 0 then 'echo_input' end], lambda x: x is not null) end as hits, n from p)"""
_add(
    "execution_reasons",
    lambda s, d: executed(s, d).select("item_id", "reject_reason", F.round("reference_pass_rate", 6).alias("reference_pass_rate"), F.array_join("baseline_hits", ",").alias("hits")),
    f"with {_WORDS} select item_id, case when n < 20 then 'too_few_tests' when rate < 1 then 'reference_solution_failed' when len(hits) > 0 then 'trivial_baseline_passed' end as reject_reason, round(rate, 6) as reference_pass_rate, array_to_string(hits, ',') as hits from e",
)
_add("baseline_tally", lambda s, d: problems.baseline_tally(executed(s, d)), f"with {_WORDS} select baseline, count(*) as problems from (select unnest(hits) as baseline from e) group by 1")


def line_problems(s: SparkSession, d: str) -> DataFrame:
    """Documents as problems: every line is a case; a document of the third source counts as a contest's."""
    docs = read(s, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.when(F.col("source") == "src3", problems.CONTESTS).otherwise(F.col("source")).alias("source"), F.lit("stdio").alias("io_mode"))
    return docs.withColumn("test_cases", F.transform(F.split("prompt", "\n"), lambda x: F.struct(x.alias("input"), F.lit("").alias("output"))))


_SIGNATURE = r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_add(
    "deduplicated_problems", lambda s, d: problems.deduplicated(line_problems(s, d), "doc_id").select("doc_id", "position"),
    rf"""with t as (select doc_id, text, source, string_split(text, chr(10)) as l, {_SIGNATURE} as sig, len(regexp_extract_all(text, '[^\s\x0b]+')) as tokens from documents),
    k as (select doc_id, len(l) as n, tokens, source = 'src3' as contest, sig || chr(31) || array_to_string(l, chr(30)) as k1, array_to_string(string_split(sig, ' ')[1:80], ' ') || chr(31) || array_to_string(list_transform(l[1:3], lambda x: regexp_replace(x, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), chr(30)) as k2 from t),
    e as (select *, row_number() over (partition by k1 order by n desc, tokens, contest desc, doc_id) as r, min(doc_id) over (partition by k1) as p from k),
    f as (select *, row_number() over (partition by k2 order by n desc, tokens, contest desc, p) as q, min(p) over (partition by k2) as position from e where r = 1)
    select doc_id, position from f where q = 1""",
)
