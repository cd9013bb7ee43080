"""Adapters over the driver's tables: documents as code examples and as supervised examples under various aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import adapters
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def records(s: SparkSession, d: str) -> DataFrame:
    """Documents as records: prompts under an alias, lines as cases in a list of objects or in parallel lists, of which some differ in length."""
    docs = read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("l", F.split("text", "\n"))
    listed = F.when(F.col("doc_id") % 2 == 0, F.transform("l", lambda x: F.struct(x.alias("stdin"), F.length(x).alias("stdout"))))
    outputs = F.expr("if(doc_id % 2 = 1, if(doc_id % 9 = 0, slice(l, 2, size(l)), l), null)")
    fields = F.struct(
        F.expr("if(doc_id % 4 = 0, concat('d', doc_id), null)").alias("question_id"), F.expr("if(doc_id % 4 = 1, doc_id, null)").alias("id"),
        F.expr("if(doc_id % 3 = 0, text, '')").alias("question"), F.expr("if(doc_id % 3 = 1, text, null)").alias("problem"), listed.alias("tests"),
        F.when(F.col("doc_id") % 2 == 1, F.col("l")).alias("input"), outputs.alias("output"), F.expr("case doc_id % 10 when 3 then ' Stdio ' when 7 then 'socket' end").alias("io_mode"),
    )
    return docs.select("doc_id", F.to_json(fields).alias("record"))


_INK = r"regexp_matches(text, '[^\s\x0b]')"
_add(
    "code_examples",
    lambda s, d: adapters.code_examples(records(s, d), "record", "doc_id").select("doc_id", "question_id", F.md5("prompt").alias("prompt"), F.size("test_cases").alias("cases"), "io_mode", "problem"),
    f"""with t as (select doc_id, coalesce(text, '') as text, len(string_split(coalesce(text, ''), chr(10))) as n from documents)
    select doc_id, case when doc_id % 4 = 0 then 'd' || doc_id when doc_id % 4 = 1 then doc_id::varchar else 'q_' || doc_id end as question_id,
    case when doc_id % 3 < 2 and {_INK} then md5(text) end as prompt, case when doc_id % 18 = 9 then null else n end as cases, case doc_id % 10 when 3 then 'stdio' when 7 then 'socket' else case when doc_id % 2 = 0 then 'stdio' else 'call' end end as io_mode,
    case when doc_id % 3 = 2 or not {_INK} then 'empty_prompt' when doc_id % 18 = 9 then 'no_test_cases' when doc_id % 10 = 7 then 'unsupported_io_mode' end as problem from t""",
)


def supervised(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "documents").select("doc_id", F.expr("if(doc_id % 3 > 0, source, '')").alias("instruction"), F.expr("if(doc_id % 4 > 0, lang, null)").alias("query"), F.expr("if(doc_id % 5 = 0, text, ' ')").alias("answer"), F.expr("if(doc_id % 7 > 0, source, null)").alias("solution"))
    return adapters.supervised_examples(rows, "Answer.", ["doc_id"]).select("doc_id", "prompt", F.md5(F.regexp_replace("completion", r"\s+", "")).alias("completion"), "problem")


_add(
    "supervised_examples", supervised,
    f"""with t as (select doc_id, coalesce(text, '') as text, source, case when doc_id % 3 > 0 then source when doc_id % 4 > 0 then lang end as p from documents),
    c as (select *, case when doc_id % 5 = 0 and {_INK} then text when doc_id % 7 > 0 then '```python' || source || '```' end as c from t)
    select doc_id, case when p is not null and c is not null then 'Answer.' || chr(10) || chr(10) || 'Question:' || chr(10) || p end as prompt, case when p is not null then md5(regexp_replace(c, '[\\s\\x0b]+', '', 'g')) end as completion, case when p is null then 'empty_prompt' when c is null then 'no_completion' end as problem from c""",
)
