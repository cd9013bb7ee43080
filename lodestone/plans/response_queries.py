"""Response parsing over the driver's conversations: assistant turns dressed as thoughts, contents and tool calls, some of them broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import responses
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def dressed(s: SparkSession, d: str) -> DataFrame:
    """Every turn with its text as content; by its conversation a thought, a call, a call without a name or a call that is cut off."""
    turns = read(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    call = F.concat(F.lit("\n<tool_call>\n"), F.to_json(F.struct(F.lit("look_up").alias("name"), F.struct(F.col("text").alias("query")).alias("arguments"))), F.lit("\n</tool_call>"))
    nameless = F.concat(F.lit("\n<tool_call>\n"), F.to_json(F.struct(F.struct(F.col("text").alias("query")).alias("arguments"))), F.lit("\n</tool_call>"))
    k = F.col("conv_id") % 5
    body = F.concat(F.lit("x "), F.md5("text"), F.when(k == 1, call).when(k == 2, nameless).when(k == 3, F.lit("\n<tool_call>\n{\"name\"")).otherwise(""))
    thought = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>\n"), F.md5(F.concat(F.lit("t"), "text")), F.lit("\n</think>\n\n"))).otherwise("")
    return turns.select("conv_id", "turn", F.concat(thought, body, F.lit("<|im_end|>")).alias("response"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    out = responses.parsed(dressed(s, d), "response")
    query = F.expr("try_variant_get(parsed.tool_calls[0].function.arguments, '$.query', 'string')")
    return out.select("conv_id", "turn", F.md5("parsed.content").alias("content"), F.col("parsed.reasoning_content").alias("thought"), F.md5(query).alias("query"), "parsed.failed")


QUERIES["parsed_responses"] = parsed
ORACLES["parsed_responses"] = """with t as (select conv_id, turn, coalesce(text, '') as text, conv_id % 5 as k, case when turn % 2 = 0 then '<think>' || chr(10) || md5('t' || coalesce(text, '')) || chr(10) || '</think>' || chr(10) || chr(10) else '' end as thought from conversations)
    select conv_id, turn, md5(case when k = 2 then thought || 'x ' || md5(text) || chr(10) || '<tool_call>' || chr(10) || '{"arguments":' || json_object('query', text)::varchar || '}' || chr(10) || '</tool_call>' when k = 3 then 'x ' || md5(text) || chr(10) || '<tool_call>' || chr(10) || '{"name"' else 'x ' || md5(text) end) as content,
    case when turn % 2 = 0 and k <> 2 then md5('t' || text) end as thought, case when k = 1 then md5(text) end as query, k = 2 as failed from t"""
