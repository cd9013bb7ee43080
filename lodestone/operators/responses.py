"""Responses of chat models taken apart: thoughts, content and tool calls, with plain text where that fails.

Tool calls are VARIANT values, so their arguments may have any shape; all of it is built-in functions.

Results for odd input: a null response gives null; a response whose tool calls are no JSON, or lack a name or
arguments, is its plain text without special tokens, with ``failed`` set; a call that is never closed is content; an empty
response has empty content; arguments may be an empty object, but not null, a list or a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of a turn, and the pattern of a whole response (thought, content, calls) and of one call.
SPECIALS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>")
END = "<|im_end|>"
RESPONSE = r"(?s)^(?:<think>\n?(?:(.*?\S.*?)\n?|[\s]*)</think>\s*)?(.*?)(?:\n(?=<tool_call>))?(?=(?:<tool_call>|<\|im_end\|>|$))((?:<tool_call>.+?</tool_call>\s*)+)?\s*(?:<\|im_end\|>|$)"
CALL = r"(?s)<tool_call>\s*(.+?)\s*</tool_call>"

_MAP = "map<string,variant>"


def _complete(m: str) -> str:
    """Whether a map has a name that is a text, and arguments."""
    name, given = f"{m}['name']", f"{m}['arguments']"
    return f"coalesce(schema_of_variant({name}) = 'STRING', false) and {given} is not null and not is_variant_null({given})"


def valid_calls(calls: str) -> Column:
    """Whether all calls of an array of VARIANT have a name and arguments, be they flat or under ``function``; a null array is valid."""
    inner = f"try_variant_get(k__['function'], '$', '{_MAP}')"
    nested = f"transform(array({inner}), f__ -> f__ is not null and {_complete('f__')})[0]"
    one = f"transform(array(try_variant_get(c__, '$', '{_MAP}')), k__ -> k__ is not null and if(map_contains_key(k__, 'function'), {nested}, {_complete('k__')}))[0]"
    return F.expr(f"coalesce(forall({calls}, c__ -> coalesce({one}, false)), true)")


def plain_text(response: Column, specials: Sequence[str] = SPECIALS) -> Column:
    for mark in specials:
        response = F.replace(response, F.lit(mark), F.lit(""))
    return response


def parsed(df: DataFrame, response: str, name: str = "parsed", specials: Sequence[str] = SPECIALS) -> DataFrame:
    """Adds ``name``: (role, content, reasoning_content, tool_calls, failed). A call is (type, function (name, arguments)); no calls and no thought are null."""
    df = df.drop(name).withColumn("_r_text", F.col(response))
    calls = F.transform(F.regexp_extract_all(F.regexp_extract("_r_text", RESPONSE, 3), F.lit(CALL), 1), lambda x: F.try_parse_json(x))
    df = df.withColumns({"_r_thought": F.regexp_extract("_r_text", RESPONSE, 1), "_r_content": F.regexp_extract("_r_text", RESPONSE, 2), "_r_calls": calls})
    objects = F.expr("forall(_r_calls, c__ -> coalesce(schema_of_variant(variant_get(c__, '$.arguments', 'variant')) like 'OBJECT%', false))")
    df = df.withColumn("_r_good", valid_calls("_r_calls") & objects)
    made = F.expr("if(size(_r_calls) > 0, transform(_r_calls, c__ -> named_struct('type', 'function', 'function', named_struct('name', try_variant_get(c__, '$.name', 'string'), 'arguments', variant_get(c__, '$.arguments', 'variant')))), null)")
    ended = F.regexp_replace("_r_content", r"\Q" + END + r"\E$", "")
    whole = F.struct(
        F.lit("assistant").alias("role"), F.when(F.col("_r_good"), ended).otherwise(plain_text(F.col("_r_text"), specials)).alias("content"),
        F.when(F.col("_r_good"), F.nullif(F.col("_r_thought"), F.lit(""))).alias("reasoning_content"), F.when(F.col("_r_good"), made).alias("tool_calls"), (~F.col("_r_good")).alias("failed"),
    )
    return df.withColumn(name, F.when(F.col("_r_text").isNotNull(), whole)).drop("_r_text", "_r_thought", "_r_content", "_r_calls", "_r_good")
