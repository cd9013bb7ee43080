"""User functions over the driver's tables: documents are completions, their sources prompts, eight neighbours a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import userfuncs
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}
KNOWN = userfuncs.Registry()


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


@KNOWN.add
def brevity(completions: list[str], **_) -> list[float]:
    """1 for an empty completion, less for each letter."""
    return [1 - len(c or "") / 1000 for c in completions]


@KNOWN.add("digits")
async def _digits(completions: list[str], **_) -> list[float | None]:
    """How many digits there are; nothing is told of completions without one."""
    return [sum(x in "0123456789" for x in c or "") or None for c in completions]


@KNOWN.add("echo")
def _echo(prompts: list[str], completions: list[str], lang: list[str], **_) -> list[float | None]:
    """Of English ones, whether the prompt occurs in the completion."""
    return [float((p or "") in (c or "")) if g == "en" else None for p, c, g in zip(prompts, completions, lang, strict=True)]


def scored(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").select("doc_id", "lang", F.col("source").alias("prompt"), F.col("text").alias("completion"))
    functions = KNOWN.named(["brevity", "digits", "echo"]) | {"lines": F.when(F.col("doc_id") % 3 > 0, F.size(F.split("completion", "\n")))}
    return userfuncs.rewards(docs, functions, {"digits": 0.5, "lines": 0.01})


_SCORED = """s as (select doc_id, lang, coalesce(text, '') as t, 1 - length(coalesce(text, '')) / 1000::double as brevity, nullif(length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')), 0)::double as digits,
    case when lang = 'en' then contains(coalesce(text, ''), coalesce(source, ''))::int::double end as echo, case when doc_id % 3 > 0 then len(string_split(text, chr(10)))::double end as lines from documents),
    r as (select *, brevity + coalesce(digits, 0) * 0.5::double + coalesce(echo, 0) + coalesce(lines, 0) * 0.01::double as reward from s)"""
_add(
    "user_rewards",
    lambda s, d: scored(s, d).select("doc_id", *[F.round(f"reward_{n}", 6).alias(n) for n in ("brevity", "digits", "echo", "lines")], F.round("reward", 6).alias("reward"), "unscored"),
    f"with {_SCORED} select doc_id, round(brevity, 6) as brevity, digits, echo, lines, round(reward, 6) as reward, false as unscored from r",
)


def lively(group_completions: list[list[str]], group_rewards: list[list[float]]) -> list[list[float | None]]:
    """Rewards by length: empty completions are not scored."""
    return [[r / len(c) if c else None for c, r in zip(cs, rs, strict=True)] for cs, rs in zip(group_completions, group_rewards, strict=True)]


_add(
    "user_group_filter",
    lambda s, d: userfuncs.filtered_groups(scored(s, d).withColumn("group", F.floor(F.col("doc_id") / 8)).select("group", "doc_id", "completion", "reward"), "group", "doc_id", lively, 3).select("doc_id", F.round("group_score", 6).alias("score")),
    f"with {_SCORED}, g as (select doc_id, reward / nullif(length(t), 0) as score, row_number() over (partition by doc_id // 8 order by reward / nullif(length(t), 0) desc nulls last, doc_id) as k from r) select doc_id, round(score, 6) as score from g where k <= 3",
)
_add(
    "user_formatting",
    lambda s, d: userfuncs.formatted(read(s, d, "documents"), lambda row: f"{row['source']} ({row['lang']}): {row['text'] or ''}", "line", ["doc_id"]).select("doc_id", F.md5("line").alias("line")),
    "select doc_id, md5(source || ' (' || lang || '): ' || coalesce(text, '')) as line from documents",
)
