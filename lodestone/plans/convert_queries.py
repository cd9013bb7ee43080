"""Format queries: conversations as messages, the first two assistant turns of a conversation as a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import convert as c
from lodestone.sources.tables import read


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One row a conversation: its turns in order (bounded by a conversation)."""
    turns = read(spark, d, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return turns.groupBy("conv_id").agg(ordered.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, prompt, chosen, rejected) as text: the first user turn, the first two assistant turns."""
    role = lambda r: F.filter("messages", lambda m: m["role"] == r)
    rows = messages(spark, d).select("conv_id", role("user").alias("u"), role("assistant").alias("a")).where("size(a) >= 2 and size(u) >= 1")
    return rows.select("conv_id", F.element_at("u", 1)["content"].alias("prompt"), F.element_at("a", 1)["content"].alias("chosen"), F.element_at("a", 2)["content"].alias("rejected"))


_M = "m as (select conv_id, list(struct_pack(role := role, content := coalesce(text, '')) order by turn, role, coalesce(text, '')) as messages from conversations group by conv_id)"
_P = _M + ", a as (select conv_id, list_filter(messages, lambda x: x.role = 'user') as u, list_filter(messages, lambda x: x.role = 'assistant') as a from m), p as (select conv_id, u[1].content as prompt, a[1].content as chosen, a[2].content as rejected from a where len(a) >= 2 and len(u) >= 1)"
QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


_add("unpair", lambda s, d: c.unpair(pairs(s, d), ordinal="conv_id"), f"with {_P} select conv_id, prompt, chosen as completion, true as label from p union all select conv_id, prompt, rejected, false from p")
_add("chatml", lambda s, d: _flat(c.to_chatml(messages(s, d).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("conversations")))), f"with {_M}, f as (select conv_id, unnest(messages) as x, unnest(range(len(messages))) as i from m) select conv_id, i, x.role as role, x.content as content from f")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("messages").alias("i", "x")).select("conv_id", "i", "x.role", "x.content")


_add("chat_template", lambda s, d: c.apply_template(messages(s, d)), f"with {_M} select conv_id, array_to_string(list_transform(messages, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '') as text from m")


def chat_prompt(s: SparkSession, d: str) -> DataFrame:
    msg = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), F.col(text).alias("content")))
    rows = pairs(s, d).select("conv_id", msg("user", "prompt").alias("prompt"), msg("assistant", "chosen").alias("chosen"), msg("assistant", "rejected").alias("rejected"))
    return c.apply_template(rows)


_add("chat_template_preference", chat_prompt, f"with {_P} select conv_id, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt, chosen || '<|im_end|>' || chr(10) as chosen, rejected || '<|im_end|>' || chr(10) as rejected from p")


def extract_prompt_messages(s: SparkSession, d: str) -> DataFrame:
    m = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    rows = pairs(s, d).select("conv_id", F.array(m("user", "prompt"), m("assistant", "chosen")).alias("chosen"), F.array(m("user", "prompt"), m("assistant", "rejected")).alias("rejected"))
    out = c.extract_prompt(rows)
    return out.select("conv_id", F.element_at("prompt", 1)["content"].alias("prompt"), F.size("prompt").alias("n"), F.element_at("chosen", 1)["content"].alias("chosen"), F.element_at("rejected", 1)["content"].alias("rejected"))


_add("extract_prompt_messages", extract_prompt_messages, f"with {_P} select conv_id, prompt, 1 as n, chosen, rejected from p")


def extract_prompt_text(s: SparkSession, d: str) -> DataFrame:
    return c.extract_prompt(pairs(s, d).select("conv_id", F.concat("prompt", F.lit(" x"), "chosen").alias("chosen"), F.concat("prompt", F.lit(" y"), "rejected").alias("rejected")))


_add("extract_prompt_text", extract_prompt_text, f"with {_P} select conv_id, prompt, ' x' || chosen as chosen, ' y' || rejected as rejected from p")

def _steps():
    return F.split("chosen", r"\. ").alias("completions"), F.transform(F.split("chosen", r"\. "), lambda x: F.length(x) > 3).alias("labels")


_SOURCES = {
    "prompt_completion": lambda p: p.select("conv_id", "prompt", F.col("chosen").alias("completion")),
    "preference": lambda p: p,
    "implicit_preference": lambda p: p.select("conv_id", F.concat("prompt", F.lit(" x"), "chosen").alias("chosen"), F.concat("prompt", F.lit(" y"), "rejected").alias("rejected")),
    "unpaired": lambda p: p.select("conv_id", "prompt", F.col("chosen").alias("completion"), (F.col("conv_id") % 2 == 0).alias("label")),
    "stepwise": lambda p: p.select("conv_id", "prompt", *_steps()),
}
_ALL = "len(list_filter(string_split(chosen, '. '), lambda x: length(x) <= 3)) = 0"
_JOINED = "replace(chosen, '. ', '')"
_CONVERSIONS = {
    ("prompt_completion", "language_modeling"): "select conv_id, prompt || chosen as text from p", ("prompt_completion", "prompt_only"): "select conv_id, prompt from p",
    ("implicit_preference", "language_modeling"): "select conv_id, prompt || ' x' || chosen as text from p", ("implicit_preference", "prompt_completion"): "select conv_id, prompt, ' x' || chosen as completion from p",
    ("implicit_preference", "prompt_only"): "select conv_id, prompt from p", ("implicit_preference", "preference"): "select conv_id, prompt, ' x' || chosen as chosen, ' y' || rejected as rejected from p",
    ("implicit_preference", "unpaired"): "select conv_id, prompt, ' x' || chosen as completion, true as label from p union all select conv_id, prompt, ' y' || rejected, false from p",
    ("preference", "language_modeling"): "select conv_id, prompt || chosen as text from p", ("preference", "prompt_completion"): "select conv_id, prompt, chosen as completion from p",
    ("preference", "prompt_only"): "select conv_id, prompt from p", ("preference", "implicit_preference"): "select conv_id, prompt || chosen as chosen, prompt || rejected as rejected from p",
    ("preference", "unpaired"): "select conv_id, prompt, chosen as completion, true as label from p union all select conv_id, prompt, rejected, false from p",
    ("unpaired", "language_modeling"): "select conv_id, prompt || chosen as text from p where conv_id % 2 = 0", ("unpaired", "prompt_completion"): "select conv_id, prompt, chosen as completion from p where conv_id % 2 = 0",
    ("unpaired", "prompt_only"): "select conv_id, prompt from p", ("stepwise", "language_modeling"): f"select conv_id, prompt || {_JOINED} as text from p where {_ALL}",
    ("stepwise", "prompt_completion"): f"select conv_id, prompt, {_JOINED} as completion from p where {_ALL}", ("stepwise", "prompt_only"): "select conv_id, prompt from p",
    ("stepwise", "unpaired"): f"select conv_id, prompt, {_JOINED} as completion, {_ALL} as label from p",
}
for (_a, _b), _sql in _CONVERSIONS.items():
    _add(f"convert_{_a}_to_{_b}", lambda s, d, a=_a, b=_b: c.convert(_SOURCES[a](pairs(s, d)), a, b), f"with {_P} {_sql}")


def multimodal(s: SparkSession, d: str) -> DataFrame:
    rows = messages(s, d).withColumn("images", F.array(F.concat(F.lit("img-"), F.col("conv_id").cast("string"))))
    out = c.with_images(rows, "messages", "images").select("conv_id", F.posexplode("messages").alias("i", "m"))
    return out.select("conv_id", "i", "m.role", F.size("m.content").alias("blocks"), F.element_at("m.content", 1)["type"].alias("first"), F.element_at("m.content", -1)["text"].alias("text"))


_add("multimodal_prepare", multimodal, f"with {_M}, f as (select conv_id, list_position(list_transform(messages, lambda x: x.role), 'user') as u, unnest(messages) as x, unnest(range(len(messages))) as i from m) select conv_id, i, x.role as role, case when i + 1 = u then 2 else 1 end as blocks, case when i + 1 = u then 'image' else 'text' end as first, x.content as text from f")
_add("eos_append", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", c.with_eos(F.col("text"), ".").alias("text")), "select conv_id, turn, case when text like '%.' then text else text || '.' end as text from conversations")

# ------------------------------------------------------------------ text


_add("token_count", lambda s, d: read(s, d, "documents").select("doc_id", t.token_count(F.col("text")).alias("n")), r"select doc_id, len(regexp_extract_all(text, '[^\s\x0b]+')) as n from documents")
_add("text_signature", lambda s, d: read(s, d, "pages").select("page_id", F.md5(t.signature(F.col("html"))).alias("sig")), r"select page_id, md5(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) as sig from pages")
_add("summarize_text", lambda s, d: read(s, d, "documents").select("doc_id", t.summary(F.col("text"), 2, 80).alias("summary")), r"with h as (select doc_id, array_to_string(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1:2], chr(10)) as h from documents) select doc_id, case when length(h) > 80 then regexp_replace(substr(h, 1, 77), '\s+$', '') || '...' else h end as summary from h")


def _completions(s: SparkSession, d: str) -> DataFrame:
    k, x = F.col("doc_id") % 5, F.translate("text", "`<", "''")
    fence = lambda y: F.concat(F.lit("```python\n"), y, F.lit("\n```"))
    made = F.when(k == 0, fence(x)).when(k == 1, F.concat(fence(F.lit("a")), F.lit("\nso\n"), fence(x))).when(k == 2, F.concat(F.lit("<think>hm</think> "), x)).when(k == 3, F.concat(F.lit("<CODE>"), x, F.lit("</CODE>"))).otherwise(x)
    return read(s, d, "documents").select("doc_id", made.alias("c"))


_C = "x as (select doc_id, doc_id % 5 as k, translate(text, '`<', chr(39) || chr(39)) as x from documents)"
_STRIP = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
_add("extract_code_block", lambda s, d: _completions(s, d).select("doc_id", t.code_of(F.col("c")).alias("code"), t.format_ok(F.col("c")).alias("ok")), f"with {_C} select doc_id, case when k = 2 then regexp_replace('<think>hm</think> ' || x, '\\s+$', '') else {_STRIP} end as code, k in (0, 3) as ok from x")
_add("think_format", lambda s, d: _completions(s, d).select("doc_id", t.think_format(F.col("c")).alias("reward")), f"with {_C} select doc_id, case when k = 2 then 1.0::double else 0.0::double end as reward from x")
_add("stop_strings", lambda s, d: read(s, d, "documents").select("doc_id", t.before_stops(F.col("text"), [". ", "\n"]).alias("t")), "select doc_id, substr(text, 1, least(case when contains(text, '. ') then strpos(text, '. ') - 1 else length(text) end, case when contains(text, chr(10)) then strpos(text, chr(10)) - 1 else length(text) end)) as t from documents")
_add("slug", lambda s, d: read(s, d, "pages").select("page_id", t.slug(F.col("url")).alias("slug")), "select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from pages")
_add("error_type", lambda s, d: read(s, d, "pages").select("page_id", t.error_type(F.regexp_replace("url", "^https?://", "")).alias("kind")), r"select page_id, upper(trim(string_split(string_split(regexp_replace(url, '^https?://', ''), ':')[1], '.')[-1])) as kind from pages")
