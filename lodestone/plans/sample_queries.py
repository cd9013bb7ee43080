"""Rows, samples, histories and further losses over the driver's tables: line items are nodes and cases, conversations are histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import losses, prepare
from lodestone.operators import groups, rows, samples
from lodestone.plans.prepare_queries import _S, _digest, _rounded, split
from lodestone.plans.token_queries import _V, ids, vectors
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def _table(name: str):
    return lambda s, d: read(s, d, name)


lines, orders, events, documents = (_table(n) for n in ("lineitem", "orders", "events", "documents"))


# ------------------------------------------------------------------ traces and samples


def traces(s: SparkSession, d: str) -> DataFrame:
    e = F.expr
    nodes = lines(s, d).select(
        "l_orderkey", e("element_at(array('OK', 'SYNTAX_ERROR', 'TIMEOUT', 'WRONG'), l_linenumber % 4 + 1)").alias("status"), e("l_discount * 10").alias("rate"),
        e("if(l_tax > 0.04, 0D, 1D)").alias("compiled"), e("l_returnflag <> 'R'").alias("ok"), F.col("l_tax").alias("soft"), e("l_linestatus = 'O'").alias("full"),
    )
    return samples.trace_scores(nodes, "l_orderkey", "status", "rate", "compiled", "ok", "soft", "full")


_TRACES = (
    "select l_orderkey, sum((l_linenumber % 4 in (1, 2))::int)::double as hard_errors, sum((l_tax > 0.04::double or l_returnflag = 'R')::int)::double as compile_failures,"
    " sum((l_discount * 10 < 1 and l_tax > 0)::int)::double as soft_failures, sum((l_discount * 10 < 1)::int)::double as unsolved,"
    " max(case when l_discount * 10 < 1 then l_tax else 0 end) as most_soft, max((l_linestatus = 'O')::int)::double as full_text from lineitem group by 1"
)
_add("trace_scores", traces, _TRACES)
_add(
    "trace_selection", lambda s, d: samples.selected_traces(traces(s, d), "l_orderkey", 50).select("l_orderkey"),
    f"select l_orderkey from ({_TRACES}) order by hard_errors desc, compile_failures desc, soft_failures desc, most_soft desc, unsolved desc, full_text desc, l_orderkey limit 50",
)
_add(
    "trace_due", lambda s, d: events(s, d).where(samples.trace_due(F.col("event_id"), 7, F.col("user_id"), 40)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "select event_type, count(*) as n from events where event_id % 7 = 0 and user_id < 40 group by 1",
)


def metric_keys(s: SparkSession, d: str) -> DataFrame:
    made = F.create_map(F.concat("l_returnflag", F.lit("_std")), F.col("l_tax"), F.concat(F.lit("eval_"), "l_linestatus"), F.col("l_tax"))
    shown = lambda **k: F.array_join(F.map_keys(samples.public_metrics(made, ["A_std", "N"], ["eval_O", "R"], **k)), ",")
    return lines(s, d).select(shown().alias("all"), shown(deviations=False).alias("plain")).groupBy("all", "plain").agg(F.count(F.lit(1)).alias("n"))


_add(
    "public_metrics", metric_keys,
    "select concat_ws(',', case when l_returnflag in ('A', 'R') then l_returnflag || '_std' end, case when l_linestatus = 'O' then 'eval_O' end) as \"all\", case when l_linestatus = 'O' then 'eval_O' else '' end as plain, count(*) as n from lineitem group by 1, 2",
)


def main_counts(s: SparkSession, d: str) -> DataFrame:
    nodes = lines(s, d).select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")).alias("text"), F.array(F.lit(1), F.lit(1)).alias("mask"))
    return samples.main_samples(nodes, "text", "mask").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sft_mask")).alias("tokens"), F.sum("sft_weight").alias("weight"))


_add("main_samples", main_counts, "select l_suppkey, count(*) as n, 2 * count(*) as tokens, 0.0::double as weight from lineitem where l_returnflag <> 'N' group by 1")
_CASE = ("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")


def aux(s: SparkSession, d: str) -> DataFrame:
    e = F.expr
    cases = lines(s, d).select("l_orderkey", *_CASE, e("if(l_returnflag = 'A', '', l_returnflag)").alias("target"), e("l_linenumber % 2 = 0").alias("passed"), e("if(l_linestatus = 'O', 'OK', 'TIMEOUT')").alias("kind"))
    return samples.aux_samples(cases, "l_orderkey", "target", "passed", "kind", _CASE, 2, errors=False, weights=(1.0, 0.5)).select("l_orderkey", "l_quantity", "l_partkey", "target", "sft_weight")


_add(
    "aux_samples", aux,
    f"select l_orderkey, l_quantity, l_partkey, l_returnflag as target, case when l_linenumber % 2 = 0 then 1.0::double else 0.5::double end as sft_weight from lineitem where l_returnflag <> 'A' and l_linestatus = 'O' qualify row_number() over (partition by l_orderkey order by {', '.join(_CASE)}) <= 2",
)
_add(
    "mixed_sources",
    lambda s, d: samples.mixed_sources(lines(s, d), "l_orderkey", "l_linenumber", F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, 0.3, F.col("l_suppkey") % 3).groupBy("source", "forced_original").agg(F.count(F.lit(1)).alias("n")),
    "with x as (select l_discount * 10 < 0.3::double as f, (l_orderkey + l_linenumber) % 2 = 1 as odd, l_quantity / 50 < 1 and l_tax * 10 > l_quantity / 50 as gone, l_suppkey % 3 > 0 as pool from lineitem)"
    " select case when not f and (odd or gone) and pool then 'iterative' else 'original' end as source, f and pool as forced_original, count(*) as n from x group by 1, 2",
)
_add(
    "unseen_questions", lambda s, d: samples.unseen(orders(s, d), lines(s, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderdate", 100).select("o_orderkey"),
    "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by o_orderdate, o_orderkey limit 100",
)
_add(
    "next_batch", lambda s, d: samples.next_batch(documents(s, d), rows.handled_ids(read(s, d, "labels").where("quality = 1"), read(s, d, "labels").where("toxic = 1"), "doc_id"), "doc_id", "n_chars", 200).select("doc_id"),
    "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1 or toxic = 1) order by n_chars, doc_id limit 200",
)

# ------------------------------------------------------------------ budgets and histories


def budgets(s: SparkSession, d: str) -> DataFrame:
    new, met = samples.budget(F.col("o_custkey"), F.lit(512), 1024, 256)
    return orders(s, d).select("o_orderkey", new.cast("long").alias("new"), met.alias("met"))


_add("token_budget", budgets, "select o_orderkey, least(512, greatest(1024 - o_custkey, 1))::bigint as new, greatest(1024 - o_custkey, 0) >= 256 as met from orders")


def histories(s: SparkSession, d: str) -> DataFrame:
    e = F.expr
    round_ = F.struct(
        "turn", F.col("role").alias("status"), e("if(turn % 3 = 0, null, string(length(text) % 3))").alias("failed_input"), e("if(turn % 2 = 0, null, text)").alias("failed_actual"),
        e("if(conv_id % 2 = 0, '', role)").alias("error"), e("double(length(text) % 2)").alias("compile_score"), F.length("text").alias("tokens"),
    )
    return read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(round_)).alias("h"))


_add(
    "history_start", lambda s, d: histories(s, d).withColumn("n", F.expr("transform(h, x -> x.tokens)")).select("conv_id", samples.history_start("n", "int(conv_id % 300)", "400", 2000, 300).alias("dropped")),
    "with c as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, sum(length(text)) over (partition by conv_id order by turn desc) as t from conversations), a as (select * from c union all select conv_id, count(*) as i, 0 as t from conversations group by 1)"
    " select conv_id, coalesce(min(i) filter (where greatest(2000 - conv_id % 300 - t, 0) >= 300), max(i))::int as dropped from a group by 1",
)


def summaries(s: SparkSession, d: str) -> DataFrame:
    latest, earlier = samples.history_summary("h")
    return histories(s, d).select("conv_id", F.md5(latest).alias("latest"), earlier.alias("earlier"))


_add(
    "history_summary", summaries,
    "with c as (select *, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n, case when turn % 3 <> 0 then (length(text) % 3)::varchar end as fi from conversations),"
    " l as (select conv_id, md5(concat_ws(chr(10), '- latest_status=' || role, '- failed_input=' || fi, case when turn % 2 <> 0 then '- actual_result_or_error=' || text end, case when conv_id % 2 <> 0 then '- error_summary=' || role end)) as latest from c where k = n),"
    " r as (select conv_id, string_agg(role || ':' || m, ', ' order by role) as st from (select conv_id, role, count(*) as m from c where k < n group by 1, 2) group by 1),"
    " f as (select * from (select conv_id, fi, count(*) as m, min(k) as k from c where k < n and fi is not null group by 1, 2) qualify row_number() over (partition by conv_id order by m desc, k) = 1),"
    " e as (select conv_id, count(*) as m, bool_or(length(text) % 2 = 0) as bad from c where k < n group by 1)"
    " select l.conv_id, latest, case when e.m is null then '' else concat_ws(chr(10), '- earlier_rounds=' || e.m, '- status_counts=' || st, case when f.m >= 2 then '- repeated_failure_input=' || fi end, case when bad then '- some_earlier_attempts_failed_to_compile' end) end as earlier"
    " from l left join e using (conv_id) left join r using (conv_id) left join f using (conv_id)",
)
_add(
    "same_manifest", lambda s, d: lines(s, d).withColumns({"a": F.expr("map('f', l_returnflag, 's', l_linestatus)"), "b": F.expr("map('s', 'O', if(l_linenumber > 3, 'f', 'g'), 'N')")}).groupBy(samples.same_manifest("a", "b").alias("same")).agg(F.count(F.lit(1)).alias("n")),
    "select l_returnflag = 'N' and l_linestatus = 'O' and l_linenumber > 3 as same, count(*) as n from lineitem group by 1",
)

# ------------------------------------------------------------------ rows

_add(
    "positional_join", lambda s, d: rows.positional_join(orders(s, d).select("o_orderkey", "o_totalprice"), orders(s, d).select("o_orderkey", "o_custkey"), "o_orderkey"),
    "select o_orderkey, o_totalprice, o_custkey from orders",
)
_add(
    "strict_zip", lambda s, d: documents(s, d).withColumn("w", F.split("text", " ")).withColumn("n", F.expr("transform(w, x -> length(x))")).select("doc_id", _digest(F.transform(rows.strictly_zipped(w="w", n="n"), lambda z: F.concat(z.w, z.n))).alias("h")),
    "select doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda x: x || length(x)), ',')) as h from documents",
)
_add("handled_ids", lambda s, d: rows.handled_ids(read(s, d, "labels").where("quality = 1"), read(s, d, "labels").where("toxic = 1"), "doc_id"), "select doc_id from labels where quality = 1 union select doc_id from labels where toxic = 1")
_add(
    "first_prompts", lambda s, d: rows.first_by(events(s, d), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value"),
    "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1",
)


def log_rows(s: SparkSession, d: str) -> DataFrame:
    steps = events(s, d).withColumn("step", F.floor(F.col("event_id") / 10))
    return rows.completions_to_log(steps, steps.where("step < 50"), "step", 5).select("event_id", "step")


_add("completion_log", log_rows, "select event_id, (event_id // 10)::bigint as step from events where event_id // 10 >= 50 and (event_id // 10) % 5 = 0")


def chunks(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d).select("o_orderkey", "o_custkey")
    return rows.chunked(groups.numbered(o, "o_orderkey", name="k"), "k", 7, o.count()).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


_add(
    "chunks", chunks,
    "with k as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k, count(*) over () // 7 as size from orders) select (k // size)::bigint as chunk, count(*) as n, min(o_orderkey) as lo, max(o_orderkey) as hi from k where k // size < 7 group by 1",
)
_add("pair_within", lambda s, d: split(s, d).where(rows.pair_within("a", "b", 120)).select("doc_id"), f"with {_S} select doc_id from s where len(a) <= 120 and len(b) <= 120")
_add(
    "checked_rows", lambda s, d: rows.checked(documents(s, d), "doc_id", ["text", "lang"], ["n_chars"], ["doc_id"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n")),
    "select lang, count(*) as n from documents group by 1",
)
_RENDERED = "array(concat(lang, if(doc_id % 7 = 0, '!', '')), concat(lang, text), concat(lang, text, if(doc_id % 5 = 0, '', source)))"
_add(
    "nested_prefixes", lambda s, d: documents(s, d).withColumn("r", F.expr(_RENDERED)).select("doc_id", rows.nested_prefixes("r").alias("nests")),
    "select doc_id, starts_with(lang || text, lang || case when doc_id % 7 = 0 then '!' else '' end) as nests from documents",
)
_add(
    "without_nulls", lambda s, d: documents(s, d).select("doc_id", rows.without_nulls(F.expr("struct(nullif(doc_id % 3, 0) as a, struct(nullif(doc_id % 5, 0) as c, 1 as e) as b, array(null, doc_id) as l)")).alias("json")),
    "select doc_id, '{' || case when doc_id % 3 <> 0 then '\"a\":' || doc_id % 3 || ',' else '' end || '\"b\":{' || case when doc_id % 5 <> 0 then '\"c\":' || doc_id % 5 || ',' else '' end || '\"e\":1},\"l\":[null,' || doc_id || ']}' as json from documents",
)
_add(
    "split_by_counts", lambda s, d: vectors(s, d).withColumn("p", rows.split_by_counts("a", "array(label % 8 + 1, 10, 20)")).select("vec_id", F.size(F.col("p")[0]).alias("n"), F.expr("round(aggregate(p[1], 0D, (t, x) -> t + x), 6) + 0.0").alias("middle"), F.expr("round(p[2][0], 6) + 0.0").alias("third")),
    f"with {_V} select vec_id, (label % 8 + 1)::int as n, round(sum(a) filter (where i > label % 8 and i <= label % 8 + 10), 6) + 0.0 as middle, round(max(case when i = label % 8 + 11 then a end), 6) + 0.0 as third from v group by vec_id, label",
)
_add(
    "example_ids", lambda s, d: orders(s, d).withColumns({"question_id": F.expr("if(o_orderkey % 3 = 0, o_orderstatus, '')"), "id": F.expr("if(o_orderkey % 2 = 0, null, o_custkey)")}).select(
        "o_orderkey", rows.example_id(F.col("o_orderkey"), "question_id", "id").alias("id"), rows.io_mode(F.expr("if(o_orderkey % 5 = 0, ' Call ', '')"), F.col("o_orderkey") % 2 == 0).alias("mode")),
    "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus when o_orderkey % 2 <> 0 then o_custkey::varchar else 'q_' || o_orderkey end as id, case when o_orderkey % 5 = 0 then 'call' when o_orderkey % 2 = 0 then 'stdio' else 'call' end as mode from orders",
)


def dialogues(s: SparkSession, d: str) -> DataFrame:
    opening = F.concat(F.lit(rows.HUMAN), "text", F.lit(rows.ASSISTANT), "source", F.lit(rows.HUMAN), "lang", F.lit(rows.ASSISTANT))
    made = documents(s, d).select("doc_id", F.concat(opening, "text").alias("chosen"), F.concat(opening, F.lit("!"), "text").alias("rejected"))
    out = rows.dialogue(made, "chosen", "rejected")
    return out.select("doc_id", F.expr("array_join(prompt.role, ',')").alias("roles"), F.expr("md5(array_join(prompt.content, '|'))").alias("prompt"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


_add("dialogue_split", dialogues, "select doc_id, 'user,assistant,user' as roles, md5(text || '|' || source || '|' || lang) as prompt, md5(text) as chosen, md5('!' || text) as rejected from documents")

# ------------------------------------------------------------------ tokens


def unpaired(s: SparkSession, d: str) -> DataFrame:
    made = prepare.unpaired("a", "b", 150, 3, 4)
    return split(s, d).select("doc_id", F.size(made["prompt_ids"]).alias("n_prompt"), _digest(made["ids"]).alias("ids"), _digest(made["labels"]).alias("labels"))


_add(
    "unpaired_tokens", unpaired,
    f"with {_S}, r as (select *, len(a) > 0 and a[1] = 3 as has_b, 150 - (len(a) > 0 and a[1] <> 3)::int - (len(b) > 0 and b[-1] <> 4)::int - len(a) as room from s),"
    " k as (select doc_id, case when has_b then a else list_concat([3], a) end as p, case when len(b) <= room then b when room >= 0 then b[1:room] else b[1:greatest(len(b) + room, 0)] end as c from r),"
    " z as (select doc_id, p, case when len(c) > 0 and c[-1] = 4 then c else list_concat(c, [4]) end as c from k)"
    " select doc_id, len(p)::int as n_prompt, md5(array_to_string(list_concat(p, c), ',')) as ids, md5(array_to_string(list_concat(list_transform(p, lambda x: -100), c), ',')) as labels from z",
)


def pair_cut(s: SparkSession, d: str) -> DataFrame:
    a, b = prepare.pair_answers(("size(a)", "size(a)"), ("a", "b"), 200)
    return split(s, d).select("doc_id", F.size(a).alias("na"), F.size(b).alias("nb"), F.size(prepare.shared_prompt("a", "slice(ids, 1, 5)", "slice(ids, 1, 6)")).alias("np"))


_CUT = "case when len(a) + greatest(len(a), len(b)) <= 200 then len({0}) when greatest(len(a), len(b)) <= 200 then least(len({0}), 200 - greatest(len(a), len(b))) else greatest(len({0}) + 200 - greatest(len(a), len(b)), 0) end::int"
_add("pair_answers", pair_cut, f"with {_S} select doc_id, {_CUT.format('a')} as na, {_CUT.format('b')} as nb, least(len(a), len(ids), 5)::int as np from s")

# ------------------------------------------------------------------ losses


def code_rows(s: SparkSession, d: str) -> DataFrame:
    e = F.expr
    return vectors(s, d).select(F.expr("label % 5").alias("batch"), e("transform(a, x -> -abs(x))").alias("lp"), e("transform(b, x -> -abs(x))").alias("old"), e("double(vec_id % 7 - 3)").alias("adv"), "m", e("transform(m, x -> 1 - x)").alias("k"), e("double(vec_id % 3) / 2").alias("w"))


def _code(by_token: bool):
    return lambda s, d: _rounded(losses.code_loss(code_rows(s, d), "lp", "old", "adv", "m", "k", "w", beta_sft=0.3, by_token=by_token, by="batch", ref="old", beta=0.1, mask="m"), "batch")


_CODE = f"with {_V}, t as (select vec_id, label % 5 as batch, -abs(a) as p, -abs(b) as q, exp(-abs(a) + abs(b)) as r, (vec_id % 7 - 3)::double as adv, m, 1 - m as k, (vec_id % 3) / 2.0::double as w from v), u as (select vec_id, batch, w, sum(-least(r * adv, greatest(least(r, 1.2::double), 0.8::double) * adv) * m) as c, sum(m) as nc, sum(-p * k) as s, sum(k) as ns, sum((exp(q - p) - (q - p) - 1) * m) as kl from t group by all) "
_add("code_loss_sequence", _code(False), _CODE + "select batch, round(avg(c / greatest(nc, 1)) + 0.3::double * avg(s / greatest(ns, 1) * w) + 0.1::double * avg(kl / greatest(nc, 1)), 6) + 0.0 as loss from u group by 1")
_add("code_loss_token", _code(True), _CODE + "select batch, round(sum(c) / greatest(sum(nc), 1) + 0.3::double * sum(s * w) / greatest(sum(ns * w), 1) + 0.1::double * avg(kl / greatest(nc, 1)), 6) + 0.0 as loss from u group by 1")


def pair_weights(s: SparkSession, d: str) -> DataFrame:
    e = F.expr
    made = vectors(s, d).select("vec_id", e("transform(sequence(0, 3), i -> slice(a, 16 * i + 1, 16))").alias("z"), e("transform(sequence(0, 3), i -> -abs(a[16 * i]))").alias("lp"), e("array(1D, 1D, 0D, 1D)").alias("k"))
    return made.select("vec_id", F.round(losses.pair_weight("lp", "z", "k"), 5).alias("weight"))


_add(
    "pair_weight", pair_weights,
    f"with {_V}, g as (select vec_id, i // 16 as g, max(case when i % 16 = 0 then -abs(a) end) as p, ln(sum(exp(2 * a))) - 2 * ln(sum(exp(a))) as n from v group by 1, 2) select vec_id, round(exp(sum(p - n) filter (where g <> 2) / 3), 5) as weight from g group by 1",
)
_add(
    "perception_loss",
    lambda s, d: vectors(s, d).withColumn("k", losses.perception_terms("a", "b")).select("vec_id", (F.round(losses.perception_loss(F.col("label").cast("double"), F.expr("aggregate(k, 0D, (t, x) -> t + x)"), F.col("a")[0], F.col("b")[0], 0.1, 0.03, 0.02), 6) + 0.0).alias("loss")),
    f"with {_V} select vec_id, round(label - 0.1::double * sum(greatest(least(exp(b - a) - (b - a) - 1, 0.2::double), 0)) + 0.03::double * max(case when i = 0 then a end) + 0.02::double * max(case when i = 0 then b end), 6) + 0.0 as loss from v group by vec_id, label",
)
_add(
    "reverse_kl", lambda s, d: vectors(s, d).withColumn("k", losses.reverse_kl_terms("a", "b")).select("vec_id", F.expr("round(aggregate(k, 0D, (t, x) -> t + x), 6) + 0.0").alias("kl")),
    f"with {_V} select vec_id, round(sum(exp(b) * (b - a)), 6) + 0.0 as kl from v group by 1",
)
_add(
    "online_statistics",
    lambda s, d: _rounded(losses.online_statistics(lines(s, d).withColumns({"mm": F.col("l_tax"), "mr": F.col("l_discount"), "rr": F.col("l_quantity") / 50, "rm": F.col("l_discount") * 3, "win": F.col("l_linenumber") % 2 == 0, "end": F.col("l_linestatus") == "O"}), "l_suppkey", "mm", "mr", "rr", "rm", "win", 0.1, "end"), "l_suppkey"),
    "with x as (select l_suppkey, l_tax as mm, l_discount as mr, l_quantity / 50 as rr, l_discount * 3 as rm, l_linenumber % 2 = 0 as w, l_linestatus = 'O' as e from lineitem),"
    " y as (select *, case when w then mm else mr end as cm, case when w then rm else rr end as cr, case when w then mr else mm end as jm, case when w then rr else rm end as jr from x)"
    " select l_suppkey, round(avg(cm) + avg(cr), 6) + 0.0 as logps_chosen, round(avg(jm) + avg(jr), 6) + 0.0 as logps_rejected, round(avg(0.1::double * (cm - cr)), 6) + 0.0 as rewards_chosen, round(avg(0.1::double * (jm - jr)), 6) + 0.0 as rewards_rejected,"
    " round(avg(0.1::double * ((cm - cr) - (jm - jr))), 6) + 0.0 as margin, round(avg((0.1::double * ((cm - cr) - (jm - jr)) > 0)::int), 6) + 0.0 as accuracy, round(avg((mm - rm) + (mr - rr)) / 2, 6) + 0.0 as kl, round(avg(-mm - mr) / 2, 6) + 0.0 as entropy, round(avg(e::int), 6) + 0.0 as has_end from y group by 1",
)
