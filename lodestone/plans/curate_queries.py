"""Curation, reward and rollout queries over the driver's tables.

In rollout queries an event's user is a question, its events are nodes in order of event_id, a purchase passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rewards as w
from lodestone.functions import text as t
from lodestone.operators import curate as c
from lodestone.operators import rollout as r
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents")


# ------------------------------------------------------------------ curation

def _reason():
    return c.first_reason([("prompt_too_long", t.token_count(F.col("text")) > 400), ("interactive_task", c.mentions(F.col("text"), ("the the", "password"))), ("too_few_tests", F.length("text") < 200), ("low_quality", F.coalesce(F.col("quality") == 0, F.lit(False)))])
_REASON = r"case when len(regexp_extract_all(text, '[^\s\x0b]+')) > 400 then 'prompt_too_long' when contains(lower(text), 'the the') or contains(lower(text), 'password') then 'interactive_task' when length(text) < 200 then 'too_few_tests' when quality = 0 then 'low_quality' end"


def rejected(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).join(read(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("reject_reason", _reason())


_R = f"j as (select d.doc_id, d.source, d.text, d.lang, d.n_chars, {_REASON} as reject_reason from documents d left join labels l using (doc_id))"
_add("reject_cascade", lambda s, d: rejected(s, d).select("doc_id", "reject_reason"), f"with {_R} select doc_id, reject_reason from j")
_add("reject_counts", lambda s, d: rejected(s, d).groupBy("source", "reject_reason").agg(F.count(F.lit(1)).alias("n")), f"with {_R} select source, reject_reason, count(*) as n from j group by all")
_add("length_stats", lambda s, d: docs(s, d).groupBy("lang").agg(F.min(F.length("text")).alias("lo"), F.max(F.length("text")).alias("hi"), F.round(F.avg(F.length("text")), 4).alias("mean")), "select lang, min(length(text)) as lo, max(length(text)) as hi, round(avg(length(text)), 4) as mean from documents group by lang")
_SIG = r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_DEDUPE = "select doc_id, position from (select doc_id, row_number() over (partition by k order by n_chars desc, doc_id) as rn, min(doc_id) over (partition by k) as position from (select *, {0} as k from documents)) where rn = 1"
_add("exact_dedupe", lambda s, d: c.dedupe(docs(s, d), [c.signature_key(F.col("text")), "lang"], "n_chars", "doc_id").select("doc_id", "position"), _DEDUPE.format(f"{_SIG} || chr(31) || lang"))
_add("near_dedupe", lambda s, d: c.dedupe(docs(s, d), [c.signature_key(F.col("text"), 80)], "n_chars", "doc_id").select("doc_id", "position"), _DEDUPE.format(f"array_to_string(string_split({_SIG}, ' ')[1:80], ' ')"))
_add("cross_source_hits", lambda s, d: c.cross_source(docs(s, d), c.signature_key(F.col("text"), 80), "source", "doc_id", 200), f"with k as (select doc_id, source, array_to_string(string_split({_SIG}, ' ')[1:80], ' ') as k from documents), f as (select *, first_value(source) over w as first_source, min(doc_id) over (partition by k) as first from k window w as (partition by k order by doc_id)) select doc_id, source, first_source, first from f where source <> first_source and doc_id > first order by doc_id limit 200")
_add("source_quota", lambda s, d: c.source_quota(docs(s, d), "source", "doc_id", {"src0": 10, "src1": 10, "src2": 5}, 60).select("doc_id", "source"), "with h as (select doc_id, source, md5('42|' || doc_id) as h from documents), q as (select *, row_number() over (partition by source order by h, doc_id) as rn from h) select doc_id, source from q order by case when rn <= case source when 'src0' then 10 when 'src1' then 10 when 'src2' then 5 else 0 end then 0 else 1 end, h, doc_id limit 60")
_add("ratio_split", lambda s, d: c.ratio_split(docs(s, d), "doc_id", ("train", "validation", "test"), (0.7, 0.15, 0.15), rounding="cuts").select("doc_id", "split"), "with n as (select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) - 1 as i, count(*) over () as n from documents) select doc_id, case when i < 0.7 * n then 'train' when i < 0.85 * n then 'validation' else 'test' end as split from n")
_add("hash_split", lambda s, d: docs(s, d).select("doc_id", c.hash_split("doc_id", 0.2).alias("split")), "select doc_id, case when ('0x' || substr(md5('42|' || doc_id), 1, 8))::bigint / 4294967296.0::double < 0.2::double then 'test' else 'train' end as split from documents")
_add("pending_anti_join", lambda s, d: c.pending(docs(s, d), read(s, d, "labels"), "doc_id").select("doc_id"), "select doc_id from documents where doc_id not in (select doc_id from labels)")
_add("stage_progress", lambda s, d: c.stage_progress(rejected(s, d).withColumn("done_", F.col("doc_id") % 3 > 0), "source", "done_", "reject_reason"), f"with {_R}, p as (select source, doc_id % 3 > 0 as p, reject_reason as r from j), c as (select source, r, count(*) as n from p where p and r is not null group by all) select source, count(*) as pool, count(*) filter (where p) as processed, count(*) filter (where p and r is null) as accepted, count(*) filter (where p and r is not null) as rejected, '{{' || coalesce((select string_agg('\"' || c.r || '\":' || c.n, ',' order by c.r) from c where c.source = p.source), '') || '}}' as reasons, printf('%.1f%%', count(*) filter (where p) * 100.0 / count(*)) as done from p group by source")
_add("bundle_summary", lambda s, d: c.bundle_summary(docs(s, d), "lang", "n_chars"), None)
_add("mixture_union", lambda s, d: c.mixture([(docs(s, d).withColumn("id", F.col("doc_id")), ["id", "text"]), (read(s, d, "benchmark").withColumn("id", F.col("item_id")), ["id", "text"])]).select("id", F.md5("text").alias("h")), "select doc_id as id, md5(text) as h from documents union all select item_id, md5(text) from benchmark")


def cases(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("input"), F.reverse(x).alias("output"))).alias("cases"))


_CASES = "c as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: struct_pack(i := x, o := reverse(x))) as cs from documents), x as (select doc_id, unnest(cs) as c, unnest(range(len(cs))) as i from c), y as (select doc_id, c, min(i) as i from x group by all), z as (select *, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by length(c.i) + length(c.o), i) - 1 as rk from y where length(c.i) + length(c.o) <= 600)"
_add("representative_cases", lambda s, d: c.prepared_cases(cases(s, d), "cases", 3, 300, 2).select("doc_id", F.array_join(F.transform("cases", lambda x: F.concat(x["input"], F.lit("|"), x["output"])), "~").alias("cases"), "selected_test_count").where("selected_test_count > 0"), f"with {_CASES} select doc_id, string_agg(c.i || '|' || c.o, '~' order by i) as cases, count(*) as selected_test_count from z where n <= 3 or rk in (0, round_even((n - 1) / 2.0::double, 0)::int, n - 1) group by doc_id")

# ------------------------------------------------------------------ rewards


def lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")


def _reward(column, name: str = "reward", places: int = 5):
    return lambda s, d: lines(s, d).groupBy("l_orderkey").agg(F.round(F.sum(column()), places).alias(name))


class _Columns:
    """Columns by attribute, made when they are used: modules are imported without a session."""

    def __getattr__(self, name: str):
        return F.col(name)


C = _Columns()
_sql = lambda e, places=5: f"select l_orderkey, round(sum({e}), {places}) as reward from lineitem group by l_orderkey"
_add("overlong_penalty", _reward(lambda: w.overlong_penalty(C.l_quantity, 40, 20)), _sql("case when l_quantity <= 20 then 0 when l_quantity <= 40 then (20 - l_quantity) / 20.0::double else -1 end"))
_add("soft_unit", _reward(lambda: w.soft_unit(C.l_discount, 0.02, 0.08)), _sql("(greatest(least(l_discount, 0.08::double), 0.02::double) - 0.02::double) / (0.08::double - 0.02::double)"))
_add("beta_cap", _reward(lambda: w.bounded_beta(2.0, F.floor(C.l_quantity))), _sql("case when floor(l_quantity) <= 0 then 0 else least(2.0::double / floor(l_quantity), (1 - 1e-6::double) / floor(l_quantity)) end"))
_add("composite_reward", _reward(lambda: w.composite(C.l_discount * 10, F.col("l_returnflag") == "N", C.l_tax * 10, C.l_quantity / 50, F.col("l_linenumber") > 2, 0.2, 0.1, 0.1, 0.5)), _sql("greatest(least(greatest(least(l_discount * 10, 1), 0) + case when l_returnflag = 'N' then 1 else 0.5::double end * 0.2::double * greatest(least(l_tax * 10, 1), 0) * case when l_linenumber > 2 then 1 else 0.3::double end + case when l_returnflag = 'N' then 1 else 0.5::double end * 0.1::double * greatest(least(l_quantity / 50, 1), 0) + 0.1::double * (l_returnflag = 'N')::int, 1), 0)"))
_add("iterative_priority", _reward(lambda: w.iterative_priority(C.l_discount * 5, C.l_tax - 0.03, F.lit(1.5))), _sql("greatest(greatest(1e-6::double, 4 * l_discount * 5 * (1 - l_discount * 5) + 0.1::double * greatest(0, l_tax - 0.03::double)) * 1.5::double, 1e-6::double)"))
_PRIOR_SQL = "case when l_quantity / 50 >= 0.7::double and l_discount * 10 >= 0.7::double then 0.4::double when l_quantity / 50 <= 0.3::double and l_discount * 10 <= 0.3::double and l_linenumber >= 3 then 0.2::double when l_discount * 10 - l_quantity / 50 >= 0.2::double then 1.0::double when l_quantity / 50 - l_discount * 10 >= 0.2::double then 0.7::double else 0.8::double end"
_add("prior_weight", _reward(lambda: w.prior_weight(C.l_quantity / 50, C.l_discount * 10, F.col("l_linenumber"))), _sql(_PRIOR_SQL))
_add("keep_probability", _reward(lambda: w.keep_probability(C.l_discount * 10, F.col("l_linenumber"), C.l_quantity - 5, per_step=0.01, most=0.3), places=7), _sql("case when l_linenumber <= 2 then greatest(0.05::double, least(1, l_discount * 10 + case when l_quantity >= 5 then least(0.3::double, (l_quantity - 5) * 0.01::double) else 0 end)) else greatest(0.1::double, least(1, pow(0.5::double, l_linenumber - 2) * l_discount * 10 + case when l_quantity >= 5 then least(0.3::double, (l_quantity - 5) * 0.01::double) else 0 end)) end", 7))
_add("density_weight", _reward(lambda: w.density_weight(C.l_discount * 9)), _sql("greatest(least(l_discount * 9 / (1 - l_discount * 9 + 1e-8::double), 10), 0.1::double)"))
_add("missing_eos", _reward(lambda: w.missing_eos(C.l_quantity, F.col("l_linenumber") > 3, 1.5)), _sql("case when l_linenumber > 3 then l_quantity else l_quantity - 1.5::double end"))
_add("ema_rate", _reward(lambda: w.ema_rate(C.l_quantity, 10, 2.0, 0.5, 0.15)), _sql("greatest(pow(10 + 2 * l_quantity, -0.5::double), 0.15::double)"))
_add("soft_win", _reward(lambda: w.soft_win(C.l_discount * 10, C.l_tax * 10, 0.5)), _sql("1 / (1 + exp((l_tax * 10 - l_discount * 10) / 0.5::double))"))
_verdicts = lambda: F.array(*[F.expr(f"int((l_linenumber + {k}) % 3 - 1)") if k else F.expr("int(l_linenumber > 1)") for k in range(3)])
_add("judge_combine", lambda s, d: lines(s, d).groupBy("l_linenumber").agg(F.max(w.judges(_verdicts())).alias("verdict")), "select l_linenumber, max(case when (l_linenumber + 1) % 3 = 0 or (l_linenumber + 2) % 3 = 0 then -1 when l_linenumber > 1 and (l_linenumber + 1) % 3 = 2 and (l_linenumber + 2) % 3 = 2 then 1 else 0 end) as verdict from lineitem group by 1")
_add("win_rate", lambda s, d: r.win_rate(lines(s, d).select((C.l_discount * 10).alias("s")), "s").select(F.round("win_rate", 6).alias("win_rate"), F.round("soft_win", 6).alias("soft_win")), "select round(avg((l_discount * 10 <= 0.5::double)::int), 6) as win_rate, round(1 - avg(l_discount * 10), 6) as soft_win from lineitem")
_add("hard_reward", lambda s, d: lines(s, d).groupBy("l_orderkey").agg(F.collect_list(F.col("l_returnflag") == "N").alias("p")).select("l_orderkey", F.round(w.hard_reward("p"), 6).alias("rate")), "select l_orderkey, round(avg((l_returnflag = 'N')::int), 6) as rate from lineitem group by 1")
_kind = lambda: F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_linenumber") == 1, "TIMEOUT").when(F.col("l_linenumber") == 2, "RUNTIME_ERROR").otherwise("WRONG")
_add("status_code", lambda s, d: lines(s, d).groupBy("l_orderkey").agg(F.collect_list(_kind()).alias("k")).select("l_orderkey", w.status_code("k").alias("status")), "with k as (select l_orderkey, case when l_returnflag = 'N' then 'P' when l_linenumber = 1 then 'T' when l_linenumber = 2 then 'R' else 'W' end as k from lineitem) select l_orderkey, case when bool_and(k = 'P') then 'CORRECT' when bool_or(k = 'T') then 'TIMEOUT' when bool_or(k = 'R') then 'RUNTIME_ERROR' else 'FAIL' end as status from k group by 1")

# ------------------------------------------------------------------ rollouts


def nodes(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.select("user_id", "event_id", "ts", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"), (F.col("event_type") == "purchase").cast("double").alias("rate"), (F.col("event_id") % 6 + 1).alias("round"))


_N = "n as (select user_id, event_id, ts, event_type, coalesce(value, 0) as value, (event_type = 'purchase')::int::double as rate, event_id % 6 + 1 as round from events)"
_add("pass_at_k", lambda s, d: r.pass_at_k(nodes(s, d), "user_id", "event_id", "rate", [1, 5, 10]), f"with {_N}, x as (select *, row_number() over (partition by user_id order by event_id) as i from n) select user_id, max((i <= 1 and rate >= 1)::int) as pass_at_1, max((i <= 5 and rate >= 1)::int) as pass_at_5, max((i <= 10 and rate >= 1)::int) as pass_at_10, max(rate) as best from x group by 1")
_add("cumulative_eval", lambda s, d: r.cumulative_eval(nodes(s, d), "user_id", "round", "rate", 6).select("user_id", "round", "best_within", "solved_within"), f"with {_N}, u as (select distinct user_id from n) select u.user_id, g.g as round, coalesce(max(rate), 0) as best_within, (coalesce(max(rate), 0) >= 1)::int as solved_within from u cross join range(1, 7) g(g) left join n on n.user_id = u.user_id and n.round <= g.g group by all")
_add("repeat_eval", lambda s, d: r.repeat_eval(nodes(s, d).withColumn("rep", F.col("event_id") % 4), "rep", ["rate", "value"]).select("metric", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")), f"with {_N}, m as (select event_id % 4 as rep, avg(rate) as rate, avg(value) as value from n group by 1) select 'rate' as metric, round(avg(rate), 5) as mean, round(stddev_pop(rate), 5) as std from m union all select 'value', round(avg(value), 5), round(stddev_pop(value), 5) from m")
_add("rollout_summary", lambda s, d: r.rollout_summary(nodes(s, d), "user_id", "value", "rate").select("user_id", "nodes", "zero_variance", "pair_equal", *[F.round(x, 5).alias(x) for x in ("mean_reward", "min_reward", "max_reward", "mean_pass", "best_pass", "pass_share", "zero_share")]), f"with {_N} select user_id, count(*) as nodes, stddev_pop(value) <= 1e-8 as zero_variance, count(*) = 2 and max(value) - min(value) < 1e-8 as pair_equal, round(avg(value), 5) as mean_reward, round(min(value), 5) as min_reward, round(max(value), 5) as max_reward, round(avg(rate), 5) as mean_pass, round(max(rate), 5) as best_pass, round(avg((rate >= 1)::int), 5) as pass_share, round(avg((abs(value) <= 1e-12)::int), 5) as zero_share from n group by 1")
_add("reward_window", lambda s, d: r.reward_window(nodes(s, d), "event_id", "value", 250).select("window", F.round("mean", 5).alias("mean"), "n", "upto"), f"with {_N} select ceil(event_id / 250.0::double)::bigint as \"window\", round(avg(value), 5) as mean, count(value) as n, max(event_id) as upto from n group by 1")
_add("ema_prior", lambda s, d: r.ema_prior(nodes(s, d), "user_id", ["ts", "event_id"], "rate", 0.8).select("user_id", F.round("ema", 6).alias("ema"), "seen"), f"with recursive {_N}, i as (select user_id, rate, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as c from n), f as (select user_id, i, c, rate as e from i where i = 1 union all select i.user_id, i.i, i.c, 0.8::double * f.e + 0.2::double * i.rate from f join i on i.user_id = f.user_id and i.i = f.i + 1) select user_id, round(e, 6) as ema, c as seen from f where i = c")
_add("no_pass_streak", lambda s, d: r.streak(nodes(s, d).withColumn("p", F.col("rate") >= 1), "user_id", ["ts", "event_id"], "p"), f"with {_N}, i as (select user_id, rate, row_number() over (partition by user_id order by ts desc, event_id desc) as i, count(*) over (partition by user_id) as c from n) select user_id, coalesce(min(i) filter (where rate >= 1) - 1, max(c)) as streak from i group by 1")
_add("iterative_pool", lambda s, d: r.pool(nodes(s, d), "event_id", 10000, 3000, 500, nodes(s, d).where("rate >= 1 and event_id > 9990"), "user_id").select("event_id", "user_id"), f"with {_N} select event_id, user_id from n where 10000 - event_id < 3000 and user_id not in (select user_id from n where rate >= 1 and event_id > 9990) order by event_id desc limit 500")
_add("running_moments", lambda s, d: r.running_moments(nodes(s, d), ["ts", "event_id"], "value", "user_id").select("event_id", F.round(F.col("mean") * 1.4142135623730951, 5).alias("mean"), F.round(F.col("std") * 1.4142135623730951, 3).alias("std"), "count"), f"with {_N} select event_id, round(avg(value) over w * 1.4142135623730951::double, 5) as mean, round(coalesce(stddev_samp(value) over w, 0) * 1.4142135623730951::double, 3) as std, count(value) over w as count from n window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
_add("last_best_metric", lambda s, d: r.last_best(nodes(s, d), "event_type", "event_id", "value"), f"with {_N} select event_type, arg_max(value, event_id) as last, max(value) as best from n group by 1")
_add("kl_mismatch", lambda s, d: r.kl_mismatch(read(s, d, "orders").withColumn("batch", F.floor(F.col("o_orderkey") / 64)), "batch", "o_orderkey", "o_totalprice").select("o_orderkey", "mismatched"), "select o_orderkey, coalesce(lag(o_totalprice) over w, last_value(o_totalprice) over (partition by o_orderkey // 64 order by o_orderkey rows between unbounded preceding and unbounded following)) as mismatched from orders window w as (partition by o_orderkey // 64 order by o_orderkey)")
_add("oracle_fifo_join", lambda s, d: r.fifo_join(read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), read(s, d, "customer").select((F.col("c_custkey") % 700).alias("k"), "c_custkey", "c_name"), "k", "o_orderkey", "c_custkey", "c_name").select("o_orderkey", "c_name"), "with a as (select o_orderkey, o_custkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), b as (select c_custkey % 700 as k, c_name, row_number() over (partition by c_custkey % 700 order by c_custkey) as n from customer) select o_orderkey, c_name from a left join b using (k, n)")
_WORDS = lambda s, d, lang: docs(s, d).where(F.col("lang") == lang).select(F.explode(F.split("text", " ")).alias("token")).distinct().withColumn(f"{lang}_id", F.length("token"))
_add("vocab_map", lambda s, d: r.vocabulary_map(_WORDS(s, d, "en"), _WORDS(s, d, "de"), "token", "en_id", "de_id"), "with w as (select distinct lang, unnest(string_split(text, ' ')) as token from documents where lang in ('en', 'de')) select token, length(max(case when lang = 'en' then token end)) as en_id, length(max(case when lang = 'de' then token end)) as de_id from w group by token")
