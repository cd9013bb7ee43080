"""Token preparation, batch metrics and code problems over the driver's tables: words' lengths are token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import prepare as p
from lodestone.operators import metrics, problems
from lodestone.plans.token_queries import ids
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def split(s: SparkSession, d: str) -> DataFrame:
    """Each document's ids as a prompt (the first third) and a completion."""
    third = F.floor(F.size("ids") / 3).cast("int")
    rows = ids(s, d).withColumn("n", third)
    return rows.select("doc_id", "ids", F.expr("slice(ids, 1, n)").alias("a"), F.expr("slice(ids, n + 1, size(ids))").alias("b"))


_S = "w as (select doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) as ids from documents), s as (select doc_id, ids, ids[1:len(ids) // 3] as a, ids[len(ids) // 3 + 1:] as b from w)"
_digest = lambda c: F.md5(F.array_join(c, ","))


_add(
    "completion_mask", lambda s, d: split(s, d).withColumn("m", p.completion_mask("a", "ids")).select("doc_id", _digest("m").alias("mask"), p.is_prefix("a", "ids").alias("prefix")),
    f"with {_S} select doc_id, md5(array_to_string(list_concat(list_transform(a, lambda x: 0), list_transform(b, lambda x: 1)), ',')) as mask, true as prefix from s",
)
_add(
    "chat_collation", lambda s, d: split(s, d).select("doc_id", *[_digest(c).alias(n) for n, c in zip(("ids", "labels"), p.collated("a", "b", 200), strict=True)]),
    f"with {_S} select doc_id, md5(array_to_string(ids[greatest(len(ids) - 199, 1):], ',')) as ids, md5(array_to_string(list_concat(list_transform(a, lambda x: -100), b)[greatest(len(ids) - 199, 1):], ',')) as labels from s",
)
_add(
    "begin_end_tokens", lambda s, d: ids(s, d).withColumn("x", p.with_bos("ids", 3)).select("doc_id", F.size("x").alias("with_bos"), F.size(p.with_eos("x", 4)).alias("with_both")),
    f"with {_S}, b as (select doc_id, len(ids) + (ids[1] <> 3)::int as n, ids[-1] as z from s) select doc_id, n as with_bos, n + (z <> 4)::int as with_both from b",
)
_add(
    "after_stop", lambda s, d: ids(s, d).select("doc_id", _digest(p.after_stop("ids", 9, 0)).alias("ids"), F.aggregate(p.after_stop_mask("ids", 9), F.lit(0), lambda x, y: x + y).alias("n")),
    f"with {_S}, k as (select doc_id, ids, coalesce(nullif(list_position(ids, 9), 0), len(ids)) as k from s) select doc_id, md5(array_to_string(list_concat(ids[1:k], list_transform(ids[k + 1:], lambda x: 0)), ',')) as ids, k as n from k",
)
_add(
    "completion_start", lambda s, d: ids(s, d).withColumn("o", F.expr("transform(ids, (x, i) -> named_struct('s', 5 * i))")).select("doc_id", p.completion_start("o", "1000").alias("start")),
    f"with {_S} select doc_id, least(len(ids), 200) as start from s",
)
_add(
    "token_accuracy", lambda s, d: split(s, d).select("doc_id", *[c.alias(n) for n, c in zip(("right", "unmasked"), p.matches("reverse(ids)", "transform(ids, x -> if(x > 6, -100, x))"), strict=True)]),
    f"with {_S}, x as (select doc_id, unnest(ids) as x, unnest(list_reverse(ids)) as y from s) select doc_id, count(*) filter (where x <= 6 and x = y) as right, count(*) filter (where x <= 6) as unmasked from x group by doc_id",
)
_LOGPS = "transform(ids, x -> -double(x) / 4)"
_MASKED = "transform(ids, x -> if(x > 6, -100, x))"
_add(
    "sequence_logp", lambda s, d: ids(s, d).withColumns({"lp": F.expr(_LOGPS), "l": F.expr(_MASKED)}).select("doc_id", F.round(p.sequence_logp("lp", "l"), 5).alias("total"), F.round(p.sequence_logp("lp", "l", True), 5).alias("mean")),
    f"with {_S}, x as (select doc_id, unnest(ids) as x from s) select doc_id, coalesce(round(sum(-x / 4.0::double) filter (where x <= 6), 5), 0) as total, round(avg(-x / 4.0::double) filter (where x <= 6), 5) as mean from x group by doc_id",
)


def rectified_loss(s: SparkSession, d: str) -> DataFrame:
    top, n = p.rectified_terms("lp", "l")
    rows = ids(s, d).withColumns({"lp": F.expr(_LOGPS), "l": F.expr(_MASKED)}).select("batch", top.alias("t"), n.alias("n"))
    return rows.groupBy("batch").agg(F.round(F.sum("t") / F.sum("n"), 6).alias("loss"))


_add(
    "rectified_loss", rectified_loss,
    "with x as (select doc_id // 100 as batch, length(unnest(string_split(text, ' '))) as x from documents) select batch, round(sum(exp(-x / 4.0::double) * x / 4.0::double) filter (where x <= 6) / count(*) filter (where x <= 6), 6) as loss from x group by batch",
)
_add(
    "code_truncation", lambda s, d: ids(s, d).select("doc_id", *[c.alias(n) for n, c in zip(("n", "ok"), (F.size(p.cut_code("ids", 300, "doc_id % 2 = 0")[0]), p.cut_code("ids", 300, "doc_id % 2 = 0")[1]), strict=True)]),
    f"with {_S} select doc_id, least(len(ids), 300) as n, doc_id % 2 = 0 and len(ids) <= 300 as ok from s",
)
_add(
    "shared_prefix", lambda s, d: split(s, d).select("doc_id", p.shared_prefix("a", "b").alias("n")),
    f"with {_S}, x as (select doc_id, len(a) as n, unnest(a) as x, unnest(b[1:len(a)]) as y, unnest(range(len(a))) as i from s where len(a) > 0) select s.doc_id, coalesce(min(i) filter (where x <> y), len(s.a)) as n from s left join x using (doc_id) group by s.doc_id, len(s.a)",
)

# ------------------------------------------------------------------ metrics


def lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").withColumns({"done": F.col("l_returnflag") == "N", "label": F.col("l_orderkey") % 3 == 0})


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


_add(
    "completion_lengths", lambda s, d: _rounded(metrics.completion_lengths(lines(s, d), ["l_suppkey"], F.col("l_quantity"), F.col("done")), "l_suppkey"),
    "select l_suppkey, round(avg(l_quantity), 6) as mean_length, min(l_quantity) as min_length, max(l_quantity) as max_length, round(avg((l_returnflag <> 'N')::int), 6) as clipped_ratio, coalesce(round(avg(l_quantity) filter (where l_returnflag = 'N'), 6), 0) as mean_terminated, coalesce(min(l_quantity) filter (where l_returnflag = 'N'), 0) as min_terminated, coalesce(max(l_quantity) filter (where l_returnflag = 'N'), 0) as max_terminated from lineitem group by 1",
)
_add(
    "tool_frequency", lambda s, d: _rounded(metrics.tool_frequency(lines(s, d).withColumns({"calls": F.col("l_linenumber") % 3, "bad": (F.col("l_linenumber") % 3 == 2).cast("int")}), ["l_orderkey"], "calls", "bad"), "l_orderkey"),
    "select l_orderkey, round(sum(l_linenumber % 3) / count(*), 6) as call_frequency, case when sum(l_linenumber % 3) > 0 then round(sum((l_linenumber % 3 = 2)::int) / sum(l_linenumber % 3), 6) else 0 end as failure_frequency from lineitem group by 1",
)
_add(
    "pair_accuracy", lambda s, d: _rounded(metrics.pair_accuracy(lines(s, d), ["l_suppkey"], "l_discount", "l_tax"), "l_suppkey"),
    "select l_suppkey, round(avg((l_discount > l_tax)::int) filter (where l_discount <> l_tax), 6) as accuracy, count(*) filter (where l_discount = l_tax) as ties from lineitem group by 1",
)
_add(
    "label_sums", lambda s, d: _rounded(metrics.label_sums(lines(s, d), ["l_suppkey"], "label", ["l_tax"]), "l_suppkey"),
    "select l_suppkey, count(*) filter (where l_orderkey % 3 = 0) as count_chosen, count(*) filter (where l_orderkey % 3 <> 0) as count_rejected, coalesce(round(sum(l_tax) filter (where l_orderkey % 3 = 0), 6), 0) as l_tax_chosen, coalesce(round(sum(l_tax) filter (where l_orderkey % 3 <> 0), 6), 0) as l_tax_rejected from lineitem group by 1",
)
_add(
    "split_sum_means", lambda s, d: _rounded(metrics.split_sum_means(metrics.label_sums(lines(s, d), ["l_suppkey"], "label", ["l_tax"]), "l_tax")),
    "with m as (select avg(l_tax) filter (where l_orderkey % 3 = 0) as a, avg(l_tax) filter (where l_orderkey % 3 <> 0) as b from lineitem) select round(a, 6) as chosen, round(b, 6) as rejected, round(a - b, 6) + 0.0 as margin from m",
)
_add(
    "sequence_policy_loss", lambda s, d: _rounded(metrics.sequence_policy_loss(lines(s, d), ["l_suppkey"], F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber") - 3), "l_suppkey"),
    "with r as (select l_suppkey, exp(l_discount * 10 - l_tax * 10) as r, l_linenumber - 3 as a from lineitem) select l_suppkey, round(avg(-least(r * a, greatest(least(r, 1.2::double), 0.8::double) * a)), 6) + 0.0 as loss, round(avg((r < 0.8::double and a < 0)::int), 6) as low, round(avg((r > 1.2::double and a > 0)::int), 6) as high, round(avg((r < 0.8::double and a < 0 or r > 1.2::double and a > 0)::int), 6) as region from r group by 1",
)
_add(
    "averaged_logs", lambda s, d: _rounded(metrics.averaged_logs(read(s, d, "events"), "event_id", 500, "event_type", "value", True), "flush", "key"),
    "select ceil(event_id / 500.0::double)::bigint as flush, 'eval_' || event_type as key, round(avg(value), 6) + 0.0 as mean from events group by 1, 2",
)
_add(
    "prior_summary", lambda s, d: _rounded(metrics.prior_summary(lines(s, d).withColumns({"c": F.col("l_discount") * 10, "r": F.col("l_tax") * 12, "k": F.col("l_linenumber") - 1}), "c", "r", "l_quantity", "k")),
    """select round(avg(l_discount * 10), 6) as code, round(avg(l_tax * 12), 6) as reason, round(avg(l_quantity), 6) as weight,
    count(*) filter (where l_tax * 12 >= 0.7::double and l_discount * 10 <= 0.3::double) as high_value, count(*) filter (where l_tax * 12 <= 0.3::double and l_discount * 10 <= 0.3::double) as low_value,
    count(*) as seen from lineitem where l_linenumber > 1""",
)


def batches(s: SparkSession, d: str) -> DataFrame:
    """Lines as samples: an order is a rollout, a supplier's a batch; resamples are told by the order."""
    return lines(s, d).withColumns({"adv": F.col("l_linenumber") - 2, "again": F.col("l_orderkey") % 4})


_add(
    "batch_metrics", lambda s, d: _rounded(metrics.batch_metrics(batches(s, d), ["l_suppkey"], "l_orderkey", "l_tax", "l_discount", "adv", F.col("done"), "again"), "l_suppkey"),
    """with r as (select l_suppkey, l_orderkey, avg(l_tax) as m, avg(l_discount) as p, stddev_pop(l_tax) as s, count(*) as n from lineitem group by 1, 2),
    a as (select l_suppkey, avg(m) as m, avg(p) as p, avg(s) as s, sum(n) as n, sum(l_orderkey % 4) as again from r group by 1)
    select l_suppkey, round(any_value(m), 6) as mean_reward, round(any_value(p), 6) as mean_rate, round(any_value(s), 6) as std_reward, any_value(n)::bigint as nodes, any_value(again)::bigint as resamples,
    min(l_tax) as min_reward, max(l_tax) as max_reward, min(l_discount) as min_rate, max(l_discount) as max_rate, round(avg((l_linenumber = 2)::int), 6) as zero_advantage,
    round(count(*) filter (where l_returnflag <> 'N') / nullif(count(*) filter (where l_returnflag = 'N'), 0), 6) as aux_per_main from lineitem join a using (l_suppkey) group by 1""",
)

# ------------------------------------------------------------------ code problems


def raw_problems(s: SparkSession, d: str) -> DataFrame:
    """Documents as problems: the lines are inputs, all but the first the outputs, the source a function's name for some."""
    lines_ = F.split("text", "\n")
    return read(s, d, "documents").select(
        "doc_id", F.col("text").alias("prompt"), lines_.alias("i"), F.slice(lines_, F.lit(2), F.greatest(F.size(lines_) - 1, F.lit(0))).alias("o"),
        F.array(F.when(F.col("doc_id") % 4 > 0, F.col("text"))).alias("s"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("fn"),
    )


def problem_reasons(s: SparkSession, d: str) -> DataFrame:
    rows = raw_problems(s, d).withColumns({"cases": problems.paired_cases("i", "o"), "solutions": problems.python_solutions("s")})
    return problems.normalised(rows, "prompt", "cases", "solutions", "fn", 5, 2000, 2).select("doc_id", "reject_reason", "source_test_count")


_add(
    "problem_reasons", problem_reasons,
    "with l as (select doc_id, text, source, string_split(text, chr(10)) as l from documents), c as (select doc_id, unnest(l[1:len(l) - 1]) as i, unnest(l[2:]) as o from l where len(l) > 1), n as (select doc_id, count(distinct (i, o)) as n from c group by 1) select doc_id, case when doc_id % 5 = 0 and source <> '' then 'non_stdio_task' when n is null then 'missing_tests' when regexp_replace(text, '\\s+', '', 'g') = '' then 'missing_prompt' when doc_id % 4 = 0 then 'missing_python_reference_solution' end as reject_reason, coalesce(n, 0) as source_test_count from l left join n using (doc_id)",
)
_add(
    "corpus_reasons", lambda s, d: raw_problems(s, d).select("doc_id", problems.corpus_reason(F.col("prompt"), F.col("prompt"), F.size("i"), F.length("prompt"), 3000, 2).alias("reason")),
    "select doc_id, case when length(text) > 3000 then 'prompt_too_long' when contains(lower(text), 'interactive') or contains(lower(text), 'flush') or contains(lower(text), 'hacked interaction') then 'interactive_task' when contains(lower(text), 'input.txt') or contains(lower(text), 'output.txt') or contains(lower(text), 'read from file') or contains(lower(text), 'write to file') or contains(lower(text), 'file input') or contains(lower(text), 'file output') then 'file_io_task' when len(string_split(text, chr(10))) < 2 then 'too_few_tests' when regexp_matches(text, '(^|\\n)\\s*(import|from)\\s+(numpy|pandas|scipy|torch|tensorflow|sklearn|requests)\\b') then 'disallowed_imports' end as reason from documents",
)
_add(
    "expected_output", lambda s, d: raw_problems(s, d).withColumn("c", problems.paired_cases("i", "o")).select("doc_id", F.md5(problems.expected_output("c", "i[0]")).alias("h")),
    "with l as (select doc_id, string_split(text, chr(10)) as l from documents) select doc_id, case when len(l) > 1 then md5(l[2]) end as h from l",
)
