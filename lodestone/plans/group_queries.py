"""Queries of group statistics over the driver's tables: an order is a prompt and its lines are samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import groups as g
from lodestone.sources.tables import read

REWARDS, WEIGHTS = ("r1", "r2", "r3"), (1.0, 0.5, 0.02)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    quantity = F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_discount").alias("r1"), F.col("l_tax").alias("r2"), quantity.alias("r3"))


_LINES = "lines as (select l_orderkey, l_partkey, l_linenumber, l_discount as r1, l_tax as r2, case when l_returnflag <> 'N' then l_quantity end as r3, coalesce(l_discount, 0) + 0.5::double * coalesce(l_tax, 0) + 0.02::double * coalesce(case when l_returnflag <> 'N' then l_quantity end, 0) as reward from lineitem)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _advantage(scale: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = g.group_advantage(_lines(spark, d), REWARDS, WEIGHTS, "l_orderkey", scale)
        return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round("reward", 6).alias("reward"), (F.round("advantage", 7 if scale == "none" else 4) + 0.0).alias("advantage"), "is_std_zero")

    return run


def _advantage_sql(scale: str) -> str:
    std = "(select coalesce(stddev_samp(reward), 0) from lines)" if scale == "batch" else "coalesce(stddev_samp(reward) over (partition by l_orderkey), 0)"
    centred = "reward - avg(reward) over (partition by l_orderkey)"
    formula = f"({centred})" if scale == "none" else f"({centred}) / (std + 1e-4)"
    return f"with {_LINES}, s as (select *, {std} as std from lines) select l_orderkey, l_partkey, l_linenumber, round(reward, 6) as reward, round({formula}, {7 if scale == "none" else 4}) + 0.0 as advantage, abs(std) <= 1e-8 as is_std_zero from s"


def normalize_then_sum(spark: SparkSession, d: str) -> DataFrame:
    out = g.normalize_then_sum(_lines(spark, d), REWARDS, WEIGHTS, "l_orderkey")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", (F.round("advantage", 4) + 0.0).alias("advantage"))


def _code(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return g.code_advantage(_lines(spark, d), "r1", "l_orderkey", mode).select("l_orderkey", "l_partkey", "l_linenumber", (F.round("advantage", 4 if mode == "zscore" else 7) + 0.0).alias("advantage"))

    return run


def _code_sql(mode: str) -> str:
    formula = {"zscore": "(r1 - m) / (s + 1e-8)", "mean_only": "r1 - m", "sign": "case when n <> 2 then r1 - m when s <= 1e-8 then 0 else sign(r1 - m) end"}[mode]
    return f"with s as (select l_orderkey, l_partkey, l_linenumber, l_discount as r1, avg(l_discount) over w as m, stddev_pop(l_discount) over w as s, count(*) over w as n from lineitem window w as (partition by l_orderkey)) select l_orderkey, l_partkey, l_linenumber, round({formula}, {4 if mode == "zscore" else 7}) + 0.0 as advantage from s"


def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("r"), (F.col("o_orderkey") % 7 / 7.0).alias("kl"))
    return g.leave_one_out(rows, "r", "kl", "o_custkey", 0.05, (0.0, 300.0)).select("o_orderkey", "o_custkey", (F.round("advantage", 5) + 0.0).alias("advantage"))


def group_topk_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = g.top_in_group(_orders(spark, d), "o_custkey", "o_totalprice", "o_orderkey", 3)
    out = g.group_advantage(kept, ["o_totalprice"], [1.0], "o_custkey")
    return out.select("o_orderkey", "o_custkey", (F.round("advantage", 4) + 0.0).alias("advantage"))


def replay_buffer_topn(spark: SparkSession, d: str) -> DataFrame:
    return g.replay_top(_orders(spark, d), "o_totalprice", "o_orderkey", 100).select("o_orderkey", "o_totalprice")


def replay_score(spark: SparkSession, d: str) -> DataFrame:
    out = g.group_advantage(_lines(spark, d), REWARDS, WEIGHTS, "l_orderkey")
    return g.replay_score(out, "l_orderkey", "advantage", "reward").select("l_orderkey", F.round("replay_score", 4).alias("replay_score"), "replace")


def candidate_picks(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("p"), "o_totalprice", (F.col("o_orderkey") % 11).alias("raw"), (F.col("o_orderkey") % 3).alias("norm"))
    return g.candidate_picks(rows, "o_custkey", "o_orderkey", "p", "o_totalprice", "raw", "norm", 4).select("o_custkey", "o_orderkey", "pick", "reason")


def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return g.weighted_sample(read(spark, d, "documents"), "n_chars", "doc_id", 50, 3).select("doc_id", "n_chars")


def repeat_sampler(spark: SparkSession, d: str) -> DataFrame:
    parts = g.numbered(read(spark, d, "part").select("p_partkey"), "p_partkey", name="n")
    return g.repeat_sampler(parts, "n", 2, 7, 3).select("n", "p_partkey", "batch", "repeat", "copy")


def nan_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _lines(spark, d).groupBy("l_orderkey").agg(F.coalesce(F.sum("r3"), F.lit(0.0)).alias("s"), F.avg("r3").alias("m"), F.stddev_samp("r3").alias("sd"), F.min("r3").alias("lo"), F.max("r3").alias("hi"), F.coalesce(F.avg("r1"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("r1"), F.lit(0.0)).alias("pop"))
    return out.select("l_orderkey", *[F.round(c, 5).alias(c) for c in ("s", "m", "sd", "lo", "hi", "mean", "pop")])


def reward_stats(spark: SparkSession, d: str) -> DataFrame:
    out = g.group_advantage(_lines(spark, d), REWARDS, WEIGHTS, "l_orderkey")
    plain = g.weighted_sum(REWARDS, (1.0, 1.0, 1.0))
    return out.agg(*[F.round(f(c), 5).alias(f"{n}_{c}") for c in REWARDS for n, f in (("mean", F.avg), ("std", F.stddev_samp))], F.round(F.avg(plain), 4).alias("reward"), F.round(F.avg(F.col("is_std_zero").cast("int")), 6).alias("frac_std_zero"))


QUERIES = {
    "group_advantage": _advantage("group"), "group_advantage_batch": _advantage("batch"), "group_advantage_none": _advantage("none"), "normalize_then_sum": normalize_then_sum,
    "code_advantage_zscore": _code("zscore"), "code_advantage_sign": _code("sign"), "code_advantage_mean_only": _code("mean_only"), "leave_one_out": leave_one_out,
    "group_topk_filter": group_topk_filter, "replay_buffer_topn": replay_buffer_topn, "replay_score": replay_score, "candidate_picks": candidate_picks,
    "weighted_sample": weighted_sample, "repeat_sampler": repeat_sampler, "nan_stats": nan_stats, "reward_stats": reward_stats,
}

_GROUP = f"with {_LINES}, s as (select *, coalesce(stddev_samp(reward) over (partition by l_orderkey), 0) as std, avg(reward) over (partition by l_orderkey) as mean from lines)"
ORACLES = {
    "group_advantage": _advantage_sql("group"), "group_advantage_batch": _advantage_sql("batch"), "group_advantage_none": _advantage_sql("none"),
    "normalize_then_sum": "with l as (select l_orderkey, l_partkey, l_linenumber, l_discount as r1, l_tax as r2, case when l_returnflag <> 'N' then l_quantity end as r3 from lineitem), z as (select *, coalesce((r1 - avg(r1) over w) / (stddev_samp(r1) over w + 1e-4), 0) + coalesce(0.5::double * (r2 - avg(r2) over w) / (stddev_samp(r2) over w + 1e-4), 0) + coalesce(0.02::double * (r3 - avg(r3) over w) / (stddev_samp(r3) over w + 1e-4), 0) as z from l window w as (partition by l_orderkey)) select l_orderkey, l_partkey, l_linenumber, round((z - (select avg(z) from z)) / ((select stddev_samp(z) from z) + 1e-4), 4) + 0.0 as advantage from z",
    "code_advantage_zscore": _code_sql("zscore"), "code_advantage_sign": _code_sql("sign"), "code_advantage_mean_only": _code_sql("mean_only"),
    "leave_one_out": "with r as (select o_orderkey, o_custkey, greatest(least(o_totalprice / 1000, 300), 0) - 0.05::double * (o_orderkey % 7 / 7.0::double) as r from orders), s as (select *, count(*) over w as n, sum(r) over w as t from r window w as (partition by o_custkey)) select o_orderkey, o_custkey, round(case when n > 1 then r - (t - r) / (n - 1) else 0 end, 5) + 0.0 as advantage from s",
    "group_topk_filter": "with k as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders), t as (select o_orderkey, o_custkey, o_totalprice as r from k where rn <= 3) select o_orderkey, o_custkey, round((r - avg(r) over w) / (coalesce(stddev_samp(r) over w, 0) + 1e-4), 4) + 0.0 as advantage from t window w as (partition by o_custkey)",
    "replay_buffer_topn": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100",
    "replay_score": f"{_GROUP} select l_orderkey, round(sum(abs((reward - mean) / (std + 1e-4))) * max(std), 4) as replay_score, max(std) <= 1e-8 as replace from s group by l_orderkey",
    "candidate_picks": "with c as (select o_orderkey, o_custkey, case when o_orderstatus = 'F' then 1 else 0 end as p, o_totalprice as f, o_orderkey % 11 as raw, o_orderkey % 3 as nrm from orders), a as (select *, row_number() over (partition by o_custkey order by p desc, f desc, o_orderkey) = 1 as one from c), b as (select *, not one and row_number() over (partition by o_custkey order by one, raw desc, nrm desc, f desc, o_orderkey) = 1 as two from a), r as (select *, row_number() over (partition by o_custkey order by case when one then 0 when two then 1 else 2 end, f desc, o_orderkey) as pick from b) select o_custkey, o_orderkey, pick, case when one then 'best_pass' when two then 'best_soft' else 'fallback' end as reason from r where pick <= 4",
    "weighted_sample": "select doc_id, n_chars from documents order by -ln((('0x' || substr(md5('3|' || doc_id), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double) / greatest(n_chars::double, 1e-6), doc_id limit 50",
    "repeat_sampler": "with n as (select p_partkey, row_number() over (order by p_partkey) - 1 as n from part), f as (select count(*) // 7 as full_ from part) select n, p_partkey, n // 7 as batch, r.r as repeat, c.c as copy from n, f, range(3) r(r), range(2) c(c) where n // 7 < full_",
    "nan_stats": "select l_orderkey, round(coalesce(sum(q), 0), 5) as s, round(avg(q), 5) as m, round(stddev_samp(q), 5) as sd, round(min(q), 5) as lo, round(max(q), 5) as hi, round(avg(l_discount), 5) as mean, round(stddev_pop(l_discount), 5) as pop from (select *, case when l_returnflag <> 'N' then l_quantity end as q from lineitem) group by l_orderkey",
    "reward_stats": f"{_GROUP} select round(avg(r1), 5) as mean_r1, round(stddev_samp(r1), 5) as std_r1, round(avg(r2), 5) as mean_r2, round(stddev_samp(r2), 5) as std_r2, round(avg(r3), 5) as mean_r3, round(stddev_samp(r3), 5) as std_r3, round(avg(coalesce(r1, 0) + coalesce(r2, 0) + coalesce(r3, 0)), 4) as reward, round(avg(case when abs(std) <= 1e-8 then 1 else 0 end), 6) as frac_std_zero from s",
}
