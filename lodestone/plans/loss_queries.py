"""Losses over the driver's tables: line items scaled to log-probabilities are pairs, embeddings are token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import losses as x
from lodestone.sources.tables import read

_KEYS = ("l_returnflag", "l_linestatus")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem")
    c = {"c": -(F.col("l_discount") * 10 + F.col("l_tax")), "r": -(F.col("l_tax") * 10), "rc": -(F.col("l_quantity") / 10), "rr": -(F.col("l_extendedprice") / 20000)}
    return t.select(*_KEYS, F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *[v.alias(k) for k, v in c.items()]).withColumns({"cs": F.col("c") - F.col("rc"), "rs": F.col("r") - F.col("rr"), "label": F.col("k") % 3 == 0})


_PAIRS = "with q as (select l_returnflag, l_linestatus, l_orderkey as k, l_linenumber as n, -(l_discount * 10 + l_tax) as c, -(l_tax * 10) as r, -(l_quantity / 10) as rc, -(l_extendedprice / 20000) as rr from lineitem), p as (select *, c - rc as cs, r - rr as rs, k % 3 = 0 as label, 0.1::double * ((c - rc) - (r - rr)) as z from q)"
_LS = "(-ln(1 + exp(-({0}))))"  # log-sigmoid, plain
_S = "(1 / (1 + exp(-({0}))))"
ls, sg = _LS.format, _S.format


def _mean(column):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return pairs(spark, d).groupBy(*_KEYS).agg(F.round(F.avg(column()), 6).alias("loss"))

    return run


def _mean_sql(formula: str) -> str:
    return f"{_PAIRS} select l_returnflag, l_linestatus, round(avg({formula}), 6) as loss from p group by all"


class _Columns:
    """Columns by attribute, made when they are used: modules are imported without a session."""

    def __getattr__(self, name: str):
        return F.col(name)


C = _Columns()
_PREFERENCE_SQL = {
    "sigmoid": f"-{ls('z')}", "hinge": "greatest(1 - z, 0)", "ipo": "pow(cs / greatest(n, 1) - rs / greatest(n + 1, 1) - 5, 2)",
    "exo_pair": f"{sg('z')} * ({ls('z')} - ln(0.9::double)) + {sg('-z')} * ({ls('-z')} - ln(0.1::double))",
    "nca_pair": f"-{ls('0.1::double * cs')} - 0.5::double * {ls('-0.1::double * cs')} - 0.5::double * {ls('-0.1::double * rs')}",
    "robust": f"(-0.9::double * {ls('z')} + 0.1::double * {ls('-z')}) / 0.8::double", "bco_pair": f"-{ls('0.1::double * cs')} - {ls('-0.1::double * rs')}",
    "sppo_hard": "pow(cs - 5, 2) + pow(rs + 5, 2)", "apo_zero": f"1 - {sg('0.1::double * cs')} + {sg('0.1::double * rs')}", "apo_down": f"{sg('0.1::double * cs')} + 1 - {sg('z')}",
    "discopop": f"-{ls('z')} * (1 - {sg('z / 0.05::double')}) + exp(-z) * {sg('z / 0.05::double')}",
}
QUERIES, ORACLES = {}, {}
for _kind, _sql in _PREFERENCE_SQL.items():
    QUERIES[f"pref_loss_{_kind}"] = _mean(lambda k=_kind: x.preference_loss(k, C.cs, C.rs, 0.1, 0.1, C.n, C.n + 1))
    ORACLES[f"pref_loss_{_kind}"] = _mean_sql(_sql)
for _kind, _sql in {"reverse_kl": "cs", "forward_kl": "-exp(-cs)", "js_divergence": ls("cs"), "alpha_divergence": "exp(least(cs * -0.5::double, 80)) * -2"}.items():
    QUERIES[f"divergence_{_kind}"] = _mean(lambda k=_kind: x.divergence_scores(k, C.cs))
    ORACLES[f"divergence_{_kind}"] = _mean_sql(_sql)
for _kind, _sql in {"sigmoid": f"-{ls('0.1::double * (c - r)')} * 0.9::double - {ls('-0.1::double * (c - r)')} * 0.1::double", "hinge": "greatest(1 - 0.1::double * (c - r), 0)", "ipo": "pow(c - r - 5, 2)", "simpo": f"-{ls('0.1::double * (c - r - 5)')} * 0.9::double - {ls('-0.1::double * (c - r - 5)')} * 0.1::double"}.items():
    QUERIES[f"cpo_loss_{_kind}"] = _mean(lambda k=_kind: x.cpo_loss(k, C.c, C.r, 0.1, 0.1))
    ORACLES[f"cpo_loss_{_kind}"] = _mean_sql(_sql)
QUERIES["alpha_transform"] = _mean(lambda: x.alpha_transform(C.c / 10, 0.25))
ORACLES["alpha_transform"] = _mean_sql("(1 - exp(-0.25::double * c / 10)) / 0.25::double")
QUERIES["orpo_loss"] = _mean(lambda: -x.orpo_terms(C.c - 0.01, C.r - 0.01)[1] * 0.1)
ORACLES["orpo_loss"] = _mean_sql(f"-0.1::double * {ls('(c - r) - (ln(1 - exp(c - 0.01::double)) - ln(1 - exp(r - 0.01::double)))')}")
QUERIES["reward_model_loss"] = _mean(lambda: x.reward_model_loss(C.cs, C.rs, F.lit(0.3), 0.01))
ORACLES["reward_model_loss"] = _mean_sql(f"-{ls('cs - rs - 0.3::double')} + 0.01::double * pow(cs + rs, 2)")
QUERIES["xpo_loss"] = _mean(lambda: x.xpo_loss(C.cs, C.rs, C.c, 0.1, 0.001))
ORACLES["xpo_loss"] = _mean_sql(f"-{ls('z')} + 0.001::double * c")
QUERIES["nash_md"] = _mean(lambda: x.nash_md_loss("array(c, r)", "array(rc, rr)", x.sigmoid(C.r), 0.1))
ORACLES["nash_md"] = _mean_sql(f"0.1::double * ((c - rc) * c + (r - rr) * r) - ({sg('r')} - 0.5::double) * (c + r)")
QUERIES["xpo_loss_ipo"] = _mean(lambda: x.xpo_loss(C.cs, C.rs, C.c, 0.1, 0.001, "ipo"))
ORACLES["xpo_loss_ipo"] = _mean_sql("pow(cs - rs - 5, 2) + 0.001::double * c")
QUERIES["ppo_policy_loss"] = _mean(lambda: x.ppo_policy_loss(C.c, C.r, C.cs, 0.2))
ORACLES["ppo_policy_loss"] = _mean_sql("greatest(-cs * exp(c - r), -cs * greatest(least(exp(c - r), 1.2::double), 0.8::double))")
QUERIES["ppo_value_loss"] = _mean(lambda: x.ppo_value_loss(C.c, C.r, C.cs, 0.2))
ORACLES["ppo_value_loss"] = _mean_sql("0.5::double * greatest(pow(c - cs, 2), pow(greatest(least(c, r + 0.2::double), r - 0.2::double) - cs, 2))")
for _kind, _sql in {"k1": "c - r", "k3": "exp(r - c) - 1 - (r - c)"}.items():
    QUERIES[f"kl_{_kind}"] = _mean(lambda k=_kind: x.kl_estimate(k, C.c, C.r))
    ORACLES[f"kl_{_kind}"] = _mean_sql(_sql)


def kto_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("batch", F.floor(F.col("k") / 100))
    kl = x.batch_kl(F.col("rs"), Window.partitionBy("batch"))
    rows = rows.withColumn("kl", kl)
    both = {kind: F.round(F.avg(x.kto_loss(kind, C.cs, C.label, F.col("kl"), 0.1, 1.0, 1.3)), 6).alias(kind) for kind in ("kto", "apo_zero_unpaired")}
    return rows.groupBy("batch").agg(*both.values())


QUERIES["kto_loss"] = kto_loss
ORACLES["kto_loss"] = f"{_PAIRS}, b as (select *, k // 100 as batch, greatest(avg(rs) over (partition by k // 100), 0) as kl from p) select batch, round(avg(case when label then 1 - {sg('0.1::double * (cs - kl)')} else 1.3::double * (1 - {sg('0.1::double * (kl - cs)')}) end), 6) as kto, round(avg(case when label then 1 - {sg('0.1::double * cs')} else 1.3::double * {sg('0.1::double * cs')} end), 6) as apo_zero_unpaired from b group by batch"


def bco_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("batch", F.floor(F.col("k") / 100))
    means = rows.groupBy("batch").agg(F.avg(0.1 * F.col("cs")).alias("m"))
    running = means.withColumn("delta", F.avg("m").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(running, "batch").groupBy("batch").agg(F.round(F.avg(x.bco_loss(0.1 * F.col("cs"), C.label, F.col("delta"))), 6).alias("loss"))


QUERIES["bco_loss"] = bco_loss
ORACLES["bco_loss"] = f"{_PAIRS}, m as (select k // 100 as batch, avg(0.1::double * cs) as m from p group by 1), d as (select batch, avg(m) over (order by batch rows unbounded preceding) as delta from m) select batch, round(avg(case when label then -{ls('0.1::double * cs - delta')} else -{ls('-(0.1::double * cs - delta)')} end), 6) as loss from p join d on d.batch = p.k // 100 group by batch"


def aot(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).select(F.floor(F.col("k") / 100).alias("batch"), (C.c - C.r).alias("a"), (F.col("rc") - F.col("rr")).alias("b"))
    return x.rank_joined(rows, "a", "b", "batch").groupBy("batch").agg(F.round(F.avg(x.aot_loss(F.col("a") - F.col("b"), 0.1, 0.1)), 6).alias("loss"))


QUERIES["aot_rank_join"] = aot
ORACLES["aot_rank_join"] = f"{_PAIRS}, s as (select k // 100 as batch, c - r as a, rc - rr as b from p), x as (select batch, a, row_number() over (partition by batch order by a) as i from s), y as (select batch, b, row_number() over (partition by batch order by b) as i from s) select batch, round(avg(-{ls('0.1::double * (a - b)')} * 0.9::double - {ls('-0.1::double * (a - b)')} * 0.1::double), 6) as loss from x join y using (batch, i) group by batch"


def sequences(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(
        "vec_id", "label", F.expr("transform(embedding, x -> -abs(double(x)))").alias("lp"), F.expr("transform(embedding, (x, i) -> -abs(double(embedding[63 - i])))").alias("old"),
        F.expr("transform(embedding, (x, i) -> if((i + label) % 4 = 0, 0D, 1D))").alias("mask"), ((F.col("vec_id") % 7 - 3) / 2.0).alias("adv"),
    )


_SEQ = "e as (select vec_id, label, unnest(embedding)::double as x, unnest(range(64)) as i, (vec_id % 7 - 3) / 2.0::double as adv from embeddings), t as (select a.vec_id, a.label, a.i, a.adv, -abs(a.x) as lp, -abs(b.x) as old, case when (a.i + a.label) % 4 = 0 then 0.0::double else 1.0::double end as mask from e a join e b on a.vec_id = b.vec_id and b.i = 63 - a.i), c as (select *, {coef} as c from t), l as (select *, {loss} as l from c), s as (select label, vec_id, sum(l * mask) as s, sum(mask) as n, sum(l) as al, count(*) as sz from l group by label, vec_id)"
_CLIP = "-least(c * adv, greatest(least(c, 1.2::double), 0.8::double) * adv)"
_REDUCE = {"grpo": "avg(s / greatest(n, 1))", "sapo": "avg(s / greatest(n, 1))", "bnpo": "sum(s) / greatest(sum(n), 1)", "dr_grpo": "sum(s) / (count(*) * 64)", "dapo": "sum(s) / greatest(sum(n), 1)", "cispo": "sum(s) / greatest(sum(n), 1)", "luspo": "sum(al * n) / sum(sz)"}
_TOKEN = {"sapo": f"-(4 / case when adv > 0 then 1 else 1.05::double end) * {sg('case when adv > 0 then 1 else 1.05::double end * (c - 1)')} * adv", "cispo": "-least(c, 0.2::double) * adv * lp"}


def _policy(kind: str, level: str = "token"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = sequences(spark, d)
        rows = rows.withColumn("l", x.policy_token_losses(kind, "lp", "old", "adv", "mask", level=level))
        return x.reduce_policy(kind, rows, "l", "mask", 64, "label", level).select("label", (F.round("loss", 6) + 0.0).alias("loss"))

    return run


for _kind in x.POLICY:
    for _level in ("token", "sequence") if _kind in ("grpo", "luspo") else ("token",):
        _name = f"policy_loss_{_kind}" + ("_sequence" if _level == "sequence" else "")
        _coef = "exp(lp - old)" if _level == "token" else "exp(sum((lp - old) * mask) over (partition by vec_id) / greatest(sum(mask) over (partition by vec_id), 1))"
        QUERIES[_name] = _policy(_kind, _level)
        ORACLES[_name] = "with " + _SEQ.format(coef=_coef, loss=_TOKEN.get(_kind, _CLIP)) + f" select label, round({_REDUCE[_kind]}, 6) + 0.0 as loss from s group by label"


def clip_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = sequences(spark, d).select("label", "adv", F.explode(F.arrays_zip("lp", "old", "mask")).alias("t")).where("t.mask = 1")
    low, high = x.clip_flags(F.exp(F.col("t.lp") - F.col("t.old")), F.col("adv"), 0.2, 0.2)
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return t.groupBy("label").agg(rate(low).alias("low"), rate(high).alias("high"), rate(low | high).alias("region"))


QUERIES["clip_metrics"] = clip_metrics
ORACLES["clip_metrics"] = "with " + _SEQ.format(coef="exp(lp - old)", loss="0") + " select label, round(avg((c < 0.8::double and adv < 0)::int), 6) as low, round(avg((c > 1.2::double and adv > 0)::int), 6) as high, round(avg((c < 0.8::double and adv < 0 or c > 1.2::double and adv > 0)::int), 6) as region from c where mask = 1 group by label"


def preference_metrics(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy(*_KEYS).agg(F.round(F.avg(0.1 * C.cs), 6).alias("chosen"), F.round(F.avg(0.1 * C.rs), 6).alias("rejected"), F.round(F.avg((C.cs > C.rs).cast("int")), 6).alias("accuracy"), F.round(F.avg(0.1 * (C.cs - C.rs)), 6).alias("margin"))


QUERIES["preference_metrics"] = preference_metrics
ORACLES["preference_metrics"] = f"{_PAIRS} select l_returnflag, l_linestatus, round(avg(0.1::double * cs), 6) as chosen, round(avg(0.1::double * rs), 6) as rejected, round(avg((cs > rs)::int), 6) as accuracy, round(avg(0.1::double * (cs - rs)), 6) as margin from p group by all"
