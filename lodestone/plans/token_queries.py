"""Token sequence queries: embeddings as logits or log-probabilities, documents split into words as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import tokens as t
from lodestone.operators import packing, quantiles
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def vectors(s: SparkSession, d: str) -> DataFrame:
    e = F.expr
    return read(s, d, "embeddings").select("vec_id", "label", e("transform(embedding, x -> double(x))").alias("a"), e("transform(embedding, (x, i) -> double(embedding[63 - i]))").alias("b"), e("transform(embedding, (x, i) -> if((i + label) % 4 = 0, 0D, 1D))").alias("m"))


_V = "e as (select vec_id, label, embedding, unnest(embedding)::double as a, unnest(range(64)) as i from embeddings), v as (select vec_id, label, i, a, embedding[64 - i]::double as b, case when (i + label) % 4 = 0 then 0.0::double else 1.0::double end as m from e)"


def _value(column, name: str = "x", places: int = 6):
    return lambda s, d: vectors(s, d).select("vec_id", (F.round(column(), places) + 0.0).alias(name))


_sum = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
_add("log_softmax_gather", _value(lambda: t.log_softmax_at("a", "label")), f"with {_V} select vec_id, round(max(case when i = label then a end) - ln(sum(exp(a))), 6) + 0.0 as x from v group by vec_id")
_add("entropy", _value(lambda: t.entropy("a")), f"with {_V} select vec_id, round(ln(sum(exp(a))) - sum(a * exp(a)) / sum(exp(a)), 6) + 0.0 as x from v group by vec_id")
_add("masked_mean", _value(lambda: t.masked_mean("a", "m")), f"with {_V} select vec_id, round(sum(a * m) / sum(m), 6) + 0.0 as x from v group by vec_id")
_add("masked_var", _value(lambda: t.masked_var("a", "m")), f"with {_V} select vec_id, round(var_samp(a) filter (where m = 1), 6) + 0.0 as x from v group by vec_id")
_add("masked_whiten", lambda s, d: vectors(s, d).withColumns({"mu": t.masked_mean("a", "m"), "var": t.masked_var("a", "m")}).select("vec_id", (F.round(_sum(F.transform(t.whitened("a", "m", "mu", "var"), lambda x, i: x * (i + 1))), 4) + 0.0).alias("x")), f"with {_V}, w as (select vec_id, avg(a) filter (where m = 1) as mu, var_samp(a) filter (where m = 1) as va from v group by vec_id) select vec_id, round(sum((a - mu) / sqrt(va + 1e-8) * (i + 1)), 4) + 0.0 as x from v join w using (vec_id) group by vec_id")
_add("k3_kl", _value(lambda: _sum(t.k3_kl("a", "b"))), f"with {_V} select vec_id, round(sum(exp(a - b) - (a - b) - 1), 6) + 0.0 as x from v group by vec_id")
_add("is_ratio_token", _value(lambda: _sum(t.importance_ratio("a", "b", "m", "token", 1.2))), f"with {_V} select vec_id, round(sum(least(exp((a - b) * m), 1.2::double)), 6) + 0.0 as x from v group by vec_id")
_add("is_ratio_sequence", _value(lambda: t.importance_ratio("a", "b", "m", "sequence", 2.0, "mask")), f"with {_V}, r as (select vec_id, exp(sum((a - b) * m)) as r from v group by vec_id) select vec_id, round(case when r > 2 then 0 else r end, 6) + 0.0 as x from r")
_add("offpolicy_mask", lambda s, d: vectors(s, d).select("vec_id", t.off_policy_keep("(vec_id % 3 - 1)", "a", "b", "m", 0.01).alias("keep")), f"with {_V} select vec_id, vec_id % 3 - 1 >= 0 or sum((b - a) * m) / greatest(sum(m), 1) <= 0.01::double as keep from v group by vec_id")
_soft = "transform({0}, x -> x - (array_max({0}) + ln(aggregate(transform({0}, y -> exp(y - array_max({0}))), 0D, (s, y) -> s + y))))"
_LS = "l as (select vec_id, a - ln(sum(exp(a)) over w) as p, b - ln(sum(exp(b)) over w) as q from v window w as (partition by vec_id))"
for _beta, _sql in ((0.0, "sum(exp(q) * (q - p))"), (1.0, "sum(exp(p) * (p - q))"), (0.3, "0.3::double * sum(exp(q) * (q - ln(0.7::double * exp(p) + 0.3::double * exp(q)))) + 0.7::double * sum(exp(p) * (p - ln(0.7::double * exp(p) + 0.3::double * exp(q))))")):
    _add(f"jsd_{str(_beta).replace('.', '_')}", (lambda beta: lambda s, d: vectors(s, d).withColumns({"p": F.expr(_soft.format("a")), "q": F.expr(_soft.format("b"))}).select("vec_id", (F.round(t.generalised_jsd("p", "q", beta), 6) + 0.0).alias("x")))(_beta), f"with {_V}, {_LS} select vec_id, round({_sql}, 6) + 0.0 as x from l group by vec_id")
_add("sorted_l1", _value(lambda: t.sorted_l1("a", "slice(transform(a, x -> x * 0.5D), 1, 50)")), f"with {_V}, p as (select vec_id, a, row_number() over (partition by vec_id order by a desc) as r from v), q as (select vec_id, a * 0.5::double as b, row_number() over (partition by vec_id order by a desc) as r from v where i < 50) select p.vec_id, round(sum(abs(a - coalesce(b, 0))), 6) + 0.0 as x from p left join q using (vec_id, r) group by p.vec_id")


def user_series(s: SparkSession, d: str) -> DataFrame:
    ev = read(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    return ev.select("user_id", F.transform("a", lambda x: F.coalesce(x["value"], F.lit(0.0)) / 100).alias("r")).withColumn("v", F.transform("r", lambda x: x * 0.5))


_E = "e as (select user_id, coalesce(value, 0) / 100 as r, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events)"
_add("gae", lambda s, d: user_series(s, d).select("user_id", t.gae("r", "v", 0.9, 0.95).alias("g")).select("user_id", F.posexplode("g").alias("i", "x")).select("user_id", "i", (F.round(F.col("x") * 1.4142135623730951, 6) + 0.0).alias("x")), f"with recursive {_E}, g as (select user_id, i, n, r + 0.9::double * coalesce(lead(r * 0.5) over (partition by user_id order by i), 0) - r * 0.5 as delta from e), f as (select user_id, i, delta as x from g where i = n union all select g.user_id, g.i, g.delta + 0.855::double * f.x from f join g on g.user_id = f.user_id and g.i = f.i - 1) select user_id, i - 1 as i, round(x * 1.4142135623730951::double, 6) + 0.0 as x from f")
_add("discounted_suffix", lambda s, d: user_series(s, d).select("user_id", F.posexplode(t.discounted_suffix("r", 0.9)).alias("i", "x")).select("user_id", "i", (F.round("x", 6) + 0.0).alias("x")), f"with {_E} select user_id, i - 1 as i, round(sum(r * pow(0.9::double, i - 1)) over (partition by user_id order by i desc), 6) + 0.0 as x from e")

# ------------------------------------------------------------------ ids


def ids(s: SparkSession, d: str) -> DataFrame:
    """Documents as token ids: the lengths of the words."""
    words = F.split("text", " ")
    return read(s, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"), F.transform(words, lambda w: F.length(w)).alias("ids"))


_I = "w as (select doc_id, doc_id // 100 as batch, list_transform(string_split(text, ' '), lambda x: length(x)) as ids from documents)"
_add("truncate", lambda s, d: packing.truncate(ids(s, d), 20).select("doc_id", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids")), f"with {_I} select doc_id, least(len(ids), 20) as n, array_to_string(ids[1:20], ',') as ids from w")
_add("keep_end", lambda s, d: ids(s, d).select("doc_id", F.array_join(t.truncated("ids", 20, "end"), ",").alias("ids")), f"with {_I} select doc_id, array_to_string(ids[greatest(len(ids) - 19, 1):], ',') as ids from w")
_add("pack_wrapped", lambda s, d: packing.pack_wrapped(ids(s, d), "ids", "batch", "doc_id", 512).select("batch", "row", F.array_join("ids", ",").alias("ids")), f"with {_I}, x as (select batch, doc_id, unnest(ids) as x, unnest(range(len(ids))) as i from w), n as (select batch, x, row_number() over (partition by batch order by doc_id, i) - 1 as pos from x) select batch, pos // 512 as row, string_agg(x, ',' order by pos) as ids from n group by 1, 2")
_add("pack_bfd", lambda s, d: packing.pack_bfd(ids(s, d), ["ids"], "batch", "doc_id", 1024).select("batch", "row", F.size("ids").alias("n"), "seq_lengths"), None)
_add("pad_left", lambda s, d: ids(s, d).withColumn("cut", t.truncated("ids", 30)).select("doc_id", F.array_join(t.padded("cut", "30", "0", "left", 8), ",").alias("ids")), f"with {_I}, c as (select doc_id, ids[1:30] as c from w) select doc_id, array_to_string(list_concat(list_transform(range(32 - len(c)), lambda x: 0), c), ',') as ids from c")
_add("label_mask", lambda s, d: ids(s, d).withColumn("mask", F.transform("ids", lambda x: (x % 2).cast("int"))).select("doc_id", F.md5(F.array_join(t.labels("ids", "mask"), ",")).alias("labels")), f"with {_I} select doc_id, md5(array_to_string(list_transform(ids, lambda x: case when x % 2 = 1 then x else -100 end), ',')) as labels from w")
_add("position_ids", lambda s, d: ids(s, d).select("doc_id", F.array_join(t.position_ids("ids"), ",").alias("p")), f"with {_I} select doc_id, array_to_string(flatten(list_transform(ids, lambda n: range(n))), ',') as p from w")
_add("flush_left", lambda s, d: ids(s, d).withColumn("mask", F.transform("ids", lambda x: (x > 4).cast("int"))).select("doc_id", F.md5(F.array_join(t.flushed("mask", "ids"), ",")).alias("ids")), f"with {_I}, f as (select doc_id, ids, coalesce(list_position(list_transform(ids, lambda x: x > 4), true), len(ids) + 1) as p from w) select doc_id, md5(array_to_string(list_concat(ids[p:], list_transform(range(p - 1), lambda x: 0)), ',')) as ids from f")
_add("first_true", lambda s, d: ids(s, d).select("doc_id", t.first_true("transform(ids, x -> x > 9)").alias("i")), f"with {_I} select doc_id, coalesce(list_position(list_transform(ids, lambda x: x > 9), true) - 1, len(ids)) as i from w")
_add("high_entropy_mask", lambda s, d: high_entropy(s, d), f"with {_V}, q as (select quantile_cont(abs(a), 0.8) as q from v where m = 1) select vec_id, count(*) filter (where m = 1 and abs(a) >= q) as n from v, q group by vec_id")


def tokens(s: SparkSession, d: str) -> DataFrame:
    """The entropy and the mask of each place of a vector."""
    return vectors(s, d).select("vec_id", F.explode(F.arrays_zip("a", "m")).alias("t")).select("vec_id", F.abs("t.a").alias("h"), F.col("t.m").alias("m"))


def high_entropy(s: SparkSession, d: str) -> DataFrame:
    """How many tokens of each row are at or above the exact 0.8 quantile of all unmasked entropies."""
    (cut,) = quantiles.quantiles(tokens(s, d).where("m = 1"), F.col("h"), [0.8])
    return tokens(s, d).groupBy("vec_id").agg(F.sum(((F.col("m") == 1) & (F.col("h") >= F.lit(cut))).cast("long")).alias("n"))


QUANTILES = [0.05, 0.5, 0.95]
_add(
    "entropy_quantiles", lambda s, d: quantiles.group_quantiles(tokens(s, d), ["m"], F.col("h"), QUANTILES).select("m", *[F.round(f"q{i}", 7).alias(f"q{i}") for i in range(3)]),
    f"with {_V} select m, " + ", ".join(f"round(quantile_cont(abs(a), {q}), 7) as q{i}" for i, q in enumerate(QUANTILES)) + " from v group by m",
)
