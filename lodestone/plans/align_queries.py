"""Alignment of tokenisations and novelty over the driver's tables: a document's words against pieces of four letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import alignment, novelty
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def aligned_tokens(s: SparkSession, d: str) -> DataFrame:
    """Words with the space after them, and pieces of four letters: groups, and the digest of their first places."""
    docs = read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select("doc_id", F.expr("regexp_extract_all(text, '([^ ]* |[^ ]+)', 1)").alias("a"), F.expr("regexp_extract_all(text, '((?s).{1,4})', 1)").alias("b"))
    firsts = F.transform("groups", lambda g: F.concat(g["left"][0].cast("string"), F.lit(":"), g["right"][0].cast("string")))
    return alignment.aligned(words, "a", "b").select("doc_id", F.size("groups").alias("n_groups"), F.md5(F.array_join(firsts, ",")).alias("firsts"))


_add(
    "aligned_tokens", aligned_tokens,
    """with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ ]* |[^ ]+') as a from documents),
    l as (select doc_id, length(unnest(a)) as n, unnest(range(len(a))) as i, length(text) as whole from w),
    e as (select doc_id, i, whole, sum(n) over (partition by doc_id order by i) as upto from l),
    c as (select doc_id, upto, i, whole from e where upto % 4 = 0 or upto = whole),
    f as (select doc_id, count(*) as n, string_agg(case when upto < whole then (i + 1) || ':' || (upto // 4)::bigint end, ',' order by upto) as later from c group by 1)
    select w.doc_id, coalesce(n, 0) as n_groups, md5(case when n is null then '' else '0:0' || coalesce(',' || later, '') end) as firsts from w left join f using (doc_id)""",
)


def merged_probabilities(s: SparkSession, d: str) -> DataFrame:
    """A vector's values as the distributions of eight tokens over eight ids; the tokens spell three letters each, those of the other side four."""
    p = F.expr("transform(sequence(0, 7), i -> transform(slice(embedding, i * 8 + 1, 8), x -> abs(double(x))))")
    ids = F.expr("transform(sequence(0, 7), i -> int((vec_id + i) % 8))")
    rows = read(s, d, "embeddings").select("vec_id", p.alias("p"), ids.alias("ids"), F.array_repeat(F.lit("abc"), 8).alias("a"), F.expr("array('abca', 'bcab', 'cabc', 'abca', 'bcab', 'cabc')").alias("b"))
    out = alignment.with_merged(alignment.aligned(rows, "a", "b"), "p", "ids", "left")
    return out.select("vec_id", F.posexplode("merged").alias("group", "m")).select("vec_id", "group", F.posexplode("m").alias("id", "v")).select("vec_id", "group", "id", F.round("v", 9).alias("probability"))


_add(
    "merged_probabilities", merged_probabilities,
    """with x as (select vec_id, unnest(embedding)::double as x, unnest(range(64)) as k from embeddings), p as (select vec_id, k // 8 as i, k % 8 as id, abs(x) as p from x),
    c as (select vec_id, i // 4 as g, product(greatest(p, 1e-8::double)) as c from p where i % 4 > 0 and id = (vec_id + i) % 8 group by 1, 2)
    select vec_id, p.i // 4 as "group", id, round(p.p * c.c, 9) as probability from p join c using (vec_id) where p.i % 4 = 0 and c.g = p.i // 4""",
)
_add("code_novelty", lambda s, d: novelty.with_novelty(read(s, d, "supplier"), "s_nationkey", "s_suppkey", "s_name").select("s_nationkey", "s_suppkey", F.round("novelty", 6).alias("novelty")), None)
