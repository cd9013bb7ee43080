"""Replay and density queries over the driver's tables: orders are a buffer scored by price, vectors of even labels are desirable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import density, replay
from lodestone.sources.tables import read

QUERIES, ORACLES = {}, {}
DRAWS = 5000


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_add(
    "replay_draws",
    lambda s, d: replay.draws(read(s, d, "orders").withColumn("score", F.col("o_totalprice").cast("double")), "score", "o_orderkey", DRAWS, 5).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times")),
    f"""with c as (select o_orderkey, sum(o_totalprice::double) over (order by o_orderkey) as upto, sum(o_totalprice::double) over () as total from orders where o_totalprice > 0),
    d as (select i as draw, (('0x' || substr(md5('5|' || i), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double * (select max(total) from c) as at_ from range({DRAWS}) r(i))
    select o_orderkey, count(*) as times from d asof join c on d.at_ < c.upto group by 1""",
)


def refill(s: SparkSession, d: str) -> DataFrame:
    """Customers' orders as groups: those without any spread of prices get a group of the buffer."""
    orders = read(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("n"))
    rows = orders.select("o_custkey", "o_orderkey", F.expr("array_repeat(1, n)").alias("prompt"), F.expr("array_repeat(2, n % 3 + 1)").alias("completion"), "price")
    spread = rows.groupBy("o_custkey").agg(F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("std"))
    batch = rows.join(spread.select("o_custkey", (F.col("std") == 0).alias("flat")), "o_custkey").drop("price")
    buffer = rows.join(spread.withColumnRenamed("std", "score"), "o_custkey").select("o_custkey", "o_orderkey", "prompt", "completion", "score")
    out = replay.refilled(batch, buffer, "o_custkey", "flat", "score", "prompt", "completion", seed=3)
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("drawn_from").isNotNull().alias("drawn"), F.min(F.size("prompt")).alias("width"))


_add("replay_refill", refill, None)


def weights(s: SparkSession, d: str) -> DataFrame:
    vectors = read(s, d, "embeddings").select("vec_id", "label", "embedding")
    fitted = density.fit(vectors.where("label % 2 = 0"), vectors.where("label % 2 = 1"), "vec_id", "embedding", 400, 11)
    return density.with_weights(vectors, fitted, "embedding").select("vec_id", F.round("p_desirable", 4).alias("p"), F.round("weight", 3).alias("weight"))


_add("density_weights", weights, None)
