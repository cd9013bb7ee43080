"""Folds, streams and jobs over the driver's tables. A user is a question; events are rollouts, samples or steps in order of (ts, event_id)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import groups, jobs
from lodestone.sources.tables import read
from lodestone.streaming import folds

QUERIES, ORACLES = {}, {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _folder(df: DataFrame, name: str) -> str:
    return f"{groups.shared_folder(df)}/{name}-{uuid.uuid4().hex}"


def attempts(events: DataFrame) -> DataFrame:
    """Purchases pass; views are refinements of a question, the rest its own attempts."""
    kind = F.when(F.col("event_type") == "view", "iterative").otherwise("original")
    return events.select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("event_type") == "purchase").alias("passed"), F.col("event_id").alias("step"))


_STREAKS = """with e as (select user_id, event_id, event_type <> 'view' as own, event_type = 'purchase' as passed, row_number() over (partition by user_id order by ts, event_id) as i from events),
    w as (select *, sum(passed::int) over (partition by user_id order by i) as successes, sum(own::int) over (partition by user_id order by i) as attempts from e)
    select user_id::varchar as user_id, event_id as step, sum((own and not passed)::int) over (partition by user_id, successes order by i)::bigint as streak, attempts::bigint as attempts, successes::bigint as successes from w"""


def _streak_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("user_id"), "step", "streak", "attempts", "successes")


_add("question_streaks", lambda s, d: _streak_rows(folds.over_table(attempts(read(s, d, "events")), folds.streaks(), "user_id", "ts", "event_id")), _STREAKS)


def streamed_streaks(s: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the table, run until nothing is left. Results and checkpoint are in the shared folder."""
    table = read(s, d, "events")
    folder = _folder(table, "streaks")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(setting)
    s.conf.set(setting, folds.PROVIDER)
    try:
        # a last event after all others lets the watermark pass them
        end = table.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("event_type"))
        rows = table.select(F.col("user_id").cast("long").alias("user_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "event_type")
        rows.unionByName(end).write.parquet(f"{folder}/in")
        stream = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
        out = folds.over_stream(attempts(stream), folds.streaks(), "user_id", "ts", "event_id", "1 minute")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(setting, before)
    return _streak_rows(s.read.schema(out.schema).parquet(f"{folder}/out").where("key <> '-1'"))


_add("streamed_streaks", streamed_streaks, _STREAKS)


def samples(s: SparkSession, d: str) -> DataFrame:
    """Purchases are steps, other events samples, every seventh without text."""
    e = read(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "step").otherwise("sample")
    return e.select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("step"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 > 0, "text").alias("text"))


_add(
    "deferred_samples",
    lambda s, d: folds.over_table(samples(s, d), folds.deferred(2, 3), "user_id", "ts", "event_id").select(F.col("key").alias("user_id"), "step", F.col("id").cast("long").alias("id"), "place", "left"),
    """with recursive e as (select user_id, event_id, event_type = 'purchase' as step, row_number() over (partition by user_id order by ts, event_id) as i from events),
    w as (select *, sum((not step)::int) over (partition by user_id order by i) as came from e),
    k as (select user_id, event_id, came, row_number() over (partition by user_id order by i) as k from w where step and event_id % 2 = 0),
    c as (select user_id, k, event_id, came, least(3, came) as gone, 0::hugeint as before from k where k = 1 union all select k.user_id, k.k, k.event_id, k.came, least(c.gone + 3, k.came), c.gone from c join k on k.user_id = c.user_id and k.k = c.k + 1),
    s as (select user_id, event_id as id, came from w where not step)
    select s.user_id::varchar as user_id, c.event_id as step, s.id, row_number() over (partition by s.user_id, c.k order by s.came) - 1 as place, (c.came - c.gone)::bigint as left from s join c on c.user_id = s.user_id and s.came > c.before and s.came <= c.gone where s.id % 7 > 0""",
)


def slots(s: SparkSession, d: str) -> DataFrame:
    """Events of ten shards by their type and place: questions, nodes, rollouts and slots."""
    e = read(s, d, "events")
    kind = F.expr("case when event_id % 10 = 0 then 'question' when event_type = 'purchase' then 'rollout' when event_id % 3 = 0 then 'node' else 'slot' end")
    return e.select(
        (F.col("event_id") % 10).alias("shard"), "ts", "event_id", kind.alias("kind"), F.floor(F.col("event_id") / 50).alias("step"), (F.col("event_id") % 5).alias("slot"), F.col("user_id").alias("question"), F.col("event_id").alias("id"),
        F.coalesce("value", F.lit(0.0)).alias("priority"), (F.col("event_id") % 4 == 0).alias("passed"), F.lit("original").alias("source"), F.lit(0.6).alias("prior"),
    )


_add("curriculum_slots", lambda s, d: folds.over_table(slots(s, d), folds.curriculum(40, 30, 0.1), "shard", "ts", "event_id").withColumnRenamed("key", "shard"), None)


def batches(s: SparkSession, d: str) -> DataFrame:
    """Documents are validated in batches, stopped after two and taken up again until two sources have enough."""
    docs = read(s, d, "documents").select("doc_id", "source", F.length("text").alias("n"))
    folder = _folder(docs, "batches")
    validate = lambda df: df.withColumn("reason", F.when(F.col("n") < 500, "short"))
    for most in (2, 0):
        job = jobs.BatchJob(docs, folder, "doc_id", "doc_id", 120)
        job.run(validate, F.col("reason").isNull(), "source", {"src1": 14, "src2": 14}, most)
    return job.decisions().select("doc_id", "reason", F.col("_batch").alias("batch"))


_add(
    "resumable_batches", batches,
    """with b as (select doc_id, source, case when length(text) < 500 then 'short' end as reason, ((row_number() over (order by doc_id) - 1) // 120)::int as batch from documents),
    c as (select batch, sum((source = 'src1' and reason is null)::int) as a, sum((source = 'src2' and reason is null)::int) as z from b group by 1),
    u as (select batch, sum(a) over (order by batch) >= 14 and sum(z) over (order by batch) >= 14 as met from c)
    select doc_id, reason, batch from b where batch <= coalesce((select min(batch) from u where met), 1000000)""",
)


def kept(s: SparkSession, d: str) -> DataFrame:
    """Token counts, computed once for the same documents and settings."""
    docs = read(s, d, "documents").select("doc_id", "text")
    folder = _folder(docs, "kept")
    compute = lambda df: df.select("doc_id", t.token_count(F.col("text")).alias("n"))
    jobs.kept_columns(docs, compute, folder, {"columns": "token_count"})
    return jobs.kept_columns(docs.hint("rebalance"), compute, folder, {"columns": "token_count"})


_add("kept_columns", kept, r"select doc_id, len(regexp_extract_all(text, '[^\s\x0b]+')) as n from documents")
