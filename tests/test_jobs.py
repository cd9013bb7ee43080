import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import jobs
from lodestone.sources import files

REASON = "if(v % 5 = 0, 'bad', null)"


def pool(spark, n=53):
    return spark.createDataFrame([(k, "ab"[k % 3 == 0], k * 7 % 11) for k in range(n)], "id int, source string, v int").repartition(4)


def validated(calls):
    def run(df):
        rows = df.withColumn("reason", F.expr(REASON))
        calls.append(sorted(r.id for r in df.collect()))
        return rows

    return run


def test_batches_once_and_again_after_a_stop(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/job", []
    accepted = F.col("reason").isNull()
    first = jobs.BatchJob(pool(spark), folder, "id", "id", 10, {"limit": 1})
    assert (first.batches, first.done(), first.decisions()) == (6, [], None)
    report = first.run(validated(calls), accepted, "source", most=2)
    assert (report["status"], report["batches"], first.done()) == ("stopped", 2, [0, 1])

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        first.run(fails, accepted, "source")
    os.makedirs(tmp_path / "job/decisions/00000002")  # a batch that was begun
    (tmp_path / "job/decisions/00000002/part-0.parquet").write_bytes(b"half")
    again = jobs.BatchJob(pool(spark).repartition(7), folder, "id", "id", 10, {"limit": 1})
    report = again.run(validated(calls), accepted, "source", {"b": 12, "a": 0})
    assert report["status"] == "targets" and report["batches"] == 5
    assert again.run(validated(calls), accepted, "source", {"b": 12})["batches"] == 5
    report = again.run(validated(calls), accepted, "source")
    assert report["status"] == "completed" and files.read_json(spark, f"{folder}/progress.json") == report
    assert calls == [list(range(a, min(a + 10, 53))) for a in range(0, 53, 10)]
    out = again.decisions().collect()
    assert sorted(r.id for r in out) == list(range(53)) and all(r["_batch"] == r.id // 10 for r in out)
    good = sum(k * 7 % 11 % 5 > 0 for k in range(53))
    assert sum(s["accepted"] for s in report["sources"].values()) == good and sum(s["rejected"] for s in report["sources"].values()) == 53 - good
    with pytest.raises(ValueError, match="other settings"):
        jobs.BatchJob(pool(spark), folder, "id", "id", 10, {"limit": 2})
    with pytest.raises(ValueError, match="other pool"):
        jobs.BatchJob(pool(spark, 54), folder, "id", "id", 10, {"limit": 1})


def test_validation_keeps_rows(spark, tmp_path):
    job = jobs.BatchJob(pool(spark), f"file://{tmp_path}/job", "id", "id", 30)
    with pytest.raises(ValueError, match="batch 0 gave other rows"):
        job.run(lambda df: df.where("id > 3").withColumn("reason", F.expr(REASON)), F.col("reason").isNull(), "source")
    assert job.done() == []
    empty = jobs.BatchJob(pool(spark).limit(0), f"file://{tmp_path}/empty", "id", "id", 30)
    assert empty.run(validated([]), F.lit(True), "source") == {"status": "completed", "batches": 0, "of": 0, "sources": {}}


def test_kept_columns(spark, tmp_path):
    made, folder = [], f"file://{tmp_path}/kept"

    def compute(df):
        made.append(1)
        return df.select("id", (F.col("v") * 2).alias("w"))

    for df, settings, times in ((pool(spark), {"c": 1}, 1), (pool(spark).repartition(2, "source").select("v", "source", "id"), {"c": 1}, 1), (pool(spark), {"c": 2}, 2), (pool(spark, 54), {"c": 1}, 3), (pool(spark).withColumn("v", F.when(F.col("id") != 9, F.col("v"))), {"c": 1}, 4)):
        out = jobs.kept_columns(df, compute, folder, settings)
        assert len(made) == times and out.count() == df.count()
    path = next(p for p in os.listdir(tmp_path / "kept") if not p.startswith("."))
    os.remove(tmp_path / "kept" / path / "_SUCCESS")
    for settings in ({"c": 1}, {"c": 2}):
        jobs.kept_columns(pool(spark), compute, folder, settings)
        jobs.kept_columns(pool(spark, 54), compute, folder, {"c": 1})
    jobs.kept_columns(pool(spark).withColumn("v", F.when(F.col("id") != 9, F.col("v"))), compute, folder, {"c": 1})
    assert len(made) == 5
