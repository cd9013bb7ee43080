"""Order-preserving readers over files of several splits."""

import json
import os

import pytest
from pyspark.sql import types as T

from lodestone.sources import records

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def lines(n, bad=None, start=0):
    out = [json.dumps({"id": start + k, "t": "x" * (k % 90)}) for k in range(n)]
    if bad is not None:
        out[bad] = '{"id": 5, "t": '
    return out


def test_numbers_over_splits(spark, tmp_path, small_splits):
    for name, end in (("a", "\n"), ("b", "\r\n")):
        (tmp_path / f"{name}.jsonl").write_bytes((end.join(lines(1500)) + end).encode())
    text = records.placed_lines(spark, str(tmp_path))
    assert text.rdd.getNumPartitions() > 20 and text.select("file", "block").distinct().count() > 20
    got = records.numbered_lines(spark, str(tmp_path)).collect()
    for name in "ab":
        assert [r.value for r in sorted((r for r in got if r.file.endswith(f"{name}.jsonl")), key=lambda r: r.line)] == lines(1500)
        assert sorted(r.line for r in got if r.file.endswith(f"{name}.jsonl")) == list(range(1500))


def test_modes_with_a_late_bad_line(spark, tmp_path, small_splits):
    made = lines(1500, bad=1203)
    made[7:7] = ["", "  ", "[1, 2]", "5"]
    (tmp_path / "a.jsonl").write_text("\n".join(made))
    (tmp_path / "b.jsonl").write_text("\n".join(lines(10, start=5000)))
    ids = lambda mode, **k: [r.id for r in records.load(spark, str(tmp_path), SCHEMA, mode=mode, **k).collect()]
    assert ids("prefix") == [*range(1203), *range(5000, 5010)]
    assert ids("lossy") == [*[k for k in range(1500) if k != 1203], *range(5000, 5010)]
    with pytest.raises(Exception, match="bad record in"):
        ids("strict")
    assert ids("prefix", limit=1210) == [*range(1203), *range(5000, 5007)]
    assert records.load(spark, str(tmp_path / "none.jsonl"), SCHEMA, mode="prefix").count() == 0
    with pytest.raises(FileNotFoundError):
        records.load(spark, str(tmp_path / "none.jsonl"), SCHEMA)


def test_folder_of_all_kinds_and_limit(spark, tmp_path, small_splits):
    os.makedirs(tmp_path / "x" / "m")
    (tmp_path / "x" / "b.jsonl").write_text("\n".join(lines(300, start=300)))
    (tmp_path / "x" / "a.json").write_text(json.dumps({"data": [{"id": k, "t": "c"} for k in range(300)]}))
    spark.range(600, 900).selectExpr("id", "'p' as t").coalesce(1).write.parquet(str(tmp_path / "w"))
    (part,) = (p for p in os.listdir(tmp_path / "w") if p.endswith(".parquet"))
    os.rename(tmp_path / "w" / part, tmp_path / "x" / "m" / "c.parquet")
    (tmp_path / "x" / "readme.txt").write_text("no records")
    (tmp_path / "x" / "n.jsonl").write_text("{broken\n")
    got = lambda limit: [r.id for r in records.load(spark, str(tmp_path / "x"), SCHEMA, limit).collect()]
    assert got(5) == list(range(5)) and got(420) == list(range(420)) and got(900) == list(range(900))  # the broken file is never read
    with pytest.raises(Exception, match="bad record"):
        got(None)
    os.remove(tmp_path / "x" / "n.jsonl")
    assert got(0) == list(range(900)) == got(None)
    assert sorted(r.id for r in records.load(spark, str(tmp_path / "x"), SCHEMA, ordered=False).collect()) == list(range(900))
    with pytest.raises(ValueError, match="unsupported"):
        records.load(spark, str(tmp_path / "x" / "readme.txt"), SCHEMA)
    assert records.first_readable(spark, [str(tmp_path / "no.parquet"), str(tmp_path / "x" / "readme.txt"), str(tmp_path / "x" / "a.json")], SCHEMA).count() == 300
