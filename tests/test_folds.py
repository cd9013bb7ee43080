"""The same rows from a table and from a stream of shuffled files, stopped and started again."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import folds

START = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, n long, kind string, step long, id string, text string, passed boolean, question long, priority double, slot long, source string, prior double"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
FOLDS = {"streaks": folds.streaks(), "deferred": folds.deferred(3, 2, 5), "curriculum": folds.curriculum(6, 4, 0.2)}


def events(seed, n=240):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice(["original", "iterative", "sample", "sample", "step", "question", "node", "node", "rollout", "slot", "slot", "slot"])
        out.append((r.choice("ab"), START + timedelta(seconds=i // 3), i, kind, i // 8, f"i{i}", r.choice(["t", "t", ""]), r.choice([True, False, False, None]), r.randrange(6), r.random(), i % 3, r.choice(["original", "iterative"]), r.choice([None, 0.3, 1.0])))
    return out


def plain(rows, fold):
    """The fold, key by key."""
    out = []
    for key in sorted({x[0] for x in rows}):
        state = fold.start()
        for x in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            out += [{"key": key, **row} for row in fold.step(state, dict(zip(FIELDS, x, strict=True)))]
    return out


def ordered(rows):
    return sorted(json.dumps(x if isinstance(x, dict) else x.asDict(), sort_keys=True) for x in rows)


@pytest.mark.parametrize("name", FOLDS)
def test_table(spark, name):
    rows = events(1)
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.md5("id")).repartition(3)
    assert ordered(folds.over_table(df, FOLDS[name], "k", "at", "n").collect()) == ordered(plain(rows, FOLDS[name])) != []
    assert folds.over_table(df.limit(0), FOLDS[name], "k", "at", "n").count() == 0


@pytest.mark.parametrize("name", FOLDS)
def test_stream_equals_table(spark, tmp_path, name):
    """Files whose events overlap in time, two runs with a checkpoint, the last event far ahead."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.PROVIDER)
    try:
        rows = events(2)
        r = random.Random(3)
        late = [rows[a : a + 60] for a in range(0, len(rows), 60)]
        for a, b in zip(late[:-1], late[1:], strict=True):  # some events come a file later
            b += a[-9:]
            del a[-9:]
        late.append([("z", START + timedelta(days=1), 10**6, "none", 0, "", "", None, 0, 0.0, 0, "", None)])

        def put(k):
            r.shuffle(late[k])
            spark.createDataFrame(late[k], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "w" / str(k)))
            (part,) = (x for x in os.listdir(tmp_path / "w" / str(k)) if x.endswith(".parquet"))
            os.makedirs(tmp_path / "in", exist_ok=True)
            os.rename(tmp_path / "w" / str(k) / part, tmp_path / "in" / f"{k}.parquet")

        def run():
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = folds.over_stream(stream, FOLDS[name], "k", "at", "n", "30 seconds")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
            return spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'").collect()

        for k in range(2):
            put(k)
        first = run()
        for k in range(2, len(late)):
            put(k)
        assert ordered(run()) == ordered(plain(rows, FOLDS[name]))
        assert len(first) < len(plain(rows, FOLDS[name]))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_rules():
    def run(fold, *given):
        state = fold.start()
        return [row for e in given for row in fold.step(state, e)]

    s = run(folds.streaks(), *[{"kind": k, "passed": p, "step": i} for i, (k, p) in enumerate([("original", False), ("iterative", False), ("original", None), ("iterative", True), ("original", False)])])
    assert [(x["streak"], x["attempts"], x["successes"], x["last"]) for x in s] == [(1, 1, 0, 0), (1, 1, 0, 0), (2, 2, 0, 2), (0, 2, 1, 2), (1, 3, 1, 4)]
    sample = lambda i, text="t": {"kind": "sample", "id": i, "text": text}
    d = run(folds.deferred(2, 2, 3), *[sample(i) for i in "abcd"], {"kind": "step", "step": 1}, {"kind": "step", "step": 2}, sample("e", ""), {"kind": "step", "step": 4}, {"kind": "step", "step": 6})
    assert [(x["step"], x["id"], x["left"]) for x in d] == [(2, "b", 1), (2, "c", 1), (4, "d", 0)]
    slot = lambda step, i=0, **more: {"kind": "slot", "step": step, "slot": i, "question": "q", **more}
    node = lambda i, step, question="b": {"kind": "node", "id": i, "question": question, "priority": 1.0, "step": step}
    c = run(folds.curriculum(2, 2), {"kind": "question", "question": 1}, slot(1), slot(1), node("x", 1), node("y", 1, "c"), node("z", 2), slot(2), slot(3), {"kind": "rollout", "question": "b", "passed": True}, slot(3), slot(5))
    assert [(x["source"], x["pool"]) for x in c] == [("warmstart", 0), ("original", 0), ("original", 2), ("iterative", 1), ("original", 0), ("original", 0)]
    assert c[3]["chosen"] == "z"
