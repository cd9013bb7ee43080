"""Folds over the events of a key in order, the same over a table and over a stream.

A fold is a state (a dict that JSON can hold) and a step that takes an event (a dict), changes the state and gives rows.
Over a table, rows are dealt by key and sorted by (key, time, order); a task folds them as they come and holds one state.
Over a stream, events wait in the key's state until the watermark has passed them and are then folded in order of (time,
order): whatever micro-batches they came in, the rows are those of the table, as long as no event is later than the
watermark allows. State and waiting events are in Spark's state store, so a restart goes on where the checkpoint is.

Results for odd input: a null time or order is an error in a table and never folded in a stream; events of equal
(time, order) are taken in any order, so ``order`` should tell them apart; nulls in events are None, and the folds below state
what they make of them; an empty table has no rows; a null key is a key like others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """``start`` makes a key's first state; ``step(state, event)`` gives rows of ``output`` (DDL) as dicts."""

    start: Callable[[], dict]
    step: Callable[[dict, dict], list[dict]]
    output: str


def _events(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """(key, time, order, event): the whole row as JSON, nulls kept."""
    event = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{time}`").cast("timestamp").alias("time"), F.col(f"`{order}`").cast("long").alias("order"), event.alias("event"))


def _schema(fold: Fold) -> T.StructType:
    return T.StructType([T.StructField("key", T.StringType()), *T._parse_datatype_string(fold.output).fields])


def over_table(df: DataFrame, fold: Fold, key: str, time: str, order: str) -> DataFrame:
    """key and the rows of the fold."""
    schema = _schema(fold)
    sorted_ = _events(df, key, time, order).repartition("key").sortWithinPartitions("key", "time", "order")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for k, t, o, event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t is None or o is None:
                    raise ValueError("an event without a time or an order")
                if state is None or k != now:
                    now, state = k, fold.start()
                rows += [{"key": k, **row} for row in fold.step(state, json.loads(event))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    wanted = to_arrow_schema(schema)
    return sorted_.mapInArrow(each, schema)


class _Ordered(StatefulProcessor):
    """Keeps events until the watermark has passed them, then folds them in order."""

    def __init__(self, fold: Fold) -> None:
        self.fold, self.columns = fold, [f.name for f in _schema(fold).fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getListState("waiting", "ms long, seq long, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        came = came[came["time"].notna() & came["order"].notna()]
        if len(came):
            ms = (came["time"].astype("datetime64[ms]").astype("int64")).tolist()
            self.waiting.appendList(list(zip(ms, came["order"].astype("int64").tolist(), came["event"].tolist(), strict=True)))
            self._wake(min(ms))
        return iter(())

    def _wake(self, ms: int) -> None:
        set_ = list(self.handle.listTimers())
        if not set_ or ms < min(set_):
            for timer in set_:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in held if x[0] <= upto]
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.fold.start()
        rows = [{"key": key[0], **row} for _, _, event in due for row in self.fold.step(state, json.loads(event))]
        self.state.update((json.dumps(state),))
        rest = held[len(due) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def close(self) -> None:
        pass


def over_stream(stream: DataFrame, fold: Fold, key: str, time: str, order: str, late: str) -> DataFrame:
    """key and the rows of the fold, appended as the watermark passes their events. The session's state store provider has to be RocksDB's (``PROVIDER``)."""
    events = _events(stream, key, time, order).withWatermark("time", late)
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=_Ordered(fold), outputStructType=_schema(fold), outputMode="Append", timeMode="EventTime")


def uniform(*parts) -> float:
    """A number from 0 up to 1 that depends on its arguments only."""
    return int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest()[:6], "big") / (1 << 48)


def streaks(original: str = "original") -> Fold:
    """Streaks of questions without a pass. Events: kind, passed, step.

    A pass of any kind ends the streak; a failure lengthens it only where the question itself was asked (kind
    ``original``): failed refinements do not count. A null ``passed`` is a failure.
    """

    def step(state: dict, event: dict) -> list[dict]:
        passed, own = bool(event.get("passed")), event.get("kind") == original
        if own:
            state["attempts"] += 1
            state["last"] = event.get("step")
        if passed:
            state["streak"], state["successes"] = 0, state["successes"] + 1
        elif own:
            state["streak"] += 1
        return [{"step": event.get("step"), **{k: state[k] for k in ("streak", "attempts", "successes", "last")}}]

    return Fold(lambda: {"streak": 0, "attempts": 0, "successes": 0, "last": None}, step, "step long, streak long, attempts long, successes long, last long")


def deferred(every: int, most: int, capacity: int = 0) -> Fold:
    """First in, first out: samples wait until a step that ``every`` divides takes up to ``most`` of them.

    Events: kind (sample or step), step, id, text. ``capacity`` above 0: the oldest beyond it are dropped. A sample
    without text is taken off, but not given out. Rows: what a step has taken and how many were left.
    """

    def step(state: dict, event: dict) -> list[dict]:
        held = state["held"]
        if event.get("kind") == "sample":
            held.append([None if event.get("id") is None else str(event["id"]), bool(event.get("text"))])
            if capacity > 0:
                del held[:-capacity]
            return []
        if event.get("kind") != "step" or every <= 0 or not held or event.get("step") is None or event["step"] % every:
            return []
        taken = held[: max(1, most)]
        del held[: len(taken)]
        return [{"step": event["step"], "id": i, "place": k, "left": len(held)} for k, i in enumerate(i for i, full in taken if full)]

    return Fold(lambda: {"held": []}, step, "step long, id string, place long, left long")


def curriculum(ttl: int, capacity: int, forced_share: float = 0.0, seed: int = 42, downweight_after: int = 2, decay: float = 0.5, floor: float = 0.1, least: float = 0.05, cover_once: bool = True) -> Fold:
    """What to roll out next: every question once first, then originals mixed with nodes of a pool.

    Events, by kind: ``question`` (question) waits for its first turn; ``node`` (id, question, priority, step) joins the
    pool, which keeps the latest ``capacity``; ``rollout`` (question, source, passed) changes the question's streak, a
    pass drops its nodes; ``slot`` (step, slot, question, prior) asks. Nodes of an age of ``ttl`` steps are dropped (0:
    never). Draws are numbers of (seed, step, slot), so the rows can be made again.
    """

    def fresh(state: dict, step: int) -> None:
        if ttl > 0:
            state["pool"] = [n for n in state["pool"] if step - n["step"] < ttl]

    def picked(state: dict, event: dict) -> dict:
        weights = [max(1e-6, n["priority"]) for n in state["pool"]]
        threshold, upto = uniform(seed, "pick", event["step"], event["slot"]) * sum(weights), 0.0
        for node, weight in zip(state["pool"], weights, strict=True):
            upto += weight
            if upto >= threshold:
                return node
        return state["pool"][-1]

    def keep(state: dict, event: dict) -> float:
        prior = 1.0 if event.get("prior") is None else event["prior"]
        beyond = state["streak"].get(str(event.get("question")), 0) - downweight_after
        return max(least, min(1.0, prior)) if beyond <= 0 else max(floor, least, min(1.0, decay**beyond * prior))

    def slot(state: dict, event: dict) -> dict:
        base = {"step": event["step"], "slot": event["slot"], "forced": False, "pool": len(state["pool"])}
        if cover_once and state["pending"]:
            return base | {"source": "warmstart", "chosen": state["pending"].pop(0)}
        fresh(state, event["step"])
        base["pool"] = len(state["pool"])
        original = base | {"source": "original", "chosen": None if event.get("question") is None else str(event["question"])}
        if not state["pool"]:
            return original
        if forced_share > 0 and uniform(seed, "forced", event["step"], event["slot"]) < forced_share:
            return original | {"forced": True}
        kept = keep(state, event)
        if (event["step"] + event["slot"]) % 2 == 1 or kept < 1 and uniform(seed, "keep", event["step"], event["slot"]) > kept:
            return base | {"source": "iterative", "chosen": picked(state, event)["id"]}
        return original

    def step(state: dict, event: dict) -> list[dict]:
        kind, question = event.get("kind"), None if event.get("question") is None else str(event["question"])
        if kind == "slot":
            return [slot(state, event)]
        if kind == "question" and question is not None:
            state["pending"].append(question)
        elif kind == "node":
            state["pool"].append({"id": str(event["id"]), "question": question, "priority": event.get("priority") or 0.0, "step": event["step"]})
            if capacity > 0:
                del state["pool"][:-capacity]
        elif kind == "rollout" and question is not None:
            if event.get("passed"):
                state["streak"].pop(question, None)
                state["pool"] = [n for n in state["pool"] if n["question"] != question]
            elif event.get("source") == "original":
                state["streak"][question] = state["streak"].get(question, 0) + 1
        return []

    return Fold(lambda: {"pending": [], "pool": [], "streak": {}}, step, "step long, slot long, source string, chosen string, forced boolean, pool long")
