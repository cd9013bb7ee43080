"""Importance resampling towards a target distribution over hashed word runs.

Texts become features: all runs of one to ``order`` words, each in the bucket of its CRC-32. Each task keeps a trie whose
edges are words: a node stands for a run and holds how often the task has met it and the CRC state of its text, so a
child's bucket takes one step over the child's word alone. A task gives the totals of its buckets, which are summed over
all tasks; the gain of a bucket is the scaled, floored log-ratio of its smoothed shares in target and source. Then tries
are walked again, with gains attached to the nodes, to score each document by the mean of its features' gains plus a
Gumbel number keyed by document and seed, and the highest scores are drawn without replacement.

Ranks come from the counts by score: scores are integers within a range that the smoothing bounds, so their histogram is
small; only the scores at or above the cut are put in order, over range partitions.

A task's trie is started anew when it has ``MOST_NODES`` nodes; totals are kept, so no result depends on it. A long text is walked in
pieces, and its list of words is never held whole.

Results for odd input: null and empty texts have no features and weight 0; a null key is keyed by the empty text and
comes after others of its score; repeated rows are drawn each, in any order among themselves; ties go to the smaller
key; an empty table gives an empty result; an empty target leaves all gains to the smoothing; columns of the input are
kept as asked, those that begin with ``_d_`` or ``_o_`` are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, table, trimmed, without_prefix
from lodestone.llm.ordinals import indexed

MOST_NODES = 400_000
PIECE_BYTES = 1 << 19
SCALE = 1000
_COUNTED = 1 << 18

#: Every byte of a word, A-Z in lower case; all others become spaces. Bytes beyond ASCII belong to words.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _Edges(dict):
    """Edges that make their node when first walked."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        node = self[key] = self.make(key)
        return node


class Trie:
    """Runs of words as nodes. ``crc`` is the CRC-32 of the run's text; ``count`` how often it was met; ``gain`` what it is worth."""

    def __init__(self, order: int, buckets: int, gains: np.ndarray | None = None) -> None:
        self.order, self.buckets, self.gains = order, buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self._empty()

    def _empty(self) -> None:
        self.crc: list[int] = []
        self.spelled: dict[int, bytes] = {}
        self.words, self.longer = _Edges(self._word), _Edges(self._run)
        self.count = np.zeros(0, np.int64)
        self.gain, self.known = np.zeros(0, np.float64), 0
        self.met: list[np.ndarray] = []
        self.waiting = 0

    def _word(self, word: bytes) -> int:
        self.crc.append(zlib.crc32(word))
        node = len(self.crc) - 1
        if self.order > 1:
            self.spelled[node] = b" " + word
        return node

    def _run(self, key: int) -> int:
        self.crc.append(zlib.crc32(self.spelled[key & 0xFFFFFFFF], self.crc[key >> 32]))
        return len(self.crc) - 1

    def walk(self, words: list[bytes], before: int = 0) -> np.ndarray:
        """The nodes of all runs that end after the first ``before`` words."""
        first = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        level, out = first, [first[before:]]
        for k in range(1, min(self.order, len(words))):
            keys = (level[: len(words) - k] << 32) | first[k:]
            level = np.fromiter(map(self.longer.__getitem__, keys.tolist()), np.int64, len(keys))
            out.append(level[max(0, before - k) :])
        return np.concatenate(out) if len(out) > 1 else out[0]

    def pieces(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Words and nodes of a text, piece by piece."""
        carried: list[bytes] = []
        for words in word_lists(text):
            yield len(words), self.walk(carried + words if carried else words, len(carried))
            if self.order > 1:
                carried = (carried + words)[1 - self.order :]
            if len(self.crc) > MOST_NODES:
                self.fold()

    def add(self, text: bytes) -> None:
        """Counts the runs of a text."""
        for _, nodes in self.pieces(text):
            self.met.append(nodes)
            self.waiting += len(nodes)
            if self.waiting > _COUNTED:
                self._counted()

    def _counted(self) -> None:
        if self.met:
            counts = np.bincount(np.concatenate(self.met), minlength=len(self.crc))
            counts[: len(self.count)] += self.count
            self.count, self.met, self.waiting = counts, [], 0

    def fold(self) -> np.ndarray:
        """Empties the trie into the totals of its buckets."""
        self._counted()
        if len(self.count):
            bucket = np.array(self.crc[: len(self.count)], np.int64) % self.buckets
            self.totals += np.bincount(bucket, self.count, self.buckets).astype(np.int64)
        self._empty()
        return self.totals

    def _attach(self) -> None:
        """Attaches gains to new nodes; the array grows to twice its size, so it is seldom made anew."""
        nodes = len(self.crc)
        if nodes > len(self.gain):
            grown = np.zeros(2 * nodes, np.float64)
            grown[: self.known] = self.gain[: self.known]
            self.gain = grown
        if nodes > self.known:
            self.gain[self.known : nodes] = self.gains[np.array(self.crc[self.known :], np.int64) % self.buckets]
            self.known = nodes

    def worth(self, text: bytes) -> tuple[int, int, int]:
        """Words, features and summed gain of a text."""
        words = features = gain = 0
        for n, nodes in self.pieces(text):
            self._attach()
            words, features, gain = words + n, features + len(nodes), gain + int(self.gain[nodes].sum())
        return words, features, gain


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size, as long as no single word is longer."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(_SPLIT)
        while end < len(text) and not piece.endswith(b" "):  # up to the next separator
            cut = piece.rfind(b" ")
            if cut > 0:
                end, piece = at + cut, piece[:cut]
                break
            more = text[end : end + PIECE_BYTES].translate(_SPLIT)
            stop = more.find(b" ")
            piece += more if stop < 0 else more[: stop + 1]
            end += len(more) if stop < 0 else stop + 1
        if words := piece.split():
            yield words
        at = end


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _fields(df: DataFrame, names: list[str], text: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_d_text"))


def bucket_totals(docs: DataFrame, text: str = "text", order: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: the features of all texts by bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(order, buckets)
        for batch in batches:
            for value in _texts(batch.column(0)):
                trie.add(value)
        totals = trie.fold()
        full = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(totals[full], pa.int64())], names=["bucket", "n"])

    return _fields(docs, [], text).mapInArrow(trimmed(each), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000, scale: int = SCALE) -> np.ndarray:
    """The gain of every bucket, from the totals of source and target: ``buckets`` numbers, whatever the data."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, source), (t, target)):
        for row in df.collect():
            counts[row.bucket] = row.n
    every, wanted = int(s.sum()) + buckets, int(t.sum()) + buckets
    ratio = [float(b + 1) * float(every) / (float(a + 1) * float(wanted)) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return np.array([math.floor(scale * math.log(x)) for x in ratio], np.float64)


def with_weights(docs: DataFrame, worth: np.ndarray, text: str = "text", order: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``_d_n_words``, ``_d_n_features`` and ``_d_weight``, the floored mean of gains."""
    docs = without_prefix(without_prefix(docs, "_d_"), "_o_")
    names = [c for c in (docs.columns if keep is None else keep) if not c.startswith(("_d_", "_o_"))]
    source = _fields(docs, names, text)
    schema = source.drop("_d_text").schema
    for name in ("_d_n_words", "_d_n_features", "_d_weight"):
        schema = schema.add(name, "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(order, len(worth), worth)
        for batch in batches:
            found = [trie.worth(value) for value in _texts(batch.column(batch.num_columns - 1))]
            words, features, gain = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3).T
            weight = np.where(features > 0, gain // np.maximum(features, 1), 0)  # floors go down
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words), pa.array(features), pa.array(weight)], names=schema.fieldNames())

    return source.mapInArrow(trimmed(each), schema)


def gumbel(key: Column, seed: int, scale: int = SCALE) -> Column:
    """A scaled, floored Gumbel number from the digest of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32)))))


def drawn(scored: DataFrame, percent: int, least_words: int, key: str = "doc_id") -> DataFrame:
    """``scored`` (stored) with ``_d_rank``: 1, 2, 3... for the highest ``percent`` of the rows of at least ``least_words`` words, null for others."""
    fit = F.col("_d_n_words") >= least_words
    counts = sorted(((r["_d_score"], r.n) for r in scored.where(fit).groupBy("_d_score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    most, held, cut = percent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if held >= most:
            break
        held, cut = held + n, score
    if cut is None:
        return scored.withColumn("_d_rank", F.lit(None).cast("long"))
    high = fit & (F.col("_d_score") >= cut)
    named = scored.where(high).withColumn("_d_group", F.lit(""))
    placed = indexed(named, "_d_group", [F.desc("_d_score"), F.asc_nulls_last(f"`{key}`")], "drawn")
    ranked = placed.select(*scored.columns, F.when(F.col("_o_at") < most, F.col("_o_at") + 1).alias("_d_rank"))
    return ranked.unionByName(scored.where(~F.coalesce(high, F.lit(False))).withColumn("_d_rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, order: int = 1, buckets: int = 10_000, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default; they are stored) of every document with ``_d_`` columns: n_words, n_features, weight, score and rank (null: not drawn)."""
    worth = gains(bucket_totals(docs, text, order, buckets), bucket_totals(target, text, order, buckets), buckets)
    weighed = with_weights(docs, worth, text, order, keep)
    scored = materialise(weighed.withColumn("_d_score", (F.col("_d_weight") + gumbel(F.col(f"`{key}`"), seed)).cast("long")), "resample")
    return drawn(scored, percent, least_words, key)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark", "text"), keep=["doc_id"])
    return out.select("doc_id", *[F.col(f"_d_{c}").alias(c) for c in ("n_features", "weight", "score", "rank")])
