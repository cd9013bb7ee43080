"""Toxicity by maximum-scoring segments.

Token scores are log-odds of toxic against other labelled texts with an informative Dirichlet prior (the counts of both
together, times ``prior``): the difference of the smoothed log-odds, kept where it exceeds ``effect`` and
``z`` of its standard errors, less a drift that makes an ordinary token cost a little, so that scores of a clean text wander down.
All disjoint maximum-scoring segments of a text come out of one linear scan (Ruzzo and Tompa); their scores in clean
texts follow an extreme-value law, so a Gumbel distribution, fitted on the clean labelled texts' best segments with a
term for the length of the text, calibrates them. The evidence of a text is its significant segments together; a logistic
function of it, fitted on labelled texts, is the score.

Training takes at most ``sample`` labelled rows of the training part, in order of a hash, and reads nothing else of them
than text and label; the model is a table of at most ``vocabulary`` tokens (the strongest ones), sent to the workers.

Results for odd input: a null or empty text has no segment and the score of no evidence; labels that are null are left
out; without labels of both kinds every score is 0.5 of nothing known, so 0; repeated rows give repeated results; an
empty table gives an empty result; columns of the input are kept, those added are named ``_t_*``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import table, without_prefix
from lodestone.llm.textscan import Slice, slices

SAMPLE = 8_000
VOCABULARY = 50_000
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


# ------------------------------------------------------------------ segments


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint and in order: Ruzzo and Tompa's scan, linear in time.

    Each candidate keeps the cumulative sums left and right of it; a new one is joined with the last candidate of
    smaller left sum as long as that one's right sum is smaller too. ``up`` links each candidate to that predecessor.
    """
    spans: list[tuple[int, int, float, float]] = []
    up: list[int] = []
    total = 0.0
    for i, x in enumerate(scores):
        left, total = total, total + x
        if x <= 0:
            continue
        start, j = i, len(spans) - 1
        while True:
            while j >= 0 and spans[j][2] >= left:
                j = up[j]
            if j < 0 or spans[j][3] >= total:
                break
            start, left = spans[j][0], spans[j][2]
            del spans[j:], up[j:]
            j = len(spans) - 1
        spans.append((start, i + 1, left, total))
        up.append(j)
    return [(a, b, r - left) for a, b, left, r in spans]


def sparse_segments(at: np.ndarray, weights: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """``maximal_segments`` of a sequence that is -drift but at the positions ``at``, where it is ``weights`` - drift."""
    scores: list[float] = []
    place: list[int] = []
    before = -1
    for i, w in zip(at.tolist(), weights.tolist(), strict=True):
        if i - before > 1 and scores:
            scores.append(-drift * (i - before - 1))
            place.append(i)
        scores.append(w - drift)
        place.append(i)
        before = i
    return [(place[a], place[b - 1] + 1, s) for a, b, s in maximal_segments(scores)]


# ------------------------------------------------------------------ model


@dataclass
class Model:
    """Token hashes in order with their weights, the drift, the Gumbel law of clean texts' best segments, the logistic calibration."""

    tokens: np.ndarray
    weights: np.ndarray
    drift: float = 0.05
    place: float = 0.0
    scale: float = 1.0
    slope: float = 1.0
    shift: float = -20.0
    level: float = 0.01

    def significance(self, score: float, n: int) -> float:
        """-log10 of the chance that a clean text of n tokens has a segment of this score: Gumbel tail with the length's logarithm."""
        x = (score - self.place) / self.scale - math.log(max(n, 1))
        tail = math.exp(-x) if x > 30 else -math.expm1(-math.exp(-max(x, -30)))
        return -math.log10(max(tail, 1e-300))

    def read(self, s: Slice) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """For each row the number of its tokens and its segments."""
        starts, ends, firsts = s.runs(_LETTERS[s.data])
        hashes = s.hashes(starts, ends)
        found, weight = self.look(hashes)
        known = np.flatnonzero(found)
        # the k-th time that a text has a token it counts a k-th of its weight: repetition alone is no passage
        if len(known):
            row = np.searchsorted(firsts, known, "right") - 1
            order = np.lexsort((known, hashes[known], row))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (hashes[known][order][1:] != hashes[known][order][:-1]) | (row[order][1:] != row[order][:-1])
            begin = np.flatnonzero(fresh)
            times = np.empty(len(order), np.int64)
            times[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) + 1
            weight[known] = np.where(weight[known] > 0, weight[known] / times, weight[known])
        edges = np.searchsorted(known, firsts)
        for i in range(s.rows):
            a, b = edges[i], edges[i + 1]
            yield int(firsts[i + 1] - firsts[i]), sparse_segments(known[a:b] - firsts[i], weight[known[a:b]], self.drift) if a < b else []

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.tokens):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.searchsorted(self.tokens, hashes)
        at[at == len(self.tokens)] = 0
        found = self.tokens[at] == hashes
        return found, np.where(found, self.weights[at], 0.0)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, int]:
        """Sum of the significances of the significant segments, and their number."""
        told = [p for _, _, score in segments if (p := self.significance(score, n)) >= -math.log10(self.level)]
        return sum(told), len(told)

    def score(self, evidence: float) -> float:
        x = self.slope * evidence + self.shift
        return 1 / (1 + math.exp(-x)) if x >= -700 else 0.0


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Difference of log-odds with an informative Dirichlet prior, and its z-score, from two count vectors."""
    both = (toxic + other).astype(float)
    a = prior * both
    n, m, a0 = toxic.sum(), other.sum(), a.sum()
    x, y = toxic + a, other + a
    delta = np.log(x / (n + a0 - x)) - np.log(y / (m + a0 - y))
    return delta, delta / np.sqrt(1 / x + 1 / y)


def _gumbel(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Place and scale of clean texts' best scores less the length's logarithm, from quantiles: a few mislabelled or odd texts don't move them."""
    scale = 1.0
    logs = np.log(np.maximum(lengths, 1))
    for _ in range(8):
        low, high = np.quantile(best - scale * logs, [0.5, 0.9])
        scale = float(np.clip((high - low) / (math.log(math.log(2)) - math.log(-math.log(0.9))), 0.25, 3.0))
    return float(np.median(best - scale * logs)) + scale * math.log(math.log(2)), scale


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift by Newton's method with a little ridge."""
    w = np.array([0.1, math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])
    features = np.stack([x, np.ones(len(x))], 1)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        step = np.linalg.solve(features.T @ (features * (p * (1 - p) + 1e-9)[:, None]) + ridge, features.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def learn(texts: list[str | None], labels: np.ndarray, z: float = 4.0, effect: float = 1.0, prior: float = 0.1, vocabulary: int = VOCABULARY) -> Model:
    """Weights from two thirds of the rows, calibration from the rest (texts unseen by the weights)."""
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if not len(texts) or labels.min() == labels.max():
        return empty
    fit = np.arange(len(texts)) % 3 > 0
    column = pa.array(texts, pa.string())
    tokens, owners = [], []
    for s in slices(column, lower=True):
        starts, ends, firsts = s.runs(_LETTERS[s.data])
        h = s.hashes(starts, ends)
        row = s.first + np.repeat(np.arange(s.rows), np.diff(firsts))
        h, row = h[fit[row]], row[fit[row]]
        # a text counts a token once: long or repetitive texts must not outvote the rest
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        tokens.append(h[fresh])
        owners.append(row[fresh].astype(np.int32))
    flat, owner = np.concatenate(tokens), np.concatenate(owners)
    if not len(flat):
        return empty
    names, ids = np.unique(flat, return_inverse=True)
    toxic = np.bincount(ids[labels[owner] == 1], minlength=len(names))
    other = np.bincount(ids[labels[owner] == 0], minlength=len(names))
    delta, score = log_odds(toxic, other, prior)
    order = np.argsort(-np.abs(score), kind="stable")[:vocabulary]
    order = order[(np.abs(score[order]) >= z) & (np.abs(delta[order]) >= effect)]
    order = np.sort(order)
    model = Model(names[order], np.clip(delta[order], -5, 8))
    lengths, segments = [], []
    for s in slices(column, lower=True):
        for n, found in model.read(s):
            lengths.append(n)
            segments.append(found)
    best = np.array([max((x for _, _, x in f), default=0.0) for f in segments])
    held = ~fit
    clean = held & (labels == 0)
    if clean.sum() >= 30:
        model.place, model.scale = _gumbel(best[clean], np.array(lengths)[clean])
    evidence = np.array([model.evidence(n, f)[0] for n, f in zip(lengths, segments, strict=True)])
    model.slope, model.shift = _logistic(evidence[held], labels[held].astype(float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> tuple[list[str | None], np.ndarray]:
    """At most ``sample`` labelled rows, in order of a hash of their key, so the choice does not depend on labels."""
    known = labels.select(F.col(key).alias("_t_key"), F.col(label).cast("int").alias("_t_label")).where("_t_key is not null and _t_label in (0, 1)")
    order = F.xxhash64(F.lit(20), F.col("_t_key"))
    few = known.orderBy(order, "_t_key").limit(sample)
    rows = docs.select(F.col(f"`{key}`").alias("_t_key"), F.col(f"`{text}`").cast("string").alias("_t_text")).join(few, "_t_key").orderBy(order, "_t_key")
    taken = rows.limit(sample).collect()
    return [r["_t_text"] for r in taken], np.array([r["_t_label"] for r in taken], np.int64)


SEGMENTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def with_scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), _t_score, and _t_segments: the significant passages as token ranges with their significance."""
    docs = without_prefix(docs, "_t_")
    names = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_t_text"))
    schema = source.drop("_t_text").schema.add("_t_score", "double").add("_t_segments", SEGMENTS)
    shared = source.sparkSession.sparkContext.broadcast(model)
    floor = -math.log10(model.level)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, passages = [], []
            for s in slices(batch.column(batch.num_columns - 1), lower=True):
                for n, found in model.read(s):
                    told = [(a, b, p) for a, b, x in found if (p := model.significance(x, n)) >= floor]
                    passages.append([{"start": a, "end": b, "score": p} for a, b, p in told])
                    scores.append(model.score(sum(p for _, _, p in told)) if len(model.tokens) else 0.0)
            arrays = [pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.fieldNames())

    return source.mapInArrow(each, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    texts, marks = training_rows(docs, labels.where(~held_out), "doc_id", "text", "toxic", SAMPLE)
    scored = with_scores(docs, learn(texts, marks), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("_t_score").alias("score"), F.expr("int(_t_score >= 0.7)").alias("predicted"))
