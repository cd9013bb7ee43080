"""Quality rules with risk-controlled thresholds.

Every rule rejects a document when a feature passes a cutoff. The cutoffs come from labelled holdouts: for each stratum
and rule the candidate cutoffs are tried from the most lenient to the strictest (fixed-sequence testing); a cutoff is
certified while the exact (Clopper-Pearson) upper bound of the share of good documents that it rejects stays within the
rule's share of the permitted risk. The confidence is divided over all strata and rules (Bonferroni), the risk over the
rules (union bound), so that with probability 1 - delta no stratum loses more than ``alpha`` of its good documents to
the learned rules. A stratum with too few labels gets no learned rejection.

Results for odd input: null text is an empty text (no words: the base rule rejects it); null stratum is a stratum of its
own; repeated rows and repeated labels each count; an empty table gives an empty result; no labels give no learned rule;
other columns of the input are kept, and clash with nothing because features live under ``_q_`` names until the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import materialise, table, trimmed, without_prefix
from lodestone.llm.textscan import slices, windows

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_REPEAT_WIDTH = 5


def _row_of(at: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return np.searchsorted(firsts, at, "right") - 1


def _times(keys: np.ndarray) -> np.ndarray:
    """For each key, how often it occurs."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    runs = np.diff(edge)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(runs, runs)
    return out


def features_of(text: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(text), len(FEATURES)), np.int64)
    for s in slices(text):
        starts, ends, firsts = s.words()
        view = out[s.first : s.first + s.rows]
        view[:, 0] = np.diff(firsts)
        lead = (s.data & 0xC0) != 0x80
        total = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum(lead, out=total[1:])
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(total[ends] - total[starts], out=sums[1:])
        view[:, 1] = sums[firsts[1:]] - sums[firsts[:-1]]
        view[:, 2] = s.per_row(_SYMBOL[s.data])
        view[:, 7] = s.per_row((s.data >= 65) & (s.data <= 90))
        a, b, line_firsts = s.runs(s.data != 10)
        if len(a):
            full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
            a, b = a[full], b[full]
            row = _row_of(a, s.bounds)
            view[:, 5] = np.bincount(row, minlength=s.rows)
            key = s.hashes(a, b)
            order = np.lexsort((key, row))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
            view[:, 3] = view[:, 5] - np.bincount(row[order][fresh], minlength=s.rows)
        if len(starts):
            h = s.hashes(starts, ends)
            row = _row_of(np.arange(len(starts)), firsts)
            salt = row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            once = np.unique(h ^ salt, return_index=True)[1]
            view[:, 6] = np.bincount(row[once], minlength=s.rows)
            w, at = windows(h, firsts, _REPEAT_WIDTH)
            if len(w):
                twice = at[_times(w ^ salt[at]) >= 2]
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + _REPEAT_WIDTH, -1) if len(twice) else None
                hit = np.cumsum(cover[:-1]) > 0
                view[:, 4] = np.bincount(row[hit], minlength=s.rows)
    return out


def with_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and a ``_q_`` column for each feature of the whole text."""
    docs = without_prefix(docs, "_q_")
    names = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_q_text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(f"_q_{f}", T.LongType()) for f in FEATURES]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features_of(batch.column(batch.num_columns - 1))
            columns = [*batch.columns[:-1], *[pa.array(found[:, k]) for k in range(len(FEATURES))]]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return source.mapInArrow(scan, schema)


@dataclass(frozen=True)
class Rule:
    """Rejects where the value is at least (``low`` False) or at most (``low`` True) a cutoff of the grid, lenient first."""

    name: str
    value: str
    grid: tuple[float, ...]
    low: bool = False


#: Values are SQL over the _q_ columns.
RULES = (
    Rule("symbol_share", "_q_n_symbols / greatest(_q_word_chars, 1)", tuple(round(x * 0.02, 2) for x in range(40, 0, -1))),
    Rule("dup_line_share", "_q_n_dup_lines / greatest(_q_n_lines, 1)", tuple(round(x * 0.05, 2) for x in range(19, 0, -1))),
    Rule("repeat_share", "_q_n_repeat_words / greatest(_q_n_words, 1)", tuple(round(x * 0.02, 2) for x in range(49, 0, -1))),
    Rule("word_length", "_q_word_chars / greatest(_q_n_words, 1)", tuple(float(x) for x in range(60, 7, -1))),
    Rule("short_words", "_q_word_chars / greatest(_q_n_words, 1)", tuple(round(x * 0.25, 2) for x in range(4, 17)), low=True),
    Rule("upper_share", "_q_n_upper / greatest(_q_word_chars, 1)", tuple(round(x * 0.02, 2) for x in range(49, 4, -1))),
    Rule("few_words", "cast(_q_n_words as double)", tuple(float(x) for x in range(1, 41)), low=True),
)


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound (Clopper-Pearson) at level 1 - delta of a rate seen k times in n."""
    if n <= 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        top = max(terms := [c + i * a + (n - i) * b for i, c in enumerate(logs)])
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or tail(mid) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def _failing(value: Column, low: bool) -> Callable[[Column], Column]:
    """Whether a value does not pass a cutoff."""
    return (lambda c: value > c) if low else (lambda c: value < c)


@dataclass
class Cutoffs:
    """Certified cutoffs by stratum (text form; None for null), and what they were certified on."""

    by: dict[tuple[str | None, str], float] = field(default_factory=dict)
    report: list[dict] = field(default_factory=list)


def _passes(rule: Rule, value: Column, cutoff: float) -> Column:
    return value <= F.lit(cutoff) if rule.low else value >= F.lit(cutoff)


def fit(features: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.03, delta: float = 0.05, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", label: str = "quality", least: float = 0.02) -> Cutoffs:
    """Certify cutoffs on every labelled row of ``features``.

    Only counts by stratum, rule and grid step reach the driver: their number is that of the strata times a constant.
    A certified cutoff is used only if it also catches at least ``least`` of the stratum's bad documents and twice as large a share of
    the bad as of the good: a rule that tells nothing rejects nothing.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where("_k is not null and _y is not null")
    joined = features.join(known, F.col(f"`{key}`") == F.col("_k"), "inner")
    steps = []
    for r, rule in enumerate(rules):
        value = F.expr(rule.value)
        passed_by = _failing(value, rule.low)
        step = F.size(F.filter(F.array(*[F.lit(float(c)) for c in rule.grid]), passed_by))
        steps.append(F.struct(F.lit(r).alias("r"), step.alias("step")))
    counted = (
        joined.select(F.col(f"`{stratum}`").cast("string").alias("s"), "_y", F.inline(F.array(*steps)))
        .groupBy("s", "r", "step").agg(F.sum(F.expr("int(_y = 1)")).alias("good"), F.sum(F.expr("int(_y = 0)")).alias("bad"))
    )
    cells: dict[tuple, dict[int, tuple[int, int]]] = {}
    for row in counted.collect():
        cells.setdefault((row.s, row.r), {})[row.step] = (row.good or 0, row.bad or 0)
    out = Cutoffs()
    share, confidence = alpha / len(rules), delta / max(1, len(cells))
    for (s, r), by_step in sorted(cells.items(), key=lambda x: (x[0][0] or "", x[0][1])):
        rule = rules[r]
        n_good, n_bad = (sum(v[i] for v in by_step.values()) for i in (0, 1))
        chosen, good, bad, held = None, 0, 0, (0, 0)
        for step, cutoff in enumerate(rule.grid):  # a value of step j passes the cutoffs j, j + 1, ...
            here = by_step.get(step, (0, 0))
            good, bad = good + here[0], bad + here[1]
            if binomial_upper(good, n_good, confidence) > share:
                break
            if bad > held[1]:  # no stricter than what catches more
                chosen, held = cutoff, (good, bad)
        if chosen is not None and n_bad and held[1] / n_bad >= max(least, 2 * held[0] / max(1, n_good)):
            out.by[s, rule.name] = chosen
            out.report.append({"stratum": s, "rule": rule.name, "cutoff": chosen, "good": n_good, "good_rejected": held[0], "bad": n_bad, "bad_rejected": held[1]})
    return out


def rejected(cutoffs: Cutoffs, stratum: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a certified cutoff of the row's stratum is passed."""
    verdict = F.lit(False)
    by_rule = {r.name: r for r in rules}
    for (s, name), cutoff in cutoffs.by.items():
        here = F.col(f"`{stratum}`").cast("string").eqNullSafe(F.lit(s))
        verdict = verdict | (here & _passes(by_rule[name], F.expr(by_rule[name].value), cutoff))
    return verdict


BASE_FAILED = "_q_n_words < 10 or 100 * _q_n_repeat_words > 20 * _q_n_words"


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", keep: list[str] | None = None, **settings) -> tuple[DataFrame, Cutoffs]:
    """The columns ``keep`` (all by default), features, ``_q_base_failed`` and ``_q_kept`` for every document.

    The features are stored for the thresholds, without the texts; where the texts are kept, a second pass finds them anew.
    """
    names = without_prefix(docs, "_q_").columns if keep is None else keep
    light = list(dict.fromkeys(c for c in (*names, settings.get("key", "doc_id"), stratum) if c != text))
    stored = materialise(with_features(docs, text, light), "quality")
    cutoffs = fit(stored.where(f"not ({BASE_FAILED})"), labels, stratum, **settings)
    base = F.expr(BASE_FAILED)
    judged = with_features(docs, text, names) if text in names else stored
    return judged.withColumns({"_q_base_failed": base, "_q_kept": ~(base | rejected(cutoffs, stratum))}), cutoffs


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    judged, _ = judge(docs, labels, keep=["doc_id", "lang"])
    return judged.select("doc_id", *[F.col(f"_q_{f}").alias(f) for f in FEATURES[:5]], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))
