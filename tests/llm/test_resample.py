import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import resample
from tests.llm import brute

SCHEMA = "doc_id long, text string, _d_rank string, _o_at string, bucket string"


def runs(text, order):
    w = brute.BENCH_WORD.findall((text or "").translate(brute.LOWER))
    return w, [" ".join(w[a : a + k]) for k in range(1, order + 1) for a in range(len(w) - k + 1)]


def plain(rows, target, order, buckets, percent, least, seed):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (collections.Counter(bucket(x) for text in some for x in runs(text, order)[1]) for some in ([r[1] for r in rows], target))
    n, m = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, features = runs(text, order)
        weight = sum(gain[bucket(x)] for x in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit):
        x[4] = k + 1 if k < percent * len(fit) // 100 else None
    return sorted((tuple(None if v is False else v for v in x) for x in out), key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = ["The", "cat", "SAT", "über", "É", "x1", "42", "don't", "a-b", "漢字"] + [f"w{k}" for k in range(60)]
    return ["".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", " "]) for _ in range(r.choice([0, 1, 3, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("order", "buckets", "most"), [(1, 10_000, 400_000), (2, 97, 40), (3, 1000, 400_000)])
def test_against_plain(spark, monkeypatch, order, buckets, most):
    monkeypatch.setattr(resample, "MOST_NODES", most)  # trie tests in this process; workers keep their own
    rows = [*enumerate(texts(1, 220)), (None, "w1 " * 30), (3, None), (5, "same words here " * 9), (5, "same words here " * 9)]
    target = [*texts(2, 15), None, ""]
    docs = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA).repartition(5)
    out = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 10, 2024, 20, order, buckets, keep=["doc_id", "bucket"])
    got = sorted(((x.doc_id, x["_d_n_features"], x["_d_weight"], x["_d_score"], x["_d_rank"]) for x in out.collect()), key=str)
    assert got == plain(rows, target, order, buckets, 10, 20, 2024)


@pytest.mark.parametrize("order", [1, 3])
def test_trie_in_pieces(monkeypatch, order):
    """Small pieces and tries started anew change nothing; CRC states are those of the runs' texts."""
    made = [t.encode() for t in texts(4, 80)] + [b"x" * 5000, b"y " * 4000]
    gains = np.arange(50, dtype=np.float64) - 20
    results = []
    for piece, most in ((1 << 19, 400_000), (7, 400_000), (64, 9)):
        monkeypatch.setattr(resample, "PIECE_BYTES", piece)
        monkeypatch.setattr(resample, "MOST_NODES", most)
        counting, scoring = resample.Trie(order, 50), resample.Trie(order, 50, gains)
        for t in made:
            counting.add(t)
        results.append((counting.fold().tolist(), [scoring.worth(t) for t in made]))
    assert results[0] == results[1] == results[2]
    want = collections.Counter(zlib.crc32(x.encode()) % 50 for t in made for x in runs(t.decode(), order)[1])
    assert results[0][0] == [want[b] for b in range(50)]
    assert results[0][1] == [(len(w), len(f), sum(zlib.crc32(x.encode()) % 50 - 20 for x in f)) for w, f in (runs(t.decode(), order) for t in made)]


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resample.resample(none, none).count() == 0
    short = resample.resample(spark.createDataFrame([(1, "few words", "a", "b", "c")], SCHEMA), none, keep=["doc_id"]).collect()
    assert [(x.doc_id, x["_d_n_features"], x["_d_rank"]) for x in short] == [(1, 2, None)]
