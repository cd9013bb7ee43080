import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from lodestone.operators import alignment, groups, novelty


def cut(r, text):
    out = []
    while text:
        k = r.choice([0, 1, 1, 2, 3, 5])
        out.append(text[:k])
        text = text[k:]
    return out


def plain(a, b):
    """Ends by their meaning: both texts so far are equal, longer than before, and no earlier tokens would do."""
    found, last = [], ""
    for i in range(1, len(a) + 1):
        x = "".join(a[:i])
        if len(x) > len(last) and (j := next((j for j in range(1, len(b) + 1) if "".join(b[:j]) == x), None)):
            found.append((i, j))
            last = x
    return found + ([(len(a), len(b))] if (found[-1] if found else (0, 0)) != (len(a), len(b)) else [])


def test_groups_by_meaning():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("ab é漢") for _ in range(r.randrange(25)))
        other = text if r.random() < 0.7 else text[: r.randrange(len(text) + 1)] + r.choice(["", "x", "aab"])
        a, b = cut(r, text), cut(r, other)
        assert alignment.ends(a, b) == plain(a, b)
        got = alignment.groups(a, b)
        assert [k for g in got for k in g["left"]] == list(range(len(a))) and [k for g in got for k in g["right"]] == list(range(len(b)))
    assert alignment.groups(["ab", "c", "d"], ["a", "bc", "d"]) == [{"left": [0, 1], "right": [0, 1]}, {"left": [2], "right": [2]}]
    assert alignment.groups(["ab", "x"], ["ab"]) == [{"left": [0], "right": [0]}, {"left": [1], "right": []}] and alignment.groups([], []) == []


def test_merged_in_a_table(spark):
    probs = [[0.6, 0.3, 0.1], [0.2, 0.5, 0.3]]
    rows = [(1, ["a", "b"], ["ab"], probs, [0, 1]), (2, ["a", "b"], ["a", "b"], probs, [0, 1]), (3, None, ["x"], probs, [0, 1]), (4, ["a"], ["b", "c"], None, [0]), (5, [], ["q"], probs, [0, 1]), (6, ["a", "b"], ["ab"], [[1.0, 0.0], [1.0, 0.0]], [0, 1])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "i int, a array<string>, b array<string>, p array<array<double>>, ids array<int>, groups string")
    out = {r.i: r for r in alignment.with_merged(alignment.aligned(df, "a", "b"), "p", "ids", "left").collect()}
    assert np.allclose(out[1].merged, [[0.3, 0.15, 0.05]]) and np.allclose(out[2].merged, probs) and np.allclose(out[6].merged, [[1e-8, 0.0]])
    assert (out[3].groups, out[3].merged, out[4].merged, out[5].merged) == (None, None, None, [[0.0, 0.0, 0.0]]) and out[4].groups[0].right == [0, 1]
    assert alignment.aligned(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("block", [3, 32])
def test_novelty_as_difflib(spark, block):
    r = random.Random(block)
    rows = [(g, k, r.choice([None, "", "print(1)", "x = 1\nprint(x)\n" * r.randrange(1, 25), "".join(r.choice("abc") for _ in range(30))])) for g, n in (("big", 17), ("pair", 2), ("lone", 1), (None, 3)) for k in range(n)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "g string, k int, code string, _w_s string").repartition(4)
    got = {(x.g, x.k): x.novelty for x in novelty.with_novelty(df, "g", "k", "code", block=block).collect()}
    want = {}
    for g, k, code in rows:
        others = [c or "" for h, j, c in rows if h == g and j != k]
        want[g, k] = 1 - sum(SequenceMatcher(None, code or "", c).ratio() for c in others) / len(others) if others else 1.0
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)
    assert novelty.with_novelty(df.limit(0), "g", "k", "code").count() == 0


def test_picks_with_novelty(spark):
    df = spark.createDataFrame([("q", i, *x) for i, x in enumerate([(0.5, 0.9, 0.1, 0.1, 0.2), (0.5, 0.1, 0.8, 0.1, 0.9), (0.1, 0.2, 0.3, 0.1, 0.7), (0.1, 0.8, 0.2, 0.1, 0.7), (0.0, 0.0, 0.0, 0.0, 0.1)])], "g string, i int, passed double, final double, raw double, normal double, fresh double")
    picks = lambda n, **k: [(x.i, x.reason) for x in groups.candidate_picks(df, "g", "i", "passed", "final", "raw", "normal", n, **k).orderBy("pick").collect()]
    assert picks(4, novelty="fresh") == [(0, "best_pass"), (1, "best_soft"), (2, "novel"), (3, "fallback")]
    assert picks(2, novelty="fresh") == [(0, "best_pass"), (1, "best_soft")] and picks(3) == [(0, "best_pass"), (1, "best_soft"), (3, "fallback")]
