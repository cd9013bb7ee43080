"""What the finding of round 4 told: the tests marked F1 failed before."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from lodestone.operators import novelty


def drawn(r: random.Random, letters: str, low: int, top: int, n: int = 25) -> list[str]:
    return ["".join(r.choice(letters) for _ in range(r.randrange(low, top + 1))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "0123456789", "abcdef é𝄞\n"])
def test_matches_as_difflib(letters):
    """many pairs at a time have difflib's matching blocks, in either order, with and without a common head."""
    r = random.Random(letters)
    for low, top in ((0, 3), (0, 20), (7, 9), (31, 33), (0, 64), (62, 64)):
        for head in ("", "ab", "aaaa", "Supplier#0000", "abcabcabca", "a" * 30 + "b", "def f(x):\n    return x + "):
            firsts, seconds = ([(head + x)[: novelty.SHORT] for x in drawn(r, letters, low, top, 12)] for _ in range(2))
            got = novelty.matches(firsts, seconds)
            assert [[sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) for a in firsts] for b in seconds] == got.tolist()


def test_short_programs_go_without_difflib(monkeypatch):
    """a group's short programs are not compared pair by pair in Python."""
    names = [f"Supplier#{k * 37:09d}" for k in range(60)]
    want = [sum(SequenceMatcher(None, a, b).ratio() for b in names if b is not a) for a in names]

    def pair_by_pair(*_):
        raise AssertionError("difflib was called")

    monkeypatch.setattr(novelty.SequenceMatcher, "set_seq2", pair_by_pair)
    got = novelty.similarities(names, [2] * len(names))
    assert [n for _, n in got] == [59] * 60 and [s for s, _ in got] == pytest.approx(want, abs=1e-9)


def test_short_and_long_programs_meet():
    r = random.Random(4)
    codes = ["", *drawn(r, "abc\n", 0, 64), *drawn(r, "abc\n", 60, 70), *drawn(r, "ab", 190, 260, 5)]
    for sides in ([2] * len(codes), [r.randrange(2) for _ in codes]):
        counts = [r.randrange(1, 4) for _ in codes]
        for i, (s, n) in enumerate(novelty.similarities(codes, sides, counts)):
            others = [(b, counts[j] - (i == j)) for j, b in enumerate(codes) if sides[i] == 2 or sides[i] != sides[j]]
            assert n == sum(k for _, k in others) and s == pytest.approx(sum(k * SequenceMatcher(None, codes[i], b).ratio() for b, k in others), abs=1e-9)


def test_meetings_of_blocks_are_dealt_by_number(spark):
    """a few bytes of names are much work, and came to one task where partitions were put together by their bytes."""
    rows = [(g, k, f"Supplier#{g * 1000 + k:09d}") for g in range(3) for k in range(300)]
    df = novelty.with_novelty(spark.createDataFrame(rows, "g int, k int, c string"), "g", "k", "c")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.g, r.k): r.novelty for r in df.collect()}
    assert len(got) == 900
    for g, k, c in rows[::101]:
        ratios = [SequenceMatcher(None, c, o).ratio() for h, j, o in rows if h == g and j != k]
        assert got[g, k] == pytest.approx(1 - sum(ratios) / len(ratios), abs=1e-9)
