"""Finding of round 3 on op3: CPU seconds a GB."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import hasharrays, langmodel, textscan


def test_words_are_hashed_without_sums_over_the_slice():
    """The same hashes, also of words beyond the eight bytes taken at a time and beyond those taken in a row."""
    r = random.Random(5)
    words = ["a", "Zz", "[`{", "é漢😀", "abcdefgh", "abcdefghi", "x" * 16, "y" * 63, "z" * 64]
    texts = ["".join(r.choice([*words, " ", "\t\n", "\x0b"]) + r.choice(["", " "]) for _ in range(r.randrange(30))) for _ in range(500)]
    short = ["".join(c if len(c) < 60 else " " for c in t.split()) for t in texts]
    (s,) = textscan.slices(pa.array([" ".join(words[:8]), None, "", " ".join(words)]), lower=True)
    langmodel.tokens(s)
    assert s._sums is None
    for s in textscan.slices(pa.array([*texts, *short, None, "q" * 65 + " b", "w" * 2_000_000]), lower=True):
        starts, ends, _ = s.words()
        assert (s.word_hashes(starts, ends) == s.hashes(starts, ends)).all()


def test_lower_case_and_white_space_of_all_bytes():
    every = np.arange(256, dtype=np.uint8)
    assert bytes(textscan.lowered(every)) == bytes(every).lower()
    s = textscan.Slice(0, every, np.array([0, 256]))
    assert all((a == b).all() for a, b in zip(s.words(), s.runs(~textscan.WHITE[every]), strict=True))


def test_sorted_hashes_are_found_without_sorting(tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 64, 5000, np.uint64, endpoint=False))
    arrays = hasharrays.HashArrays(f"file://{tmp_path}", 2, {"c": "u4"}, len(keys))
    counts, sizes = np.arange(1, len(keys) + 1, dtype=np.uint32), np.zeros(4, np.uint64)
    for k in range(4):
        at = keys >> np.uint64(62) == k
        hasharrays.save(arrays.uri, f"{k}.hash", keys[at])
        hasharrays.save(arrays.uri, f"{k}.c", counts[at])
        sizes[k] = at.sum()
    hasharrays.save(arrays.uri, "sizes", sizes)
    asked = np.concatenate((keys[::3], keys[::3], keys[1::3] + np.uint64(1)))
    known, found = arrays.find(asked)
    order = np.argsort(asked)
    monkeypatch.setattr(np, "argsort", lambda *_, **__: pytest.fail("sorted again"))
    again, same = arrays.find(asked[order])
    assert (again == known[order]).all() and (same["c"] == found["c"][order]).all()
    assert known[: len(keys[::3])].all() and (found["c"][: len(keys[::3])] == counts[::3]).all() and not known[-len(keys[1::3]) :].any()


def test_distinct_keys_and_their_places():
    """Every key has a place with its value; all are there once where the lowest bits do not decide."""
    r = np.random.default_rng(4)
    for keys in (np.zeros(0, np.uint64), np.array([7], np.uint64), r.integers(0, 40, 900).astype(np.uint64), r.integers(0, 300, 900).astype(np.uint64) << np.uint64(32)):
        values, place = langmodel._distinct(keys)
        assert (values[place] == keys).all() and set(values.tolist()) == set(keys.tolist())
    assert (values == np.unique(keys)).all()
