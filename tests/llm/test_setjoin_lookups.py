"""Finding of round 3 on op2: CPU seconds a GB."""

import random

import numpy as np
import pyarrow as pa

from lodestone.llm import setjoin


class Counts:
    """Stands for the counted keys: a key's count hangs on the key alone, and every lookup is noted."""

    bits = 4

    def __init__(self):
        self.lookups = []

    def find(self, keys):
        self.lookups.append(len(keys))
        n = (setjoin.mix(keys) % np.uint64(4)).astype(np.uint32)
        return n > 0, {"n": n}


def _rows(batch, monkeypatch):
    counts = Counts()
    monkeypatch.setattr(setjoin, "_scan", lambda docs, text, names, schema, each: each)
    got = pa.Table.from_batches(setjoin.bucket_rows(None, "text", 4, 85, counts)(iter([batch]))).to_pylist()
    return sorted(tuple(r.values()) for r in got), counts.lookups


def test_sets_of_a_batch_are_looked_up_together(monkeypatch):
    """A lookup goes through every part of the counted keys: it serves a batch of sets, not the few of one band, with the same rows."""
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefghijklmnop") + str(r.randrange(60)) for _ in range(r.choice((0, 1, 3, 9, 40, 90, 200, 450)))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, *texts[:20]])], names=["t"])
    rows, lookups = _rows(batch, monkeypatch)
    assert len(lookups) == 1 and len(rows) > 1000, lookups
    monkeypatch.setattr(setjoin, "LOOKUP_KEYS", 0)
    apart, many = _rows(batch, monkeypatch)
    assert apart == rows and len(many) > 1 and sum(many) == sum(lookups)


def test_sets_are_sorted_row_by_row():
    """Short, empty and null rows between long ones; repeated shingles once."""
    texts = ["a b a b a b a", "", "x", None, "x y", "a a a a a a", "q", "r s t u v w", "x"]
    for width in (1, 2, 3, 4):
        ((first, shingles, bounds),) = setjoin.sets_of(pa.array(texts), width)
        assert first == 0 and len(bounds) == len(texts) + 1 and bounds[-1] == len(shingles)
        found = {}
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            words = (text or "").split()
            runs = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
            row = shingles[a:b].tolist()
            assert row == sorted(set(row)) and len(row) == len(runs)
            if len(runs) == 1:
                assert found.setdefault((*runs, width), row) == row
