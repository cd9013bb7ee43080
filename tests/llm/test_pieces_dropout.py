import random

import numpy as np

from lodestone.llm import pieces
from tests.llm.test_operators import docs


def test_dropout_by_document_and_position(spark):
    """Repetitions of a word, and equal texts of other keys, are segmented each for itself."""
    text = " ".join(["internationalisation"] * 400)
    rows = [(i, text) for i in range(12)] + [(0, text)]
    got = pieces.with_ids(docs(spark, rows), keep=["doc_id"]).collect()
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, r.ids) == r.ids
    assert len({tuple(x) for x in by_key.values()}) == 12
    v = pieces.vocabulary(pieces.MODEL)
    for ids in by_key.values():
        ways = set(v.decode(ids).split(" "))
        assert ways == {"internationalisation"}
        marks = [i for i, k in enumerate(ids) if v.spelled[k].startswith(b" ")] + [len(ids)]
        assert len({tuple(ids[a:b]) for a, b in zip(marks, marks[1:])}) > 4  # noqa: B905


def test_dropout_memory_changes_nothing():
    """What the remembered agendas give is what the agenda gives under the hash of each occurrence."""
    v = pieces.vocabulary(pieces.MODEL)
    r = random.Random(8)
    words = ["".join(r.choice("theinganotrés") for _ in range(r.randrange(1, 50))) for _ in range(60)]
    memory = pieces.Memory(v, 0.3)
    for key in range(40):
        chosen = [r.choice(words) for _ in range(50)]
        own = pieces._mixed(key, 0, 50).tolist()
        parts = [v.encode_word(" " + w, 0.3, k) for w, k in zip(chosen, own, strict=True)]
        text = " ".join(chosen) if v.dummy_prefix else " " + " ".join(chosen)
        assert np.frombuffer(v.encode(text, memory, key), np.int32).tolist() == [k for p in parts for k in p]


def test_decoded_in_the_same_pass(spark):
    rows = [(1, "some words  and \n lines"), (2, None), (3, ""), (4, "É漢 x" * 50)]
    got = pieces.with_ids(docs(spark, rows), keep=["doc_id"], decoded="back").collect()
    assert {r.doc_id: r.back for r in got} == dict(rows)
    assert all((r.ids is None) == (r.back is None) for r in got)
