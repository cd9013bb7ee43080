import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import merkle, ordinals
from tests.llm import brute

SCHEMA = "doc_id long, source string, text string, _o_at string, run string, level string"


def rows(seed, n):
    r = random.Random(seed)
    names = ["hot"] * 40 + [None, "", "é", "漢", "z", "A", "lone"] + [f"s{k}" for k in range(40)]
    out = [(k, r.choice(names[:-41] + names[-40:]), r.choice([None, "", "text é", "T" * r.randrange(50)])) for k in range(n)]
    return [*out, (7, "single", "x"), (None, "hot", "y"), (3, "hot", None), (3, "hot", None), (3, "hot", "other")]


def found(spark, made, fanout):
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in made], SCHEMA).repartition(5)
    leaves = df.select("doc_id", "source", merkle.digest_of([F.col(c) for c in ("doc_id", "source", "text")]).alias("leaf"), "text")
    out = merkle.with_proofs(merkle.manifest(leaves, "source", "doc_id", fanout=fanout))
    return out.withColumns({"proof": merkle.proof(F.col("_m_path")), "again": merkle.folded(F.col("_m_path"), F.col("leaf")), "other": merkle.folded(F.col("_m_path"), F.lit("0" * 64))})


@pytest.mark.parametrize(("fanout", "n"), [(16, 700), (2, 300), (3, 90)])
def test_manifest(spark, fanout, n):
    made = rows(fanout, n)
    got = found(spark, made, fanout).collect()
    want = list(brute.manifest(made, fanout))
    assert sorted((str(x.doc_id), x.leaf, x["_m_subroot"], x["_m_root"], x.proof) for x in got) == sorted((str(row[0]), leaf, sub, root, "".join(b + a for b, a in path)) for row, leaf, sub, root, path in want)
    assert all(x.again == x["_m_root"] != x.other for x in got)


def test_single_leaf_and_empty(spark):
    (only,) = found(spark, [(1, None, None)], 16).collect()
    assert only.leaf == only["_m_subroot"] == only["_m_root"] == only.again == brute.framed((1, None, None)) and only.proof == ""
    assert found(spark, [], 16).count() == 0


def test_stack_from_any_stretch():
    """Whatever stretches the leaves are read in, whole runs and fragments hold each node once."""
    r = random.Random(3)
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 700):
        digests = [brute.sha(str(k)) for k in range(n)]
        levels = brute.tree(digests, 16)
        for _ in range(5):
            cuts = sorted({0, n, *(r.randrange(n) for _ in range(r.randrange(6)))})
            stretches = list(zip(cuts[:-1], cuts[1:], strict=True))
            r.shuffle(stretches)
            stack = merkle.Range(16)
            for a, b in stretches:
                stack.begin("g", a, n)
                for k in range(a, b):
                    stack.push(digests[k])
            stack.end()
            for group, level, run, place, whole, of, text in stack.out:
                first = run * 16 + place
                count = len(text) // 64
                assert (group, of) == ("g", n) and text == "".join(levels[level][first : first + count])
                assert whole == (place == 0 and first + count == min(len(levels[level]), run * 16 + 16))
            assert sum(len(x[-1]) // 64 for x in stack.out if x[1] == 0) == (n if n > 1 else 0)


def test_indexed(spark):
    r = random.Random(5)
    made = [(r.choice("aab"), r.randrange(50), k) for k in range(400)]
    out = ordinals.indexed(spark.createDataFrame(made, "g string, x int, k long"), "g", ["x", "k"], "test").collect()
    places = {k: (i, of) for g in "ab" for of in [sum(m[0] == g for m in made)] for i, (_, _, k) in enumerate(sorted((m for m in made if m[0] == g), key=lambda m: m[1:]))}
    assert {x.k: (x["_o_at"], x["_o_of"]) for x in out} == places and len(out) == 400
