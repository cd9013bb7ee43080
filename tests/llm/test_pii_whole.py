"""Findings of round 3 on the personal data operator."""

import random

from lodestone.llm import pii
from tests.llm.test_operators import docs


def test_learns_from_all_evidence(spark):
    """every rule span and every text is evidence, copies by their count, also beyond the 20000 candidates that were drawn before. The order of rows changes nothing."""
    r = random.Random(3)
    rows = [(i, f"call +1 ({r.randrange(1000):03}) 555-{r.randrange(10000):04} now, order {r.choice('abc')}") for i in range(900)]
    few = docs(spark, rows)
    many = few.crossJoin(spark.range(9).select("id")).select(few.columns)

    def whole(d):
        seen = []
        train = pii.train
        pii.train = lambda stored, **settings: seen.append(stored) or {}
        try:
            pii.judge(d, keep=["doc_id"]).count()
        finally:
            pii.train = train
        return seen[0], pii.gathered(seen[0]), pii.evidence(seen[0])

    (one, a, _), (_, b, each), (other, _, _) = whole(few), whole(many), whole(few.repartition(3, "text"))
    told = lambda d, k: {tuple(x)[:-1]: k * x[-1] for x in d.collect()}
    assert told(a, 9) == told(b, 1)
    assert sum(told(b, 1).values()) == each.count() > 20_000
    learned = pii.train(one)
    assert learned and learned == pii.train(other)
