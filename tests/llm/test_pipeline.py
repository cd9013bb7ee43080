"""The stages of the corpus pipeline against plain versions, each on its own input."""

import re

import corpus_pipeline
from lodestone.llm import pieces
from tests.llm import brute
from tests.llm.test_operators import texts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def result(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_keeps_one_of_each_group(spark):
    rows = [*enumerate(texts(21, 30)), (3, "one")]
    rows += [rows[12], (None, rows[14][1]), (999, rows[14][1])]
    named = [(k, t) for k, (_, t) in enumerate(rows)]
    group = {k: c for k, _, c in brute.components(named, 5, 80)}
    best = {}
    for k, (i, t) in enumerate(rows):
        if brute.words(t):
            best.setdefault(group[k], []).append((i is None, i, t))
    digest = __import__("hashlib").md5
    kept = [min(x, key=lambda y: (y[0], y[1] if y[1] is not None else 0, digest(y[2].encode()).hexdigest()))[1:] for x in best.values()]
    expected = sorted([*kept, *[(i, t) for i, t in rows if not brute.words(t)]], key=str)
    assert result(corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")) == expected
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").count() == 0


def test_decontamination_drops_what_the_rule_says(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(30))
    rows = [(0, passage), (1, "clean " * 40), (2, f"{passage} " + "other " * 900), (3, None), (4, f"a b {passage[:60]} c"), (5, "")]
    items = [(1, passage), (2, "word1 word2 word3")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = {i for i, _, _, _, c in brute.contamination(rows, items) if c}
    assert result(corpus_pipeline.benchmark_decontamination(spark, frame(spark, rows), str(tmp_path))) == sorted(((i, t) for i, t in rows if i not in bad), key=str)
    assert bad and len(bad) < len(rows)


def test_redaction_and_ids(spark):
    rows = [(k, t) for k, t in enumerate(texts(5, 10))] + [(500, "mail joe.b@example.org or +49 170 1234567 now"), (501, None)]
    out = dict(result(corpus_pipeline.redact_pii(spark, frame(spark, rows), "")))
    assert out[500] == "mail [EMAIL] or [PHONE] now" and out[501] is None
    assert all(out[k] == t for k, t in rows if t and not re.search(r"\d{3}|@", t))
    v = pieces.vocabulary(pieces.MODEL)
    for r in corpus_pipeline.sentencepiece_ids(spark, frame(spark, rows), "").collect():
        text = dict(rows)[r.doc_id]
        assert r.ids is None if text is None else v.decode(r.ids) == text
