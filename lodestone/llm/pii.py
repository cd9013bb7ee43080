"""Personal data: rule spans, and further candidates chosen by gradient-boosted trees. DataFrame operations only.

The rules (email, ip, card, phone) find what they find; those spans always stay. High-recall generators propose more
spans, which overlap one another and the rules: written-out addresses, digit groups of any grouping, dotted numbers also
with guarded dots, and identifiers of letters and digits that carry a check (``ident``: IBAN and eight digits with a
letter). Boosted trees (spark.ml, trained here, one model a kind) score a candidate from its format and the
words before it.

Their evidence does not come from what the rules match as it stands. Each rule span of all documents is rewritten in a
form that the rules do not know (spelled out, without prefix, regrouped, guarded, or its digits made an identifier) and
put where it stood; against these stand random digit groups, dates, versions and identifiers with a wrong check, three at
a place of every text, chosen by hash. A candidate that is just the rewritten span, under its kind, is good; one of
another kind or part, or of a random group, is bad; what a rule finds is left out. Nothing is sampled: candidates with
equal features are one row with their count, and the trees learn from these rows by weight, with all split points. The
weights let spans and places count alike, whichever are more. Half of the texts are held out, and each kind's threshold
is the least score at which the held-out candidates reach ``precision`` (lower bound of Wilson's interval) on this made
mixture, which is not that of the texts. The trees become a plain SQL expression, so all documents are scored where their
candidates are, without a join. A kind without evidence for a threshold gives no further spans.

Positions are code points, end exclusive. Results for odd input: null text has no spans; repeated rows give repeated
results; an empty table gives an empty result; columns of the input are kept, ``_p_base`` and ``_p_extra`` are added.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, table, without_prefix

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ident")
#: Rows of grouped evidence for a task of the fits.
_FIT_ROWS = 200_000

#: kind: (pattern, cheap test that any text with a match passes, condition on a match m). The look-arounds make each
#: equal to its plain pattern while no start is tried within a run, and keep repeated groups short.
_RULES = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "{t} rlike '[0-9][.][0-9]'", "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", "{t} rlike '[0-9][0-9 -]{{11}}'", "luhn_check(regexp_replace(m, '[ -]', ''))"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15"),
}
_GENERATORS = {
    "email": (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,8}", "{t} rlike '(?i)@|[\\\\[(]\\\\x20?at|\\\\x20at\\\\x20'"),
    "ip": (r"(?i)(?<![0-9.])[0-9]{1,4}+(?:(?:\.|[\[(]\.[\])]|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[0-9]{1,4}+){2,5}(?![0-9])", "{t} rlike '(?i)[0-9]\\\\x20?[\\\\[(.d]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20./-]{1,3})[0-9](?:[\x20./-]{0,3}[0-9]){10,22}(?![\x20./-]{0,3}[0-9])", "{t} rlike '[0-9][0-9 ./-]{{10}}'"),
    "phone": (r"(?<![A-Za-z0-9+])\+?\(?[0-9][\x20().0-9/-]{6,24}(?<=[0-9])(?![0-9])", "{t} rlike '[0-9(][0-9 ()./-]{{6}}'"),
    "ident": (r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9]{8}\x20?-?\x20?[A-Z])(?![A-Za-z0-9])", "{t} rlike '[A-Z][0-9]{{2}}\\\\x20?[A-Z0-9]|[0-9]{{8}}\\\\x20?-?\\\\x20?[A-Z]'"),
}
_CONTEXT = 24
_CUES = {"cue_mail": "e-?mail|courriel|correo|contact|write to|address", "cue_phone": "phone|tel|call|fax|mobil|whatsapp|rufnummer|llama", "cue_card": "card|visa|credit|carte|tarjeta|karte|account|iban", "cue_ip": r"\bip\b|host|server|addr|login|from", "cue_ident": "iban|konto|cuenta|compte|dni|passport|tax"}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, test: str) -> str:
    """SQL for array<struct<s, e, m>> of the matches, from their lengths and those of the gaps between them."""
    p = _quoted(pattern)
    gathered = (
        f"aggregate(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('g', g, 'm', m)), "
        "named_struct('at', 0L, 'out', cast(array() as array<struct<s:bigint,e:bigint,m:string>>)), "
        "(a, x) -> if(x.m is null, a, named_struct('at', a.at + length(x.g) + length(x.m), 'out', array_append(a.out, named_struct('s', a.at + length(x.g), 'e', a.at + length(x.g) + length(x.m), 'm', x.m)))), a -> a.out)"
    )
    return f"if({test.format(t=text)}, {gathered}, cast(array() as array<struct<s:bigint,e:bigint,m:string>>))"


def rule_spans(text: str = "t") -> Column:
    """array<struct<kind, s, e>> of the rules' spans, by kind as listed, then start. ``text``: SQL of a string that is not null."""
    each = []
    for kind, (pattern, test, good) in _RULES.items():
        found = _spans(text, pattern, test)
        each.append(f"transform(filter({found}, x -> exists(array(x.m), m -> {good})), x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e))")
    return F.expr(f"concat({', '.join(each)})")


_CHECKED = "regexp_replace(m, '[ -]', '')"
#: IBAN: the first four letters go to the end, letters count as two digits, and the rest by 97 has to be 1.
_MOD97 = f"int({_CHECKED} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' and aggregate(split(concat(substring({_CHECKED}, 5), left({_CHECKED}, 4)), '(?!^|$)'), 0, (a, x) -> if(x rlike '[0-9]', (a * 10 + int(x)) % 97, (a * 100 + ascii(x) - 55) % 97)) = 1)"
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_MOD23 = f"int({_CHECKED} rlike '^[0-9]{{8}}[A-Z]$' and substring('{_LETTERS}', int(left({_CHECKED}, 8)) % 23 + 1, 1) = right({_CHECKED}, 1))"

#: Numbers that the trees see, as SQL over the match m, the text before it b and the letter after it c. None tells of a
#: rule's own mark (the plus, the at sign), and checks are made on the digits alone, whatever stands between them.
FEATURES = {
    "n": "length(m)", "digits": "length(regexp_replace(m, '[^0-9]', ''))", "letters": "length(regexp_replace(m, '[^A-Za-z]', ''))",
    "seps": "length(regexp_replace(m, '[^ ()./-]', ''))", "dots": "length(regexp_replace(m, '[^.]', ''))", "groups": "size(regexp_extract_all(m, '[0-9]+', 0))",
    "lead": "int(coalesce(nullif(regexp_extract(m, '[0-9]', 0), ''), '0'))", "first": "length(regexp_extract(m, '[0-9]+', 0))", "last": "length(regexp_extract(m, '([0-9]+)[^0-9]*$', 1))", "widest": "coalesce(array_max(transform(regexp_extract_all(m, '[0-9]+', 0), g -> length(g))), 0)",
    "parens": "int(contains(m, '('))", "guarded": r"int(m rlike '[\\[(][^0-9]')", "says_at": r"int(m rlike '(?i)[\\[(] ?at ?[\\])]| at ')", "says_dot": r"int(m rlike '(?i)[\\[(] ?dot ?[\\])]| dot ')",
    "luhn": "int(coalesce(luhn_check(regexp_replace(m, '[^0-9]', '')), false))", "octets": "int(forall(regexp_extract_all(m, '[0-9]+', 0), p -> length(p) <= 3 and int(p) <= 255))",
    "glued": "int(b rlike '[A-Za-z0-9]$' or c rlike '^[A-Za-z0-9]')", "mod97": _MOD97, "mod23": _MOD23,
} | {k: f"int(b rlike {_quoted('(?i)' + v)})" for k, v in _CUES.items()}
NAMES = list(FEATURES)


def candidates(text: str = "t") -> Column:
    """array<struct<kind, s, e, features...>> of everything that the generators propose."""
    each = []
    for kind, (pattern, test) in _GENERATORS.items():
        # m, b and c are bound one after another, so that none is worked out twice
        fields = ", ".join(f"'{k}', double({v})" for k, v in FEATURES.items())
        each.append(
            f"transform({_spans(text, pattern, test)}, x -> element_at(transform(array(named_struct('m', x.m, 'b', substring({text}, greatest(int(x.s) - {_CONTEXT}, 0) + 1, int(x.s) - greatest(int(x.s) - {_CONTEXT}, 0)), 'c', substring({text}, int(x.e) + 1, 1))), "
            f"y -> element_at(transform(array(y.m), m -> element_at(transform(array(y.b), b -> element_at(transform(array(y.c), c -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, {fields})), 1)), 1)), 1)), 1))"
        )
    return F.expr(f"concat({', '.join(each)})")


def _tree_sql(node, names: list[str]) -> str:
    """A regression tree of spark.ml as nested CASE over the fields of c."""
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    return f"if(c.{names[split.featureIndex()]} <= {float(split.threshold())!r}, {_tree_sql(node.leftChild(), names)}, {_tree_sql(node.rightChild(), names)})"


def _score_sql(model, names: list[str]) -> str:
    """Probability of the boosted trees (spark.ml: logistic of twice the margin)."""
    margin = " + ".join(f"{float(w)!r} * {_tree_sql(t._call_java('rootNode'), names)}" for t, w in zip(model.trees, model.treeWeights, strict=True))
    return f"1 / (1 + exp(-2 * ({margin})))"


def _wilson_lower(good: float, n: float, z: float = 1.96) -> float:
    if not n:
        return 0.0
    p = good / n
    p = min(p, 1.0)  # weights are no whole numbers
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_TEN = f"right({_DIGITS}, 10)"
_BBAN = "left(concat(d, '013579246801357924'), 18)"


def _spelled(at: str, dot: str, bare: bool = False) -> str:
    """An address in words; ``bare``: without digits after letters and further host names, so that neither digits nor length tell addresses from words."""
    m = "regexp_replace(concat(substring_index(m, '@', 1), '@', substring_index(substring_index(m, '@', -1), '.', -2)), '(?<=[A-Za-z])[0-9]+', '')" if bare else "m"
    return f"concat(substring_index({m}, '@', 1), '{at}', replace(substring_index({m}, '@', -1), '.', '{dot}'))"


def _grouped(pattern: str) -> str:
    return f"if(length({_DIGITS}) >= 10, regexp_replace({_TEN}, '([0-9]{{3}})([0-9]{{3}})([0-9]{{4}})', '{pattern}'), substring(m, 2))"


def _fours(between: str) -> str:
    return f"regexp_replace({_DIGITS}, '([0-9]{{4}})(?=[0-9])', '$1{between}')"


#: Forms of a rule's span m that the rules do not know, by kind.
FORMS = {
    "email": [_spelled(at, dot, bare) for bare in (False, True) for at, dot in ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "."), (" AT ", " DOT "), (" (at) ", "."))],
    "ip": ["replace(m, '.', '[.]')", "replace(m, '.', '(.)')", "replace(m, '.', ' dot ')", "replace(m, '.', '[dot]')"],
    "card": [_fours("."), _fours("/"), _fours(" - "), _fours(". ")],
    "phone": [_grouped("($1) $2-$3"), _grouped("$1-$2-$3"), _grouped("$1 $2 $3"), _grouped("$1.$2.$3"), _grouped("$1/$2-$3"), "substring(m, 2)", "concat('00', substring(m, 2))"],
}
#: Identifiers made of the digits d of a rule's span.
IDENTS = [
    f"regexp_replace(concat('DE', lpad(98 - cast(concat({_BBAN}, '131400') as decimal(38, 0)) % 97, 2, '0'), {_BBAN}), '(.{{4}})(?=.)', '$1 ')",
    f"concat('DE', lpad(98 - cast(concat({_BBAN}, '131400') as decimal(38, 0)) % 97, 2, '0'), {_BBAN})",
    f"concat(left(d, 8), substring('{_LETTERS}', int(left(d, 8)) % 23 + 1, 1))",
    f"concat(left(d, 8), '-', substring('{_LETTERS}', int(left(d, 8)) % 23 + 1, 1))",
]
#: What is no personal data, of 40 random digits d and some words w of the text.
OTHERS = [
    "left(d, 11)", "left(d, 16)", "regexp_replace(left(d, 16), '([0-9]{4})(?=[0-9])', '$1.')", "regexp_replace(left(d, 16), '([0-9]{4})(?=[0-9])', '$1 - ')", "regexp_replace(left(d, 12), '([0-9]{3})(?=[0-9])', '$1 ')",
    "regexp_replace(left(d, 10), '([0-9]{2})(?=[0-9])', '$1 ')", "regexp_replace(left(d, 10), '([0-9]{5})(?=[0-9])', '$1-')", "concat(left(d, 1), '.', substring(d, 2, 2), '.', substring(d, 4, 4))", "concat(left(d, 3), '.', substring(d, 4, 4), '.', substring(d, 8, 1))",
    "concat('20', left(d, 2), '-0', 1 + int(substring(d, 3, 1)) % 9, '-1', substring(d, 4, 1))", "concat('1', left(d, 1), '/0', 1 + int(substring(d, 3, 1)) % 9, '/19', substring(d, 4, 2))", "concat('20', left(d, 2), '-11-0', 1 + int(substring(d, 3, 1)) % 9, ' 1', substring(d, 4, 1))",
    "concat(3 + int(left(d, 1)) % 7, substring(d, 2, 2), '[.]', 4 + int(substring(d, 4, 1)) % 6, substring(d, 5, 2), '[.]', substring(d, 7, 3))", "concat(substring(d, 1, 1), ' dot ', substring(d, 2, 4), ' dot ', substring(d, 6, 4))", "concat(left(d, 4), '-', substring(d, 5, 4), '/', substring(d, 9, 2))",
    "concat(w, ' at ', w, '.', w)", "concat(w, w, w, ' at ', w, w, '.', w, w, '.', w)", "concat(w, left(d, 3), ' at ', w, substring(d, 4, 2), '.', w)", "concat(w, ' at ', w, substring(d, 4, 2), '.', substring(d, 6, 2))", "concat('DE', left(d, 2), regexp_replace(substring(d, 3, 18), '([0-9]{4})(?=[0-9])', '$1 '))", "concat('GB', left(d, 20))", "concat(left(d, 8), 'K')", "concat(left(d, 8), '-', 'B')",
]


def _chosen(forms: list[str], h: str) -> str:
    return f"case pmod({h}, {len(forms)}) " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"


def places(text: str = "t") -> Column:
    """struct<seen, place>: every rule span with the text about it, and a place of the text chosen by hash."""
    around = f"'b', substring({text}, greatest(int(x.s) - {_CONTEXT}, 0) + 1, int(x.s) - greatest(int(x.s) - {_CONTEXT}, 0)), 'c', substring({text}, int(x.e) + 1, {_CONTEXT})"
    at = f"int(pmod(xxhash64({text}), length({text}) + 1))"
    return F.expr(f"named_struct('seen', transform(_p_base, x -> named_struct('kind', x.kind, 'm', substring({text}, int(x.s) + 1, int(x.e - x.s)), {around})), 'place', substring({text}, {at} + 1, {2 * _CONTEXT}))")


def evidence(stored: DataFrame) -> DataFrame:
    """Candidates (with their features) of all rewritten rule spans (y 1 or 0) and of random groups (y 0, made); k tells one text from another."""
    spans = stored.select(F.xxhash64("_p_key").alias("k"), F.explode("_p_near.seen").alias("x")).select("k", "x.*")
    forms = "case kind " + " ".join(f"when '{kind}' then {_chosen(f, 'h')}" for kind, f in FORMS.items()) + " end"
    hashed = spans.withColumn("h", F.xxhash64(F.lit(1), "k", "kind", "m")).withColumn("d", F.expr(f"left(concat({_DIGITS}, lpad(abs(h) % 1000000007, 10, '7')), 18)"))
    made = hashed.select("k", "b", "c", F.expr(f"array(named_struct('kind', kind, 'v', {forms}), named_struct('kind', 'ident', 'v', {_chosen(IDENTS, 'h')}))").alias("vs"))
    good = made.select("k", "b", "c", F.explode("vs").alias("v")).select("k", "b", "c", "v.*")
    spots = stored.where("length(_p_near.place) > 0").select(F.xxhash64("_p_key").alias("k"), F.col("_p_near.place").alias("p"))
    drawn = spots.select("k", "p", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).withColumn("d", F.expr("left(concat(lpad(abs(xxhash64(k, i)), 19, '4'), reverse(lpad(abs(xxhash64(i, k)), 19, '4')), '17'), 40)"))
    worded = drawn.withColumn("w", F.expr("coalesce(nullif(regexp_extract(p, '[A-Za-z]{2,}', 0), ''), 'page')"))
    half = f"substring(p, 1, {_CONTEXT})", f"substring(p, {_CONTEXT + 1})"
    bad = worded.select("k", F.expr(f"concat({half[0]}, ' ')").alias("b"), F.expr(f"concat(' ', {half[1]})").alias("c"), F.lit("").alias("kind"), F.expr(_chosen(OTHERS, "xxhash64(3, k, i)")).alias("v"))
    texts = good.unionByName(bad).where("v is not null").select("k", "kind", F.length("b").cast("long").alias("s"), F.expr("bigint(length(b) + length(v))").alias("e"), F.expr("concat(b, v, c)").alias("t"))
    found = texts.select("k", F.col("kind").alias("planted"), F.col("s").alias("from"), F.col("e").alias("to"), rule_spans("t").alias("base"), F.explode(candidates("t")).alias("c"))
    free = found.where("c.s < to and from < c.e and not exists(base, x -> x.s < c.e and c.s < x.e)")
    return free.select("c.*", "k", F.expr("if(planted = c.kind and c.s = from and c.e = to, 1.0D, 0.0D)").alias("y"), F.expr("planted = ''").alias("made"))


def gathered(stored: DataFrame) -> DataFrame:
    """The whole evidence: kind, held (out), y, made, features, and n, the number of candidates that are alike in these."""
    return evidence(stored).withColumn("held", F.expr("pmod(xxhash64(k), 2) = 1")).groupBy("kind", "held", "y", "made", *NAMES).agg(F.count(F.lit(1)).alias("n_alike"))


def train(stored: DataFrame, precision: float = 0.9, rounds: int = 8, depth: int = 3) -> dict[str, tuple[str, float]]:
    """kind: (score SQL over a candidate c, threshold), without kinds whose evidence of either sort is too little."""
    taken = materialise(gathered(stored), "pii-evidence")
    spans, spots = stored.agg(F.sum(F.size("_p_near.seen")), F.sum(F.expr("int(length(_p_near.place) > 0)"))).first()
    if not spans or not spots:
        return {}
    counts, rows = {}, {}
    for r in taken.groupBy("kind", "held", "y").agg(F.sum("n_alike").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        counts[r.kind, r.held, r.y] = r.n
        rows[r.kind] = rows.get(r.kind, 0) + r.rows
    # few rows go to one task, in one order: sums of fractions, and so ties between splits, hang on it
    fold = taken.coalesce(1 + sum(rows.values()) // _FIT_ROWS).sortWithinPartitions("kind", "held", "y", "made", *NAMES).withColumn("w", F.expr(f"n_alike * if(made, {min(1.0, spans / spots)!r}D, {min(1.0, spots / spans)!r}D)"))
    ready = VectorAssembler(inputCols=NAMES, outputCol="v").transform(fold.where("not held"))
    scores = {}
    for kind in KINDS:
        if any(counts.get((kind, held, y), 0) < 20 for held in (False, True) for y in (0.0, 1.0)):
            continue
        # with fewer bins than the root of the number of rows, spark.ml would take its split points from a sample of them
        bins = max(32, math.isqrt(rows[kind]) + 1)
        model = GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=0.3, seed=7, checkpointInterval=-1, cacheNodeIds=False).fit(ready.where(F.col("kind") == kind).select("v", "y", "w"))
        scores[kind] = _score_sql(model, NAMES)
    if not scores:
        return {}
    score = "case c.kind " + " ".join(f"when '{k}' then {v}" for k, v in scores.items()) + " end"
    held = fold.where("held").where(F.col("kind").isin(*scores)).select("kind", "y", "w", F.struct("kind", *NAMES).alias("c")).select("kind", "y", "w", F.expr(f"round({score}, 3)").alias("p"))
    learned, good, n = {}, dict.fromkeys(scores, 0.0), dict.fromkeys(scores, 0.0)
    for kind, p, g, m in held.groupBy("kind", "p").agg(F.sum(F.col("y") * F.col("w")), F.sum("w")).orderBy("kind", F.desc("p")).collect():  # at most 1001 scores a kind
        good[kind], n[kind] = good[kind] + g, n[kind] + m
        if _wilson_lower(good[kind], n[kind]) >= precision and p >= 0.5:
            learned[kind] = (scores[kind], p)
    return learned


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **settings) -> DataFrame:
    """The columns ``keep`` (all by default), _p_base and _p_extra: arrays of (kind, s, e), base spans by kind, then start."""
    docs = without_prefix(docs, "_p_")
    names = docs.columns if keep is None else keep
    kept = [F.col(f"`{c}`") for c in names]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = docs.select(*kept, body.alias("_p_text"), F.md5(body).alias("_p_key"))
    stored = materialise(plain.select(*kept, "_p_key", "_p_text", rule_spans("_p_text").alias("_p_base"), candidates("_p_text").alias("_p_cand")).withColumn("_p_near", places("_p_text")).drop("_p_text"), "pii")
    learned = train(stored, **settings)
    nothing = F.expr("cast(array() as array<struct<kind:string,s:bigint,e:bigint>>)")
    if not learned:
        return stored.select(*kept, "_p_base", nothing.alias("_p_extra"))
    score = "case c.kind " + " ".join(f"when '{k}' then {v}" for k, (v, _) in learned.items()) + " else 0.0D end"
    passes = "case c.kind " + " ".join(f"when '{k}' then round(c.p, 3) >= {v!r}" for k, (_, v) in learned.items()) + " else false end"
    free = "not exists(_p_base, x -> x.s < c.e and c.s < x.e)"
    scored = F.expr(f"filter(transform(filter(_p_cand, c -> {free}), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'p', {score})), c -> {passes})")
    # of overlapping candidates the likeliest stays, then the longest, the first, the first kind
    better = "(x.p > c.p or x.p = c.p and (x.e - x.s > c.e - c.s or x.e - x.s = c.e - c.s and (x.s < c.s or x.s = c.s and x.kind < c.kind)))"
    extra = F.expr(f"transform(array_sort(transform(filter(_p_scored, c -> not exists(_p_scored, x -> x.s < c.e and c.s < x.e and {better})), c -> named_struct('s', c.s, 'kind', c.kind, 'e', c.e))), c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e))")
    return stored.withColumn("_p_scored", scored).select(*kept, "_p_base", extra.alias("_p_extra"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def all_spans(base: str = "_p_base", extra: str = "_p_extra") -> Column:
    """Base and further spans together, by kind as listed, then start."""
    order = "case {0}.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    return F.expr(f"array_sort(concat({base}, {extra}), (a, b) -> case when {order.format('a')} <> {order.format('b')} then {order.format('a')} - {order.format('b')} when a.s <> b.s then int(sign(a.s - b.s)) else int(sign(a.e - b.e)) end)")


def redact(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans go together, under the first one's kind."""
    judged = judge(docs, text, **settings)
    at = f"`{text}`"
    by_start = "array_sort(transform(concat(_p_base, _p_extra), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    # upto: what of the text is written; a span that starts before it belongs to the one before
    folded = (
        f"aggregate({by_start}, named_struct('upto', 0L, 'out', ''), (a, x) -> named_struct('upto', greatest(a.upto, x.e), "
        f"'out', if(x.s < a.upto, a.out, concat(a.out, substring({at}, int(a.upto) + 1, int(x.s - a.upto)), '[', upper(x.kind), ']'))), "
        f"a -> concat(a.out, substring({at}, int(a.upto) + 1)))"
    )
    clean = F.expr(f"if({at} is null or size(_p_base) + size(_p_extra) = 0, {at}, {folded})")
    return judged.withColumn(text, clean).select(*docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    counts = [F.size(F.expr(f"filter(_p_base, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in BASE]
    return judged.select("doc_id", *counts, F.sha2(joined(F.col("_p_base")), 256).alias("base_sha256"), joined(all_spans()).alias("spans"))
