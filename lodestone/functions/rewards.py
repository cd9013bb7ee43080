"""Rewards and scores of completions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def overlong_penalty(length: Column, most: int, cache: int) -> Column:
    """0 up to the cache, then falling in a line to -1 at the most, -1 beyond."""
    return F.when(length <= most - cache, 0.0).when(length <= most, (most - cache - length) / cache).otherwise(-1.0)


def soft_unit(c: Column, low: float, high: float) -> Column:
    """Clipped and scaled to 0..1; 0.5 where the interval has no width."""
    return F.lit(0.5) if high <= low else (clamp(c, low, high) - low) / (high - low)


def bounded_beta(scale: float, n: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(scale / n, (1 - 1e-6) / n))


def composite(pass_rate: Column, format_ok: Column, soft: Column, compiled: Column, eligible: Column, soft_weight: float, compile_scale: float, format_scale: float, aux_scale: float = 1.0) -> Column:
    """Pass rate plus soft, compile and format parts, clamped to 0..1, as are all weights; the parts shrink where the format is not right."""
    soft_weight, compile_scale, format_scale, aux_scale = (min(1.0, max(0.0, w)) for w in (soft_weight, compile_scale, format_scale, aux_scale))
    aux = F.when(format_ok, 1.0).otherwise(aux_scale)
    part = F.when(eligible, clamp(soft, 0.0, 1.0)).otherwise(clamp(soft, 0.0, 1.0) * 0.3)
    return clamp(clamp(pass_rate, 0.0, 1.0) + aux * soft_weight * part + aux * compile_scale * clamp(compiled, 0.0, 1.0) + format_scale * format_ok.cast("double"), 0.0, 1.0)


def raw_soft(code: str, problem: str) -> Column:
    """Mean difference of two arrays of log-probabilities over the pairs where both are finite; null for none."""
    pairs = f"filter(zip_with({code}, {problem}, (c__, p__) -> c__ - p__), d__ -> d__ is not null and not isnan(d__) and abs(d__) < double('Infinity'))"
    return F.expr(f"if(size({pairs}) = 0, null, aggregate({pairs}, 0D, (s__, d__) -> s__ + d__) / size({pairs}))")


def hard_reward(passed: Column | str) -> Column:
    """Share of true flags; 0 for none."""
    return F.when(F.size(passed) == 0, 0.0).otherwise(F.size(F.filter(passed, lambda x: x)) / F.size(passed))


def status_code(kinds: Column | str) -> Column:
    """Of the cases' outcomes: all PASS (or none at all) is CORRECT, then SYNTAX, TIMEOUT, RUNTIME, else FAIL."""
    has = lambda k: F.exists(kinds, lambda x: x == k)
    return F.when(F.forall(kinds, lambda x: x == "PASS"), "CORRECT").when(has("SYNTAX_ERROR"), "SYNTAX_ERROR").when(has("TIMEOUT"), "TIMEOUT").when(has("RUNTIME_ERROR"), "RUNTIME_ERROR").otherwise("FAIL")


def iterative_priority(p: Column, soft: Column, prior: Column) -> Column:
    return F.greatest(F.greatest(F.lit(1e-6), 4 * p * (1 - p) + 0.1 * F.greatest(F.lit(0.0), soft)) * prior, F.lit(1e-6))


# Limits and weights of a question's prior.
PRIOR_HIGH, PRIOR_LOW, PRIOR_GAP, PRIOR_SEEN = 0.7, 0.3, 0.2, 3
PRIOR_WEIGHTS = {"mastered": 0.4, "too_hard": 0.2, "high_value": 1.0, "mid_negative_gap": 0.7, "default": 0.8}


def prior_weight(code: Column, reason: Column, seen: Column, high: float = PRIOR_HIGH, low: float = PRIOR_LOW, gap: float = PRIOR_GAP, least_seen: int = PRIOR_SEEN) -> Column:
    """Weight of a question by its moving values of solved code and of reasoning; the first rule that holds."""
    w = PRIOR_WEIGHTS
    return (
        F.when((code >= high) & (reason >= high), w["mastered"]).when((code <= low) & (reason <= low) & (seen >= least_seen), w["too_hard"])
        .when(reason - code >= gap, w["high_value"]).when(code - reason >= gap, w["mid_negative_gap"]).otherwise(w["default"])
    )


def reason_signal(triggered: Column, soft: Column, hard: Column) -> Column:
    """What a rollout says of the reasoning: the soft reward where it was in use, else the hard one, within 0..1."""
    return clamp(F.when(triggered > 0, soft).otherwise(hard), 0.0, 1.0)


def keep_probability(prior: Column, streak: Column, age: Column, threshold: int = 2, decay: float = 0.5, per_step: float = 0.0, most: float = 0.0, floor: float = 0.1, prior_floor: float = 0.05) -> Column:
    """Chance that an original question stays in the pool.

    Its prior weight, decayed for each rollout without a pass beyond the threshold, plus a bonus by the steps since its
    last rollout (negative: never rolled out, no bonus), at most ``most`` and 1 in all. A null streak is a question without
    a state. Floors: ``prior_floor``, and once decay sets in the greater of both.
    """
    bonus = F.when((age >= 0) & F.lit(per_step > 0), F.least(F.lit(most), age * per_step)).otherwise(0.0)
    over = streak - threshold
    held = F.greatest(F.lit(prior_floor), F.least(F.lit(1.0), prior + bonus))
    decayed = F.greatest(F.lit(max(floor, prior_floor)), F.least(F.lit(1.0), F.pow(F.lit(decay), over) * prior + bonus))
    return F.when(F.coalesce(over > 0, F.lit(False)), decayed).otherwise(held)


def density_weight(p: Column, low: float = 0.1, high: float = 10.0) -> Column:
    return clamp(p / (1 - p + 1e-8), low, high)


def missing_eos(score: Column, has_eos: Column, penalty: float) -> Column:
    return F.when(has_eos, score).otherwise(score - penalty)


def judges(verdicts: Column | str) -> Column:
    """-1 if any failed, 1 if all say 1, else 0; other values are an error."""
    known = F.forall(verdicts, lambda v: v.isin(-1, 0, 1))
    return F.when(~known, F.raise_error("verdicts are -1, 0 or 1")).when(F.exists(verdicts, lambda v: v == -1), -1).when(F.forall(verdicts, lambda v: v == 1), 1).otherwise(0).cast("int")


def unflipped(rank: Column, flipped: Column) -> Column:
    return F.when(flipped, 1 - rank).otherwise(rank)


def soft_win(a: Column, b: Column, temperature: float = 1.0) -> Column:
    """Softmax share of the first score."""
    return 1 / (1 + F.exp((b - a) / temperature))


def ema_rate(t: Column, lag: float, multiplier: float, power: float, least: float) -> Column:
    return F.greatest(F.pow(lag + multiplier * t, F.lit(-power)), F.lit(least))


def reasoning_answer(text: Column, delimiters: list[str]) -> Column:
    """What follows the last occurrence of the first delimiter that is there; null for none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(d)), F.substring_index(text, d, -1)) for d in delimiters])


def numeric_equal(answer: Column, gold: Column) -> Column:
    """1 or 0 for decimal and fractional answers; null where the gold one is no number."""

    def number(c: Column) -> Column:
        bare = F.regexp_replace(c, r"[\s$,]|\\boxed\{|\}", "")
        fraction = F.regexp_extract(bare, r"^(-?[0-9.]+)/([0-9.]+)$", 1), F.regexp_extract(bare, r"^(-?[0-9.]+)/([0-9.]+)$", 2)
        return F.when(fraction[0] != "", fraction[0].try_cast("double") / F.nullif(fraction[1].try_cast("double"), F.lit(0.0))).otherwise(bare.try_cast("double"))

    a, g = number(answer), number(gold)
    return F.when(g.isNotNull(), F.coalesce(F.abs(a - g) <= 1e-6, F.lit(False)).cast("double"))


def reasoning_accuracy(text: Column, gold: Column, delimiters: list[str]) -> Column:
    """The accuracy of what follows the reasoning; 0 where no delimiter ends it."""
    answer = reasoning_answer(text, delimiters)
    return F.when(answer.isNull(), 0.0).otherwise(numeric_equal(answer, gold))
