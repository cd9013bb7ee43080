"""Training losses as numbers: column expressions over log-probabilities. No gradients.

Pair losses take four columns: policy and reference log-probabilities of the chosen and the rejected side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logsigmoid(x: Column) -> Column:
    """log(1 / (1 + exp(-x))) without overflow on either side."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def log1mexp(x: Column) -> Column:
    """log(1 - exp(x)) for x < 0."""
    return F.when(x > -0.6931471805599453, F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def divergence_scores(kind: str, ratio: Column, alpha: float = 0.5) -> Column:
    """Score of a log-ratio under an f-divergence: reverse_kl, forward_kl, js_divergence or alpha_divergence."""
    if kind == "reverse_kl":
        return ratio
    if kind == "forward_kl":
        return -F.exp(-ratio)
    if kind == "js_divergence":
        return logsigmoid(ratio)
    if kind == "alpha_divergence":
        if abs(alpha - 1.0) < 1e-6:  # the limit is the logarithm
            return ratio
        return F.exp(F.least(ratio * (alpha - 1.0), F.lit(80.0))) * (1.0 / (alpha - 1.0))
    raise ValueError(f"divergence {kind!r}")


PREFERENCE = ("sigmoid", "hinge", "ipo", "exo_pair", "nca_pair", "robust", "bco_pair", "sppo_hard", "apo_zero", "apo_down", "discopop")


def preference_loss(kind: str, chosen: Column, rejected: Column, beta: float = 0.1, smoothing: float = 0.0, chosen_len: Column | None = None, rejected_len: Column | None = None, tau: float = 0.05) -> Column:
    """A pair's loss from the two sides' scores (log-ratios to the reference)."""
    delta = chosen - rejected
    z, c, r = beta * delta, beta * chosen, beta * rejected
    if kind == "sigmoid":
        return -logsigmoid(z)
    if kind == "hinge":
        return relu(1 - z)
    if kind == "ipo":
        at_least_one = lambda n: F.greatest(n.cast("double"), F.lit(1.0))
        gap = chosen / at_least_one(chosen_len) - rejected / at_least_one(rejected_len) - 1 / (2 * beta)
        return gap * gap
    if kind == "exo_pair":
        return sigmoid(z) * (logsigmoid(z) - F.log1p(F.lit(-smoothing))) + sigmoid(-z) * (logsigmoid(-z) - F.log(F.lit(smoothing)))
    if kind == "nca_pair":
        return -logsigmoid(c) - 0.5 * logsigmoid(-c) - 0.5 * logsigmoid(-r)
    if kind == "robust":
        return (-(1 - smoothing) * logsigmoid(z) + smoothing * logsigmoid(-z)) / (1 - 2 * smoothing)
    if kind == "bco_pair":
        return -logsigmoid(c) - logsigmoid(-r)
    if kind == "sppo_hard":
        return (chosen - 0.5 / beta) * (chosen - 0.5 / beta) + (rejected + 0.5 / beta) * (rejected + 0.5 / beta)
    if kind == "apo_zero":
        return 1 - sigmoid(c) + sigmoid(r)
    if kind == "apo_down":
        return sigmoid(c) + 1 - sigmoid(z)
    if kind == "discopop":
        share = sigmoid(z / tau)
        return -logsigmoid(z) * (1 - share) + F.exp(-z) * share
    raise ValueError(f"loss {kind!r}")


def rank_joined(df: DataFrame, left: str, right: str, batch: str) -> DataFrame:
    """(batch, left, right): both columns sorted on their own within a batch and joined by rank."""
    a = df.select(batch, left, F.row_number().over(Window.partitionBy(batch).orderBy(left)).alias("_rank"))
    b = df.select(batch, right, F.row_number().over(Window.partitionBy(batch).orderBy(right)).alias("_rank"))
    return a.join(b, [batch, "_rank"]).select(batch, left, right)


def aot_loss(delta: Column, beta: float, smoothing: float) -> Column:
    return -logsigmoid(beta * delta) * (1 - smoothing) - logsigmoid(-beta * delta) * smoothing


def cpo_loss(kind: str, chosen: Column, rejected: Column, beta: float = 0.1, smoothing: float = 0.0, gamma: float = 0.5) -> Column:
    """Reference-free pair losses."""
    gap = chosen - rejected
    if kind == "simpo":
        z = gap - gamma / beta
    else:
        z = gap
    if kind in ("sigmoid", "simpo"):
        return -logsigmoid(beta * z) * (1 - smoothing) - logsigmoid(-beta * z) * smoothing
    if kind == "hinge":
        return relu(1 - beta * z)
    if kind == "ipo":
        return (z - 1 / (2 * beta)) * (z - 1 / (2 * beta))
    raise ValueError(f"loss {kind!r}")


def alpha_transform(logp: Column, alpha: float) -> Column:
    """AlphaPO's reward of a length-normalised log-probability: (1 - p^-alpha) / alpha."""
    return logp if alpha == 0 else (1 - F.exp(-alpha * logp)) / alpha


def orpo_terms(chosen: Column, rejected: Column) -> tuple[Column, Column]:
    """Log odds ratio of the sides' mean log-probabilities, and its log-sigmoid."""
    odds = chosen - rejected - (log1mexp(chosen) - log1mexp(rejected))
    return odds, logsigmoid(odds)


def kto_loss(kind: str, ratio: Column, label: Column, kl: Column, beta: float, desirable: float = 1.0, undesirable: float = 1.0) -> Column:
    """Unpaired loss of a row: kto against the batch's KL, or apo_zero_unpaired."""
    if kind == "kto":
        return F.when(label, desirable * (1 - sigmoid(beta * (ratio - kl)))).otherwise(undesirable * (1 - sigmoid(beta * (kl - ratio))))
    if kind == "apo_zero_unpaired":
        return F.when(label, desirable * (1 - sigmoid(beta * ratio))).otherwise(undesirable * sigmoid(beta * ratio))
    raise ValueError(f"loss {kind!r}")


def batch_kl(ratio: Column, over) -> Column:
    """Mean mismatched log-ratio of the batch, not below 0."""
    return F.greatest(F.avg(ratio).over(over), F.lit(0.0))


def bco_loss(reward: Column, label: Column, delta: Column) -> Column:
    return F.when(label, -logsigmoid(reward - delta)).otherwise(-logsigmoid(-(reward - delta)))


def reward_model_loss(chosen: Column, rejected: Column, margin: Column | None = None, centre: float = 0.0) -> Column:
    gap = chosen - rejected if margin is None else chosen - rejected - margin
    return -logsigmoid(gap) + centre * (chosen + rejected) * (chosen + rejected)


def xpo_loss(chosen: Column, rejected: Column, of_reference: Column, beta: float, alpha: float, kind: str = "sigmoid") -> Column:
    """Preference term on the log-ratios (sigmoid or ipo) plus alpha times the model's log-probability of the reference's completion."""
    gap = chosen - rejected
    if kind not in ("sigmoid", "ipo"):
        raise ValueError(f"loss {kind!r}")
    term = -logsigmoid(beta * gap) if kind == "sigmoid" else (gap - 1 / (2 * beta)) * (gap - 1 / (2 * beta))
    return term + alpha * of_reference


def nash_md_loss(logps: str, ref: str, probability: Column, beta: float) -> Column:
    """beta times the sum of log-ratio times log-probability, less (probability - 1/2) times the log-probability. Arrays are masked: 0 where padded."""
    total = F.expr(f"aggregate({logps}, 0D, (s, x) -> s + x)")
    weighted = F.expr(f"aggregate(zip_with({logps}, {ref}, (p, q) -> (p - q) * p), 0D, (s, x) -> s + x)")
    return beta * weighted - (probability - 0.5) * total


# ------------------------------------------------------------------ token losses


POLICY = ("grpo", "bnpo", "dr_grpo", "dapo", "luspo", "cispo", "sapo")


def policy_token_losses(kind: str, logps: str, old: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.2, delta: float | None = None, level: str = "token", tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """Array of token losses. ``level``: token, or sequence (the mean log-ratio of unmasked tokens for all)."""
    ratio = f"zip_with({logps}, {old}, (a, b) -> a - b)"
    if level == "sequence":
        mean = f"aggregate(zip_with({ratio}, {mask}, (x, m) -> x * m), 0D, (s, x) -> s + x) / greatest(aggregate({mask}, 0D, (s, m) -> s + m), 1D)"
        ratio = f"transform({logps}, x -> {mean})"
    coef = f"transform({ratio}, x -> exp(x))"
    if kind == "cispo":
        return F.expr(f"zip_with({coef}, {logps}, (c, x) -> -least(c, {high}D) * {advantage} * x)")
    if kind == "sapo":
        return F.expr(f"transform({coef}, c -> -(4 / if({advantage} > 0, {tau_pos}D, {tau_neg}D)) / (1 + exp(-if({advantage} > 0, {tau_pos}D, {tau_neg}D) * (c - 1))) * {advantage})")
    if kind not in POLICY:
        raise ValueError(f"loss {kind!r}")
    first = "c" if delta is None else f"least(c, {delta}D)"
    return F.expr(f"transform({coef}, c -> -least({first} * {advantage}, greatest(least(c, {1 + high}D), {1 - low}D) * {advantage}))")


def reduce_policy(kind: str, df: DataFrame, losses: str, mask: str, longest: int = 0, by: str | None = None, level: str = "token") -> DataFrame:
    """The batch's loss as column loss (and ``by``, one batch a value). ``level``: of the importance ratios, which luspo's mean depends on."""
    masked = F.expr(f"aggregate(zip_with({losses}, {mask}, (x, m) -> x * m), 0D, (s, x) -> s + x)")
    count = F.expr(f"aggregate({mask}, 0D, (s, m) -> s + m)")
    rows = df.select(*([by] if by else []), masked.alias("_s"), count.alias("_n"), F.expr(f"aggregate({losses}, 0D, (s, x) -> s + x)").alias("_all"), F.size(losses).alias("_size"))
    if kind in ("grpo", "sapo"):
        out = F.avg(F.col("_s") / F.greatest("_n", F.lit(1.0)))
    elif kind == "bnpo":
        out = F.sum("_s") / F.greatest(F.sum("_n"), F.lit(1.0))
    elif kind == "dr_grpo":
        out = F.sum("_s") / (F.count(F.lit(1)) * F.lit(longest))
    elif kind in ("cispo", "dapo"):
        out = F.sum("_s") / F.greatest(F.sum("_n"), F.lit(1.0))
    elif level == "sequence":  # luspo: one loss a sequence, weighted by its length
        out = F.avg(F.col("_all") / F.col("_size") * F.col("_n"))
    else:  # the mean over the batch as a matrix, padded to its longest row
        out = F.sum(F.col("_all") * F.col("_n")) / (F.count(F.lit(1)) * F.max("_size"))
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(out.alias("loss"))


def clip_flags(ratio: Column, advantage: Column, low: float, high: float) -> tuple[Column, Column]:
    """Whether a token is clipped below or above."""
    return (ratio < 1 - low) & (advantage < 0), (ratio > 1 + high) & (advantage > 0)


def ppo_policy_loss(logp: Column, old: Column, advantage: Column, clip: float) -> Column:
    ratio = F.exp(logp - old)
    return F.greatest(-advantage * ratio, -advantage * F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip)))


def ppo_value_loss(value: Column, old: Column, target: Column, clip: float) -> Column:
    clipped = F.greatest(F.least(value, old + clip), old - clip)
    return 0.5 * F.greatest((value - target) * (value - target), (clipped - target) * (clipped - target))


def kl_estimate(kind: str, logp: Column, ref: Column) -> Column:
    """k1: policy less reference log-probability; k3: exp(d) - 1 - d of the reverse difference."""
    d = ref - logp
    return -d if kind == "k1" else F.exp(d) - 1 - d


# ------------------------------------------------------------------ further losses of arrays and weights


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x__, y__) -> x__ * y__), 0D, (s__, x__) -> s__ + x__)"


def _total(a: str) -> str:
    return f"aggregate({a}, 0D, (s__, x__) -> s__ + x__)"


def code_loss(df: DataFrame, logps: str, old: str, advantage: str, code_mask: str, sft_mask: str, sft_weight: str, low: float = 0.2, high: float = 0.2, beta_sft: float = 0.0, by_token: bool = False, by: str | None = None, ref: str | None = None, beta: float = 0.0, mask: str | None = None) -> DataFrame:
    """The code loss of a batch (or of each value of ``by``): a clipped policy term and beta_sft times a weighted supervised term.

    By sequence: means over a sequence's masked tokens, then over sequences. ``by_token``: sums over all masked tokens
    (weighted for the supervised term). Divisors are 1 at least. With ``ref`` and beta also beta times the mean over
    sequences of the k3 divergence over ``mask``.
    """
    ratio = f"zip_with({logps}, {old}, (p__, q__) -> exp(p__ - q__))"
    token = f"transform({ratio}, c__ -> -least(c__ * {advantage}, greatest(least(c__, {1 + high}D), {1 - low}D) * {advantage}))"
    code, n_code = F.expr(_dot(token, code_mask)), F.expr(f"double({_total(code_mask)})")
    sft, n_sft = -F.expr(_dot(logps, sft_mask)), F.expr(f"double({_total(sft_mask)})")
    keep = [F.col(by)] if by else []
    kl = F.lit(0.0)
    if ref is not None and beta:
        apart = f"zip_with({ref}, {logps}, (r__, p__) -> exp(r__ - p__) - (r__ - p__) - 1)"
        kl = F.expr(f"{_dot(apart, mask)} / greatest({_total(mask)}, 1D)")
    rows = df.select(*keep, code.alias("_c"), n_code.alias("_nc"), sft.alias("_s"), n_sft.alias("_ns"), F.col(sft_weight).alias("_w"), kl.alias("_k"))
    one = F.lit(1.0)
    if by_token:
        code_, sft_ = F.sum("_c") / F.greatest(F.sum("_nc"), one), F.sum(F.col("_s") * F.col("_w")) / F.greatest(F.sum(F.col("_ns") * F.col("_w")), one)
    else:
        code_, sft_ = F.avg(F.col("_c") / F.greatest("_nc", one)), F.avg(F.col("_s") / F.greatest("_ns", one) * F.col("_w"))
    return (rows.groupBy(by) if by else rows.groupBy()).agg((code_ + beta_sft * sft_ + beta * F.avg("_k")).alias("loss"))


def pair_weight(logps: str, logits: str, mask: str) -> Column:
    """Weight of a sequence: exp of the mean of its log-probabilities, each less the log of the sum of squared probabilities. A pair's weight is the product of its two. ``logits``: an array of each place's logits."""
    lse = lambda k: f"(array_max(v__) * {k} + ln(aggregate(v__, 0D, (s__, x__) -> s__ + exp({k} * (x__ - array_max(v__))))))"
    norm = f"transform({logits}, v__ -> {lse(2)} - 2 * {lse(1)})"
    return F.expr(f"exp({_dot(f'zip_with({logps}, {norm}, (p__, n__) -> p__ - n__)', mask)} / greatest({_total(mask)}, 1D))")


def perception_terms(logps: str, blind: str, most: float = 0.2) -> Column:
    """Token array of the k3 divergence between log-probabilities without and with the image, between 0 and ``most``."""
    return F.expr(f"zip_with({blind}, {logps}, (b__, p__) -> greatest(least(exp(b__ - p__) - (b__ - p__) - 1, {most}D), 0D))")


def perception_loss(loss: Column, perception: Column, entropy: Column, blind_entropy: Column, weight: float, entropy_weight: float, blind_weight: float) -> Column:
    """The policy loss less the weighted perception term plus both weighted entropies."""
    return loss - weight * perception + entropy_weight * entropy + blind_weight * blind_entropy


def reverse_kl_terms(student: str, teacher: str) -> Column:
    """Per place exp(teacher) (teacher - student) over log-probabilities: what a step's divergence adds up."""
    return F.expr(f"zip_with({student}, {teacher}, (s__, t__) -> exp(t__) * (t__ - s__))")


def online_statistics(df: DataFrame, by: str, model_model: str, model_ref: str, ref_ref: str, ref_model: str, model_wins: str, beta: float, has_end: str) -> DataFrame:
    """Statistics of online preferences from sums of log-probabilities (``model_ref``: the model's of the reference's completion).

    The chosen side is the model's completion where it wins, else the reference's. logps_* add the model's and the
    reference's means, as such logs have it; kl is half the sum of both completions' log-ratios; entropy half the sum of
    both negated log-probabilities; accuracy the share of pairs with a margin above 0.
    """
    win = F.col(model_wins)
    cm, cr = F.when(win, F.col(model_model)).otherwise(F.col(model_ref)), F.when(win, F.col(ref_model)).otherwise(F.col(ref_ref))
    rm, rr = F.when(win, F.col(model_ref)).otherwise(F.col(model_model)), F.when(win, F.col(ref_ref)).otherwise(F.col(ref_model))
    margin = beta * ((cm - cr) - (rm - rr))
    kl = (F.col(model_model) - F.col(ref_model)) + (F.col(model_ref) - F.col(ref_ref))
    return df.groupBy(by).agg(
        (F.avg(cm) + F.avg(cr)).alias("logps_chosen"), (F.avg(rm) + F.avg(rr)).alias("logps_rejected"), F.avg(beta * (cm - cr)).alias("rewards_chosen"), F.avg(beta * (rm - rr)).alias("rewards_rejected"),
        F.avg(margin).alias("margin"), F.avg((margin > 0).cast("double")).alias("accuracy"), (F.avg(kl) / 2).alias("kl"), (F.avg(-F.col(model_model) - F.col(model_ref)) / 2).alias("entropy"), F.avg(F.col(has_end).cast("double")).alias("has_end"),
    )
