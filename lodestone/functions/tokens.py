"""Functions of token sequences as arrays: ragged, masked instead of padded. Arguments are SQL fragments (column names, mostly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: str) -> str:
    """SQL: sum of an array of numbers."""
    return f"aggregate({a}, 0D, (s__, x__) -> s__ + x__)"


def masked(a: str, mask: str) -> str:
    return f"zip_with({a}, {mask}, (x__, m__) -> x__ * m__)"


def masked_mean(a: str, mask: str) -> Column:
    """Mean of the unmasked; an empty mask is an error."""
    return F.expr(f"{total(masked(a, mask))} / if({total(mask)} = 0, raise_error('empty mask'), {total(mask)})")


def masked_var(a: str, mask: str) -> Column:
    """Variance of the unmasked with Bessel's correction."""
    n, s = total(mask), total(masked(a, mask))
    squares = f"aggregate(zip_with({a}, {mask}, (x__, m__) -> m__ * (x__ - {s} / {n}) * (x__ - {s} / {n})), 0D, (s__, x__) -> s__ + x__)"
    return F.expr(f"{squares} / ({n} - 1)")


def whitened(a: str, mask: str, mean: str, var: str, restore_mean: bool = False) -> Column:
    # mean and variance are bound once: in the inner function they would be worked out for every element
    value = f"(x__ - s__.mean) / sqrt(s__.var + 1e-8D){' + s__.mean' if restore_mean else ''}"
    return F.expr(f"element_at(transform(array(named_struct('mean', {mean}, 'var', {var})), s__ -> transform({a}, x__ -> {value})), 1)")


def log_sum_exp(logits: str) -> str:
    return f"(array_max({logits}) + ln({total(f'transform({logits}, x__ -> exp(x__ - array_max({logits})))')}))"


def log_softmax_at(logits: str, index: str) -> Column:
    return F.expr(f"{logits}[{index}] - {log_sum_exp(logits)}")


def entropy(logits: str) -> Column:
    """Of the softmax: log-sum-exp less the expected logit."""
    top, mass = f"array_max({logits})", total(f"transform({logits}, x__ -> exp(x__ - array_max({logits})))")
    return F.expr(f"{top} + ln({mass}) - aggregate({logits}, 0D, (s__, x__) -> s__ + x__ * exp(x__ - {top})) / {mass}")


def gae(rewards: str, values: str, gamma: float, lam: float) -> Column:
    """Generalised advantages, from the end backwards."""
    n = f"size({rewards})"
    delta = f"({rewards}[i__] + {gamma}D * if(i__ + 1 < {n}, {values}[i__ + 1], 0D) - {values}[i__])"
    return F.expr(f"reverse(aggregate(if({n} = 0, cast(array() as array<int>), sequence({n} - 1, 0, -1)), named_struct('a__', 0D, 'out', cast(array() as array<double>)), (s__, i__) -> named_struct('a__', {delta} + {gamma * lam!r}D * s__.a__, 'out', array_append(s__.out, {delta} + {gamma * lam!r}D * s__.a__)), s__ -> s__.out))")


def discounted_suffix(rewards: str, gamma: float, mask: str | None = None, normalise: bool = False) -> Column:
    """Sums from each place to the end of reward times gamma to the power of the place (from the row's start).

    With ``normalise`` by the sum of the same powers over the unmasked places (1e-4 where masked). gamma 0: the rewards.
    """
    masked_ = rewards if mask is None else masked(rewards, mask)
    if gamma <= 0:
        return F.expr(masked_)
    weighted = f"transform({masked_}, (x__, i__) -> x__ * pow({gamma}D, i__))"
    suffix = lambda a: f"reverse(aggregate(reverse({a}), named_struct('a__', 0D, 'out', cast(array() as array<double>)), (s__, x__) -> named_struct('a__', x__ + s__.a__, 'out', array_append(s__.out, x__ + s__.a__)), s__ -> s__.out))"
    if not normalise:
        return F.expr(suffix(weighted))
    ones = f"transform({rewards}, x__ -> 1D)" if mask is None else f"transform({mask}, m__ -> if(m__ < 0.5, 1e-4D, double(m__)))"
    powers = f"transform({ones}, (m__, i__) -> m__ * pow({gamma}D, i__))"
    return F.expr(f"zip_with({suffix(weighted)}, {suffix(powers)}, (a__, b__) -> a__ / b__)")


def k3_kl(ref: str, cur: str) -> Column:
    return F.expr(f"zip_with({ref}, {cur}, (r__, c__) -> exp(r__ - c__) - (r__ - c__) - 1)")


def importance_ratio(cur: str, old: str, mask: str, level: str = "token", cap: float = 2.0, mode: str = "truncate") -> Column:
    """Ratios by token or one for the sequence, cut off at the cap or set to 0 beyond it."""
    limit = (lambda x: f"least({x}, {cap}D)") if mode == "truncate" else (lambda x: f"if({x} > {cap}D, 0D, {x})")
    if level == "token":
        return F.expr(f"zip_with({masked(f'zip_with({cur}, {old}, (a__, b__) -> a__ - b__)', mask)}, {mask}, (d__, m__) -> {limit('exp(d__)')})")
    return F.expr(limit(f"exp({total(masked(f'zip_with({cur}, {old}, (a__, b__) -> a__ - b__)', mask))})"))


def off_policy_keep(advantage: str, cur: str, sampled: str, mask: str, delta: float) -> Column:
    """Whether a sequence stays: advantage not negative, or its mean log-ratio (sampling less current) within delta."""
    kl = f"{total(masked(f'zip_with({sampled}, {cur}, (a__, b__) -> a__ - b__)', mask))} / greatest({total(mask)}, 1D)"
    return F.expr(f"{advantage} >= 0 or {kl} <= {delta}D")


def first_true(flags: str) -> Column:
    """0-based place of the first true, the length if there is none."""
    return F.expr(f"if(array_position({flags}, true) = 0, size({flags}), int(array_position({flags}, true)) - 1)")


def truncated(a: str, n: int, side: str = "start") -> Column:
    return F.expr(f"slice({a}, 1, {n})") if side == "start" else F.expr(f"slice({a}, greatest(size({a}) - {n}, 0) + 1, {n})")


def padded(a: str, length: str, value: str, side: str = "right", multiple: int = 1) -> Column:
    n = f"int(ceil({length} / double({multiple})) * {multiple})"
    fill = f"array_repeat({value}, greatest({n} - size({a}), 0))"
    return F.expr(f"concat({a}, {fill})" if side == "right" else f"concat({fill}, {a})")


def flushed(mask: str, a: str, side: str = "left", fill: str = "0") -> Column:
    """Rotates an array by the leading zeros of its mask, so that the unmasked start (or end) the row."""
    lead = f"coalesce(nullif(int(array_position({mask}, 1)), 0) - 1, size({mask}))"
    tail = f"coalesce(nullif(int(array_position(reverse({mask}), 1)), 0) - 1, size({mask}))"
    if side == "left":
        return F.expr(f"concat(slice({a}, {lead} + 1, size({a})), array_repeat({fill}, {lead}))")
    return F.expr(f"concat(array_repeat({fill}, {tail}), slice({a}, 1, size({a}) - {tail}))")


def position_ids(lengths: str) -> Column:
    """Positions that begin anew with each segment."""
    return F.expr(f"flatten(transform({lengths}, n__ -> if(n__ = 0, cast(array() as array<int>), sequence(0, n__ - 1))))")


def labels(ids: str, mask: str) -> Column:
    return F.expr(f"zip_with({ids}, {mask}, (i__, m__) -> if(m__ = 1, i__, -100))")


def step_labels(steps: str, flags: str, last_only: bool = False) -> Column:
    """For arrays of steps (arrays of ids) and their labels: the label on each step's last token, -100 elsewhere."""
    keep = f"i__ + 1 = size({steps})" if last_only else "true"
    return F.expr(f"flatten(transform({steps}, (s__, i__) -> concat(array_repeat(-100, greatest(size(s__) - 1, 0)), if(size(s__) = 0, cast(array() as array<int>), array(if({keep}, int({flags}[i__]), -100))))))")


def span_mask(offsets: str, low: str, high: str) -> Column:
    """1 for the tokens (s, e) that overlap the letters low..high."""
    return F.expr(f"transform({offsets}, o -> int(greatest(o.s, {low}) < least(o.e, {high})))")


def generalised_jsd(student: str, teacher: str, beta: float) -> Column:
    """Of two arrays of log-probabilities: beta 0 is forward KL (teacher), 1 reverse (student), else the mixture's."""
    kl = lambda p, q: total(f"zip_with({p}, {q}, (a__, b__) -> exp(a__) * (a__ - b__))")
    if beta == 0:
        return F.expr(kl(teacher, student))
    if beta == 1:
        return F.expr(kl(student, teacher))
    mixture = f"zip_with({student}, {teacher}, (s__, t__) -> ln({1 - beta}D * exp(s__) + {beta}D * exp(t__)))"
    return F.expr(f"{beta}D * {kl(teacher, mixture)} + {1 - beta}D * {kl(student, mixture)}")


def sorted_l1(p: str, q: str) -> Column:
    """L1 distance of two distributions sorted from high to low, the shorter padded with 0."""
    return F.expr(total(f"zip_with(array_sort({p}, (a__, b__) -> int(sign(b__ - a__))), array_sort({q}, (a__, b__) -> int(sign(b__ - a__))), (a__, b__) -> abs(coalesce(a__, 0D) - coalesce(b__, 0D)))"))
