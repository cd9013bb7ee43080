"""Training samples from rollouts: traces worth a look, main and auxiliary samples, mixing of sources, budgets, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states that count as hard errors.
HARD_ERRORS = ("SYNTAX_ERROR", "RUNTIME_ERROR", "TIMEOUT")
SCORES = ("hard_errors", "compile_failures", "soft_failures", "most_soft", "unsolved", "full_text")


def trace_scores(nodes: DataFrame, by: str, status: str, pass_rate: str, compile_score: str, format_ok: str, soft: str, full: str) -> DataFrame:
    """Six numbers a rollout, over its nodes: hard errors, compile or format failures, unsolved ones with soft reward, the most of it, unsolved ones, whether a node has its full text."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    unsolved = zero(pass_rate) < 1
    flags = (
        F.coalesce(F.col(status).isin(*HARD_ERRORS), F.lit(False)), (zero(compile_score) < 1) | ~F.coalesce(F.col(format_ok), F.lit(False)),
        unsolved & (zero(soft) > 0), None, unsolved,
    )
    sums = [F.sum(f.cast("double")).alias(n) for n, f in zip(SCORES, flags, strict=False) if f is not None]
    most = F.max(F.when(unsolved, F.greatest(zero(soft), F.lit(0.0))).otherwise(0.0)).alias("most_soft")
    return nodes.groupBy(by).agg(*sums, most, F.max(F.coalesce(F.col(full), F.lit(False)).cast("double")).alias("full_text"))


def selected_traces(scores: DataFrame, by: str, most: int = 0, wanted: Sequence | None = None) -> DataFrame:
    """The wanted rollouts, or all by their scores, worst first (equal ones by ``by``); at most ``most`` if that is positive."""
    out = scores.where(F.col(by).isin(*wanted)) if wanted else scores.orderBy(*[F.desc(c) for c in SCORES], by)
    if most <= 0:
        return out
    return (out.orderBy(by) if wanted else out).limit(most)


def trace_due(step: Column, every: int, written: Column, most: int) -> Column:
    """Whether a trace is written: every so many steps (a negative interval counts as its size), as long as fewer than ``most`` were (0: no bound)."""
    return (F.pmod(step, F.lit(max(abs(every), 1))) == 0) & (written < most if most > 0 else F.lit(True))


def public_metrics(metrics: Column, names: Sequence[str], prefixes: Sequence[str] = (), deviations: bool = True) -> Column:
    """Of a map of metrics those on the list or with a prefix; without ``deviations`` none that ends in _std."""

    def good(k: Column, _: Column) -> Column:
        out = k.isin(*names)
        for p in prefixes:
            out |= F.startswith(k, F.lit(p))
        return out if deviations else out & ~F.endswith(k, F.lit("_std"))

    return F.map_filter(metrics, good)


def main_samples(nodes: DataFrame, completion: str, mask: str) -> DataFrame:
    """Nodes with a completion as samples: no weight and no mask for the supervised part."""
    return nodes.where(F.coalesce(F.col(completion), F.lit("")) != "").withColumns({"sft_mask": F.expr(f"transform({mask}, x__ -> 0)"), "sft_weight": F.lit(0.0)})


def aux_samples(cases: DataFrame, by: str, target: str, passed: str, kind: str, key: Sequence[str], n: int, right: bool = True, wrong: bool = True, errors: bool = True, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The n simplest cases of a program as samples that ask for its output: weight by whether it passed.

    Cases without a target text are left out, and passed ones, failed ones or errors where not wanted. ``key`` orders
    them, simplest first, and is distinct within ``by``.
    """
    full = F.coalesce(F.col(target), F.lit("")) != ""
    for wanted, out in ((right, F.col(passed)), (wrong, ~F.col(passed)), (errors, F.col(kind) != "OK")):
        full &= F.lit(True) if wanted else ~out
    rows = cases.where(full).withColumn("sft_weight", F.when(F.col(passed), weights[0]).otherwise(weights[1]))
    # the planner keeps the first n of a window of ranks before the shuffle: no group is brought together whole
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def mixed_sources(slots: DataFrame, step: str, slot: str, forced: Column, keep: Column, keep_probability: Column, forced_share: float, pool_size: Column) -> DataFrame:
    """Adds source (original or iterative) and forced_original to the slots of a step.

    ``forced`` and ``keep`` are uniform numbers of the slot. A share of slots is forced to the original; else odd places
    (step and slot together) and slots whose original is not kept take one from the pool, where it has any.
    """
    forced_ = (F.lit(forced_share) > 0) & (forced < forced_share)
    odd = F.pmod(F.col(step) + F.col(slot), F.lit(2)) == 1
    dropped = (keep_probability < 1) & (keep > keep_probability)
    iterative = ~forced_ & (odd | dropped) & (pool_size > 0)
    return slots.withColumns({"source": F.when(iterative, "iterative").otherwise("original"), "forced_original": forced_ & (pool_size > 0)})


def unseen(questions: DataFrame, seen: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The next n questions, in their order, that were not asked yet: each is covered once before any source is mixed in."""
    return questions.join(seen.select(key).distinct(), key, "left_anti").orderBy(order, key).limit(n)


def budget(prompt: Column, requested: Column, cap: int, reserve: int) -> tuple[Column, Column]:
    """New tokens allowed beside a prompt, and whether the reserve is met. A cap of 0 is none."""
    if cap <= 0:
        return requested, F.lit(True)
    room = F.greatest(F.lit(cap) - prompt, F.lit(0))
    met = F.lit(True) if reserve <= 0 else room >= F.least(requested, F.lit(reserve))
    return F.least(requested, F.greatest(room, F.lit(1))), met


def history_start(lengths: str, prompt: str, requested: str, cap: int, reserve: int) -> Column:
    """How many of the oldest history items are dropped until the reserve is met; all of them if it never is. ``lengths``: tokens of each item, oldest first."""
    if cap <= 0 or reserve <= 0:
        return F.lit(0)
    left = f"{prompt} + aggregate(slice({lengths}, i__ + 1, size({lengths})), 0, (s__, x__) -> s__ + int(x__))"
    fits = f"filter(sequence(0, size({lengths})), i__ -> greatest({cap} - ({left}), 0) >= least({requested}, {reserve}))"
    return F.expr(f"coalesce(try_element_at({fits}, 1), size({lengths}))")


def history_summary(history: str) -> tuple[Column, Column]:
    """Two texts from an array of rounds (status, failed_input, failed_actual, error, compile_score), oldest first.

    The latest round: a line for each field that it has. The earlier ones: their number, the counts of each status, sorted
    by its name, the failed input met most often if twice at least (of equals the first), whether any failed to compile.
    """
    last = f"element_at({history}, -1)"
    line = lambda label, text: f"if({text} is null, null, concat('- {label}=', {text}))"
    shown = lambda x: f"nullif(trim({x}), '')"
    latest = [line("latest_status", shown(f"{last}.status")), line("failed_input", f"{last}.failed_input"), line("actual_result_or_error", f"{last}.failed_actual"), line("error_summary", shown(f"{last}.error"))]
    lines = lambda parts: f"array_join(filter(array({', '.join(parts)}), l__ -> l__ is not null), '\\n')"
    before = f"slice({history}, 1, size({history}) - 1)"
    states = f"filter(transform({before}, h__ -> {shown('h__.status')}), x__ -> x__ is not null)"
    counted = f"array_join(transform(array_sort(array_distinct({states})), s__ -> concat(s__, ':', size(filter({states}, x__ -> x__ = s__)))), ', ')"
    inputs = f"filter(transform({before}, h__ -> h__.failed_input), x__ -> x__ is not null)"
    often = f"transform(array_distinct({inputs}), (v__, i__) -> named_struct('n', size(filter({inputs}, x__ -> x__ = v__)), 'i', -i__, 'v', v__))"
    repeated = f"if(size({inputs}) = 0 or array_max({often}).n < 2, null, array_max({often}).v)"
    earlier = [f"concat('- earlier_rounds=', size({before}))", line("status_counts", f"nullif({counted}, '')"), line("repeated_failure_input", repeated),
               f"if(exists({before}, h__ -> coalesce(h__.compile_score, 0D) <= 0), '- some_earlier_attempts_failed_to_compile', null)"]
    empty = f"coalesce(size({history}), 0) < {{}}"
    return F.expr(f"if({empty.format(1)}, '', {lines(latest)})"), F.expr(f"if({empty.format(2)}, '', {lines(earlier)})")


def same_manifest(stored: str, current: str) -> Column:
    """Whether two maps of settings have the same fields with the same values: a run may go on only then."""
    return F.expr(f"size({stored}) = size({current}) and forall(map_entries({current}), e__ -> map_contains_key({stored}, e__.key) and {stored}[e__.key] <=> e__.value)")


def next_batch(pending: DataFrame, done: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """The next batch of a job that can be taken up again: of the rows not decided yet the first ``size`` in order."""
    return pending.join(done.select(key).distinct(), key, "left_anti").orderBy(order, key).limit(size)
