"""Preparation of token ids for training: masks, cuts, and marks at both ends. Arguments are SQL fragments of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def completion_mask(prompt: str, whole: str) -> Column:
    """0 for as many places as the prompt has, 1 for the rest of the whole sequence."""
    return F.expr(f"concat(array_repeat(0, size({prompt})), array_repeat(1, greatest(size({whole}) - size({prompt}), 0)))")


def is_prefix(prompt: str, whole: str) -> Column:
    """Whether the prompt's ids open the whole sequence; where not, the mask is off and callers may warn."""
    return F.expr(f"slice({whole}, 1, size({prompt})) = {prompt}")


def completion_start(offsets: str, letters: str) -> Column:
    """The first token (0-based) that starts at or after so many letters, the length if none does."""
    found = f"int(array_position(transform({offsets}, o__ -> o__.s >= {letters}), true))"
    return F.expr(f"if({found} = 0, size({offsets}), {found} - 1)")


def with_bos(ids: str, bos: int | None) -> Column:
    """``bos`` in front unless it is there; without one the ids as they are."""
    return F.expr(ids if bos is None else f"if(try_element_at({ids}, 1) <=> {bos}, {ids}, concat(array({bos}), {ids}))")


def with_eos(ids: str, eos: int) -> Column:
    """``eos`` at the end unless it is there."""
    return F.expr(f"if(try_element_at({ids}, -1) <=> {eos}, {ids}, concat({ids}, array({eos})))")


def _stop(ids: str, stop: int) -> str:
    return f"if(array_position({ids}, {stop}) = 0, size({ids}), int(array_position({ids}, {stop})))"


def after_stop(ids: str, stop: int, pad: int) -> Column:
    """The ids with ``pad`` after the first stop token."""
    return F.expr(f"transform({ids}, (x__, i__) -> if(i__ >= {_stop(ids, stop)}, {pad}, x__))")


def after_stop_mask(ids: str, stop: int) -> Column:
    """1 up to the first stop token and on it, 0 after it."""
    return F.expr(f"transform({ids}, (x__, i__) -> if(i__ >= {_stop(ids, stop)}, 0, 1))")


def collated(prompt: str, completion: str, most: int) -> tuple[Column, Column]:
    """Ids and labels of a chat row: prompt and completion, -100 on the prompt; of over-long rows the end is kept."""
    start = f"greatest(size({prompt}) + size({completion}) - {most}, 0) + 1"
    ids = f"concat({prompt}, {completion})"
    labels = f"concat(array_repeat(-100, size({prompt})), {completion})"
    return F.expr(f"slice({ids}, {start}, {most})"), F.expr(f"slice({labels}, {start}, {most})")


def cut_code(ids: str, most: int, format_ok: str) -> tuple[Column, Column]:
    """Code ids up to a cap, and whether the format is still right: what is cut off never is."""
    return F.expr(f"slice({ids}, 1, {most})"), F.expr(f"{format_ok} and size({ids}) <= {most}")


def matches(predicted: str, labels: str) -> tuple[Column, Column]:
    """Right and all unmasked places (label not -100): their sums' ratio is the token accuracy."""
    pairs = f"filter(zip_with({predicted}, {labels}, (p__, l__) -> if(l__ = -100, null, int(p__ = l__))), x__ -> x__ is not null)"
    return F.expr(f"aggregate({pairs}, 0L, (s__, x__) -> s__ + x__)"), F.expr(f"bigint(size({pairs}))")


def sequence_logp(logps: str, labels: str, average: bool = False) -> Column:
    """Sum of the log-probabilities of the unmasked places, or their mean (null where all are masked)."""
    masked = f"aggregate(zip_with({logps}, {labels}, (p__, l__) -> if(l__ = -100, 0D, p__)), 0D, (s__, x__) -> s__ + x__)"
    return F.expr(f"{masked} / nullif(size(filter({labels}, l__ -> l__ <> -100)), 0)" if average else masked)


def rectified_terms(logps: str, labels: str) -> tuple[Column, Column]:
    """Numerator and denominator of the reward-rectified loss: minus p log p over the unmasked places, and their number."""
    terms = f"zip_with({logps}, {labels}, (p__, l__) -> if(l__ = -100, 0D, -exp(p__) * p__))"
    return F.expr(f"aggregate({terms}, 0D, (s__, x__) -> s__ + x__)"), F.expr(f"size(filter({labels}, l__ -> l__ <> -100))")


def shared_prefix(a: str, b: str) -> Column:
    """How many ids two sequences share at their start."""
    n = f"least(size({a}), size({b}))"
    return F.expr(f"coalesce(nullif(int(array_position(zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (x__, y__) -> x__ <> y__), true)), 0) - 1, {n})")


def unpaired(prompt: str, answer: str, most: int, bos: int | None, eos: int) -> dict[str, Column]:
    """Prompt, ids and labels of an unpaired row. Places for marks that are missing are reserved in ``most``; only the
    answer is cut. A prompt beyond the cap makes the cut count from the answer's end, as a negative bound does."""
    no_bos, no_eos = f"not try_element_at({prompt}, 1) <=> {'null' if bos is None else bos}", f"not try_element_at({answer}, -1) <=> {eos}"
    room = f"({most} - if(size({prompt}) > 0 and {no_bos}, 1, 0) - if(size({answer}) > 0 and {no_eos}, 1, 0) - size({prompt}))"
    kept = f"if(size({answer}) <= {room}, {answer}, slice({answer}, 1, if({room} >= 0, {room}, greatest(size({answer}) + {room}, 0))))"
    opened = prompt if bos is None else f"if({no_bos}, concat(array({bos}), {prompt}), {prompt})"
    closed = f"if(try_element_at({kept}, -1) <=> {eos}, {kept}, concat({kept}, array({eos})))"
    labels = f"concat(transform({opened}, x__ -> -100), {closed})"
    return {"prompt_ids": F.expr(opened), "ids": F.expr(f"concat({opened}, {closed})"), "labels": F.expr(labels)}


def pair_answers(prompt_sizes: tuple[str, str], answers: tuple[str, str], most: int) -> tuple[Column, Column]:
    """Both answers of a pair. Where a prompt and the longer answer are beyond ``most``, that answer is cut to ``most``
    less the longer answer's length (from its end where that is negative), not to the room beside the prompt."""
    longer = f"greatest(size({answers[0]}), size({answers[1]}))"
    cut = lambda p, a: f"if({p} + {longer} > {most}, slice({a}, 1, if({most} >= {longer}, {most} - {longer}, greatest(size({a}) + {most} - {longer}, 0))), {a})"
    return tuple(F.expr(cut(p, a)) for p, a in zip(prompt_sizes, answers, strict=True))


def shared_prompt(prompt: str, chosen: str, rejected: str) -> Column:
    """The prompt's ids as far as both sides' prompts go. Sides that differ in more than one token or one place are an error."""
    n = f"least(size({chosen}), size({rejected}))"
    apart = f"size(filter(zip_with(slice({chosen}, 1, {n}), slice({rejected}, 1, {n}), (x__, y__) -> x__ <> y__), d__ -> d__))"
    good = f"{apart} <= 1 and abs(size({chosen}) - size({rejected})) <= 1"
    return F.when(F.expr(good), F.expr(f"slice({prompt}, 1, {n})")).otherwise(F.raise_error(F.lit("the prompts of a pair differ")))
