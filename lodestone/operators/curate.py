"""Corpus curation: reject reasons, exact and near de-duplication, quotas, splits, representative cases, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators.groups import _checkpoint_dir, numbered

# What marks interactive and file-reading problems, and packages that programs may not import.
INTERACTIVE = ("interactive", "flush", "output flushing", "hacked interaction")
FILE_IO = ("input.txt", "output.txt", "read from file", "write to file", "file input", "file output")
PACKAGES = ("numpy", "pandas", "scipy", "torch", "tensorflow", "sklearn", "requests")


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    lowered = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(lowered, F.lit(p))
    return out


def imports_packages(code: Column, packages: Sequence[str] = PACKAGES) -> Column:
    names = "|".join(packages)
    return code.rlike(rf"(^|\n)\s*(import|from)\s+({names})\b")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that rejects, in order; null where none does."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def dedupe(df: DataFrame, key: Sequence[str | Column], score: str, order: str) -> DataFrame:
    """Of equal keys the row of the best score stays, the first of equal ones; it takes the earliest place (``position``).

    ``order`` tells rows apart. Hot keys: the winner is found by a grouped maximum over (order, score, digest of the key),
    combined before the shuffle, not in a window; the rows themselves meet the winners once, by ``order``.
    """
    keyed = df.select(order, score, F.md5(F.concat_ws("\x1f", *key)).alias("_key"))
    best = keyed.groupBy("_key").agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("_kept"), F.min(order).alias("position"))
    return df.join(best.select("_kept", "position"), df[order] == F.col("_kept")).drop("_kept")


def signature_key(c: Column, words: int | None = None) -> Column:
    s = t.signature(c)
    return s if words is None else t.first_words(s, words)


def cross_source(df: DataFrame, key: Column, source: str, order: str, most: int) -> DataFrame:
    """Rows whose key was first seen in another source, in order, at most so many (a report)."""
    _checkpoint_dir(df)
    # keys are found once and stored, texts are not; a null key is one of its own
    keyed = df.select(order, source, F.coalesce(F.md5(key), F.lit("")).alias("_key")).checkpoint()
    first = keyed.groupBy("_key").agg(F.min_by(source, order).alias("first_source"), F.min(order).alias("first"))
    hits = keyed.join(first, "_key").where((F.col(source) != F.col("first_source")) & (F.col(order) > F.col("first")))
    return hits.orderBy(order).limit(most).select(order, source, "first_source", "first")


def shuffled_by(seed: int, key: str) -> Column:
    """A fixed random order: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def source_quota(df: DataFrame, source: str, key: str, quotas: dict[str, int], total: int, seed: int = 42) -> DataFrame:
    """Each source's quota in hash order, then the rest of the others in hash order up to the total."""
    w = Window.partitionBy(source).orderBy(shuffled_by(seed, key), key)
    quota = F.coalesce(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col(source)], F.lit(0))
    ranked = df.withColumn("_in", (F.row_number().over(w) <= quota).cast("int"))
    return ranked.orderBy(F.col("_in").desc(), shuffled_by(seed, key), key).limit(total).drop("_in")


def ratio_sizes(n: int, ratios: Sequence[float]) -> list[int]:
    """Whole sizes in the ratios, the largest remainders rounded up."""
    exact = [n * r / sum(ratios) for r in ratios]
    sizes = [int(x) for x in exact]
    for i in sorted(range(len(ratios)), key=lambda i: (-(exact[i] - sizes[i]), i))[: n - sum(sizes)]:
        sizes[i] += 1
    return sizes


def ratio_cuts(n: int, ratios: Sequence[float]) -> list[int]:
    """Whole sizes such that the row of rank i (from 0) is in the first part whose ratio, with those before it, of n is beyond i; ratios are taken as the decimals they are written as."""
    shares = [Fraction(str(r)) for r in ratios]
    upto = [math.ceil(sum(shares[: k + 1]) * n / sum(shares)) for k in range(len(shares))]
    return [b - a for a, b in zip([0, *upto], upto, strict=False)]


def ratio_split(df: DataFrame, key: str, names: Sequence[str], ratios: Sequence[float], seed: int = 42, rounding: str = "remainder") -> DataFrame:
    """Adds split: exact sizes in hash order. The cut points come from ranked hashes; keys are distinct.

    ``rounding``: "remainder" (sizes by largest remainders) or "cuts" (each cut point rounded up).
    """
    if rounding not in ("remainder", "cuts"):
        raise ValueError(f"rounding {rounding!r}")
    sizes = (ratio_cuts if rounding == "cuts" else ratio_sizes)(df.count(), ratios)
    ranked = numbered(df.withColumn("_h", shuffled_by(seed, key)), "_h", key, name="_n", bucket=F.substring("_h", 1, 3))
    out, upto = F.lit(names[-1]), sum(sizes)
    for name, size in list(zip(names, sizes, strict=True))[::-1]:
        out = F.when(F.col("_n") < upto, name).otherwise(out)
        upto -= size
    return ranked.withColumn("split", out).drop("_h", "_n")


def hash_split(key: str, share: float, seed: int = 42) -> Column:
    """test or train by the hash of the key, without any sort."""
    u = F.conv(F.substring(shuffled_by(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(u < share, "test").otherwise("train")


def representative(cases: str, k: int) -> Column:
    """k cases of an array of (input, output), spread over the order by total length; all where there are no more than k."""
    n = f"size({cases})"
    ranked = f"array_sort(transform({cases}, (c__, i__) -> named_struct('l', length(c__.input) + length(c__.output), 'i', i__)))"
    if k <= 0:
        return F.expr(cases)
    slots = f"transform(sequence(0, {k - 1}), s__ -> int(bround(s__ * ({n} - 1) / {max(k - 1, 1)}D)))"
    chosen = f"array_sort(transform({slots}, p__ -> {ranked}[p__].i))"
    return F.expr(f"if({n} <= {k}, {cases}, transform({chosen}, i__ -> {cases}[i__]))")


def diagnostics(cases: str, m: int) -> Column:
    """The m shortest cases, by (length, place)."""
    return F.expr(f"transform(slice(array_sort(transform({cases}, (c__, i__) -> named_struct('l', length(c__.input) + length(c__.output), 'i', i__))), 1, {m}), x__ -> {cases}[x__.i])")


def prepared_cases(df: DataFrame, column: str, most: int, letters: int, diagnostic: int, letters_out: int | None = None) -> DataFrame:
    """Distinct cases whose input and output are within their lengths, the representative ones, the diagnostics, and the counts of each step.

    ``source_test_count`` counts distinct cases. ``letters_out``: the limit of outputs, if not that of inputs.
    """
    limit = letters if letters_out is None else letters_out
    df = df.withColumn("_d", F.array_distinct(column)).withColumn("_f", F.expr(f"filter(_d, c__ -> length(c__.input) <= {letters} and length(c__.output) <= {limit})"))
    df = df.withColumn("_r", representative("_f", most))
    return df.withColumns({"source_test_count": F.size("_d"), "oversized_test_count": F.size("_d") - F.size("_f"), "selected_test_count": F.size("_r"), "diagnostics": diagnostics("_r", diagnostic), column: F.col("_r")}).drop("_d", "_f", "_r")


def pending(pool: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return pool.join(done.select(key).distinct(), key, "left_anti")


def stage_progress(df: DataFrame, source: str, processed: str, reason: str) -> DataFrame:
    """By source: pool, processed, accepted, rejected, share done as text, reasons as a JSON object."""
    counted = df.groupBy(source, F.when(F.col(processed), F.coalesce(reason, F.lit(""))).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    reasons = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_r") != "", F.struct("_r", "_n"))))))
    out = counted.groupBy(source).agg(F.sum("_n").alias("pool"), part(F.col("_r").isNotNull()).alias("processed"), part(F.col("_r") == "").alias("accepted"), part(F.col("_r") != "").alias("rejected"), reasons.alias("reasons"))
    return out.withColumn("done", F.format_string("%.1f%%", F.col("processed") * 100.0 / F.col("pool")))


def bundle_summary(df: DataFrame, source: str, length: str) -> DataFrame:
    """One row, one JSON object: rows, rows by source, least, greatest and mean length."""
    by = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("lo"), F.max(length).alias("hi"), F.sum(length).alias("s"))
    sources = F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n"))))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by.agg(F.to_json(F.struct(total.alias("rows"), sources.alias("by_source"), F.coalesce(F.min("lo"), F.lit(0)).alias("min"), F.coalesce(F.max("hi"), F.lit(0)).alias("max"), F.round(F.coalesce(F.sum("s") / total, F.lit(0.0)), 4).alias("mean"))).alias("summary"))


def mixture(parts: Sequence[tuple[DataFrame, Sequence[str] | None]]) -> DataFrame:
    """Datasets one after another, each with the columns asked for; their schemas have to agree."""
    if not parts:
        raise ValueError("no datasets")
    chosen = [df.select(*columns) if columns else df for df, columns in parts]
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df)
    return out
