"""Benchmark decontamination as a prefix-filtered set join, with DataFrame operations only.

An item is cut into windows of ``width`` consecutive words (one window where it has fewer). A window is a sequence of
shingles of ``shingle`` words. All positions in the documents where any shingle of the benchmark stands are found in one
pass (a hash join with the benchmark's shingles). From these hits comes the rarity of every shingle in the corpus; as a
window must be contained whole, the necessary prefix of its shingles in that order is the rarest one. Only hits of prefix
shingles become candidates; the length and positional bounds (the window has to lie within the text, given the offset of
the shingle) leave one possible place for each, where the words are compared one by one.

A document word inside any occurrence is hit. A document is contaminated when it has hits and ``ratio`` times their
number is at least the number of its words.

Results for odd input: null or empty text has no words and no hits; an item without words has no window; a null item_id
counts as the item named by the empty string; items of one id are one item; repeated rows give repeated results; with an
empty benchmark nothing is contaminated; columns of the input are kept, those added are named ``_b_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, discard, materialise, table, without_prefix

WIDTH = 13
SHINGLE = 5
#: Benchmark shingles (about 40 bytes each when hashed for a join) that may be broadcast; beyond it the join is shuffled.
BROADCAST_SHINGLES = 1_000_000

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Only texts beyond ASCII need the slower letter-by-letter folding."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _GAPS), "")


def _tokenised(df: DataFrame, text: str, *others: Column) -> DataFrame:
    """``others`` and the words of each text as ``w``. The generator keeps the optimiser from splitting a text once for every use."""
    return df.select(*others, F.explode(F.array(words_of(F.col(f"`{text}`")))).alias("w"))


def _shingle_hashes(width: int) -> str:
    """SQL for the hashes of all runs of ``width`` words of ``w``, by position."""
    each = ", ".join(f"w[i + {k}]" for k in range(width))
    return f"if(size(w) < {width}, cast(array() as array<bigint>), transform(sequence(0, greatest(size(w) - {width}, 0)), i -> xxhash64({width}, {each})))"


def benchmark_windows(benchmark: DataFrame, text: str = "text", item: str = "item_id", width: int = WIDTH) -> DataFrame:
    """(window, item, words) of every window of every item; ``window`` names equal word sequences equally."""
    items = _tokenised(benchmark, text, F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item")).where("size(w) > 0")
    cut = items.select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {width}, 0))")).alias("i"))
    cut = cut.select("item", F.expr(f"slice(w, i + 1, {width})").alias("words"))
    return cut.select(F.md5(F.array_join("words", " ")).alias("window"), "item", "words")


def occurrences(docs: DataFrame, windows: DataFrame, text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """(text_key, start, length, window) for every place of a document text where a window stands; ``text_key`` is the md5 of the text.

    ``windows``: window, words; one row each.
    """
    parts = windows.select("window", "words", F.expr(f"least(size(words), {shingle})").alias("g"))
    parts = materialise(
        parts.select("window", "words", "g", F.explode(F.expr("sequence(0, size(words) - g)")).alias("at"))
        .select("window", "words", "g", "at", F.expr(" ".join(["case g", *[f"when {g} then xxhash64({g}, {', '.join(f'words[at + {k}]' for k in range(g))})" for g in range(1, shingle + 1)], "end"])).alias("h")),
        "bench-shingles",
    )
    known = parts.select("h", "g").distinct()
    widths = sorted(r.g for r in known.select("g").distinct().collect())  # at most `shingle` values
    if not widths:
        return parts.select(F.lit("").alias("text_key"), F.lit(0).alias("start"), F.lit(0).alias("length"), "window").where("false")
    keys = known.select("h").distinct()
    few = keys.count() <= BROADCAST_SHINGLES
    body = _tokenised(docs.where(F.col(f"`{text}`").isNotNull()), text, F.md5(F.col(f"`{text}`")).alias("text_key")).where(f"size(w) >= {widths[0]}")
    reach = width - 1
    hits = None
    for g in widths:
        spots = body.select("text_key", "w", F.posexplode(F.expr(_shingle_hashes(g))).alias("pos", "h"))
        found = spots.join(F.broadcast(keys) if few else keys, "h")
        # the words around a hit: enough to hold any window that has the shingle
        around = F.expr(f"slice(w, greatest(pos - {reach}, 0) + 1, pos - greatest(pos - {reach}, 0) + {width})")
        found = found.select("text_key", "pos", "h", F.expr("size(w)").alias("n"), F.expr(f"greatest(pos - {reach}, 0)").alias("low"), around.alias("around"))
        hits = found if hits is None else hits.union(found)
    hits = materialise(hits, "bench-hits")
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    prefix = (
        parts.join(rarity, "h", "left").groupBy("window")
        .agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at", "h")).alias("rarest"), F.first("words").alias("words"))
        .where("rarest.times > 0").select("window", "words", "rarest.at", "rarest.h")
    )
    candidates = hits.join(prefix, "h").where("pos >= at and pos - at + size(words) <= n")
    out = candidates.where("slice(around, pos - at - low + 1, size(words)) = words")
    return out.select("text_key", F.expr("pos - at").alias("start"), F.expr("size(words)").alias("length"), "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", bench_text: str = "text", item: str = "item_id", width: int = WIDTH, ratio: int = 20) -> DataFrame:
    """All columns of ``docs`` and _b_n_words, _b_n_hit, _b_items (sorted item ids as strings), _b_contaminated."""
    docs = without_prefix(docs, "_b_")
    told = materialise(benchmark_windows(benchmark, bench_text, item, width), "bench-windows")
    windows = told.groupBy("window").agg(F.first("words").alias("words"))
    found = materialise(occurrences(docs, windows, text, width), "bench-found")
    places = found.select("text_key", "start", "length").distinct().groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("p"))
    covered = F.expr("aggregate(p, named_struct('upto', 0, 'n', 0), (a, x) -> named_struct('upto', greatest(a.upto, x.start + x.length), 'n', a.n + greatest(0, x.start + x.length - greatest(a.upto, x.start))), a -> a.n)")
    items = found.select("text_key", "window").distinct().join(told.select("window", "item").distinct(), "window").groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("_b_items"))
    per_text = materialise(places.select("text_key", covered.cast("long").alias("_b_n_hit")).join(items, "text_key"), "bench-texts")
    discard(found)
    at = F.col(f"`{text}`")
    judged = docs.select("*", F.coalesce(F.size(words_of(at)), F.lit(0)).cast("long").alias("_b_n_words"), F.md5(at).alias("_b_key"))
    out = judged.join(per_text.withColumnRenamed("text_key", "_b_key"), "_b_key", "left").drop("_b_key")
    n_hit = F.coalesce("_b_n_hit", F.lit(0).cast("long"))
    return out.withColumns({"_b_n_hit": n_hit, "_b_items": F.coalesce("_b_items", F.expr("cast(array() as array<string>)")), "_b_contaminated": (n_hit > 0) & (ratio * n_hit >= F.col("_b_n_words"))})


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return judged.select(
        "doc_id", F.col("_b_n_words").alias("n_words"), F.col("_b_n_hit").alias("n_hit"), F.size("_b_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_b_items", ","), 256).alias("items_sha256"), F.col("_b_contaminated").alias("contaminated"),
    )
