"""How new each program of a group is: 1 less the mean similarity with the group's others.

Similarity is that of matching blocks (``difflib``), which depends on the order of the two. Groups are cut into blocks of
programs by hash; pairs of blocks are compared independently, dealt over all shuffle partitions, so a large group is spread, and sums
are added up afterwards. Equal programs of a group are compared once and count as often as they occur. Programs of at most ``SHORT``
characters are compared many pairs at a time by arrays of bits, with difflib's results (a head that all of two blocks have is left
out where it must be the first matching block), longer ones by difflib itself; the work still grows with the square of a group's
different programs.

Results for odd input: a lone program is new (1); a null program is empty, and two empty ones are the same; equal programs of
different rows are compared like others; rows of one ``key`` are rows of their own; an empty
table gives an empty result; columns that begin with ``_w_`` are replaced.
"""

from __future__ import annotations

import os
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Programs of a block: so many, or up to WIDE where they have no more than WIDE * SHORT characters together.
BLOCK, WIDE = 32, 256
#: Programs of at most so many characters are compared by arrays: places of the second one are bits.
SHORT = 64
#: Bytes of bits that are worked on at a time.
BITS = 1 << 19


def _matched(found: np.ndarray) -> np.ndarray:
    """Characters in difflib's matching blocks of many pairs; ``found``: by place in the first (rows) and pair (columns), the bits of equal places in the second.

    The longest run of all that is left is the longest of its own stretch, so cutting away what crosses it, again and again,
    gives the blocks that difflib finds stretch by stretch. Ties: earliest in the first, then in the second.
    """
    total, at = np.zeros(found.shape[1], np.int64), np.arange(found.shape[1])
    while True:
        left = np.flatnonzero(np.bitwise_or.reduce(found, axis=0))
        if left.size < at.size:
            found, at = found.take(left, axis=1), at[left]
        if not at.size:
            return total
        used = np.flatnonzero(found.any(axis=1))
        found = found[used[0] : used[-1] + 1]
        runs, longest = [found], np.ones(at.size, np.int64)  # runs[n - 1]: ends of runs of n, rows from place n - 1 on
        while len(runs) < len(found):
            run = runs[-1][:-1] << 1
            run &= found[len(runs) :]
            more = np.bitwise_or.reduce(run, axis=0) != 0
            if not more.any():
                break
            runs.append(run)
            longest += more
        total[at] += longest
        first, end = np.empty(at.size, np.int64), np.empty(at.size, found.dtype)
        for n in np.unique(longest):
            here = np.flatnonzero(longest == n)
            run = runs[n - 1].take(here, axis=1)
            first[here] = (run != 0).argmax(axis=0)
            end[here] = run[first[here], np.arange(here.size)]
        end &= ~end + 1  # the lowest bit: the earliest in the second
        before = (end >> (longest - 1).astype(found.dtype)) - 1
        after = ~(end | (end - 1))
        rows = np.arange(len(found))[:, None]
        found = found & np.where(rows < first, before, np.where(rows < first + longest, found.dtype.type(0), after))


def _head(texts: list[str]) -> int:
    """Length of the head that all texts have, if no two of them can have a longer run than it at other places; else 0.

    A run whose places are ``d`` apart and the later of which is ``at``, inside the head, either ends in it or has the
    head repeat itself after ``d`` from there on; it is no longer than what follows ``at`` in the longest text.
    """
    head, longest = os.path.commonprefix(texts), max(map(len, texts), default=0)
    for d in range(1, len(head) + 1):
        at = len(head)
        while at > d and head[at - 1 - d] == head[at - 1]:
            at -= 1
        if longest - at > len(head):
            return 0
    return len(head)


def _cut_heads(found: np.ndarray) -> np.ndarray:
    """Cuts the run of each pair that begins at both beginnings out of ``found``, and what crosses it; its lengths."""
    longest = np.zeros(found.shape[1], np.int64)
    goes_on = np.ones(found.shape[1], bool)
    for row in range(min(len(found), found.dtype.itemsize * 8)):
        goes_on &= (found[row] >> row) & 1 == 1
        if not goes_on.any():
            break
        longest += goes_on
    full = found.dtype.itemsize * 8
    after = np.array([~((1 << n) - 1) & ((1 << full) - 1) for n in range(full + 1)], found.dtype)[longest]
    found &= np.where(np.arange(len(found))[:, None] < longest, found.dtype.type(0), after)
    return longest


def matches(firsts: list[str], seconds: list[str]) -> np.ndarray:
    """By second (rows) and first (columns): the characters in difflib's matching blocks of two programs of at most ``SHORT`` characters."""
    head = _head([*firsts, *seconds])
    firsts, seconds = [a[head:] for a in firsts], [b[head:] for b in seconds]
    out = np.full((len(seconds), len(firsts)), head, np.int64)
    longest, width = (max(map(len, texts), default=0) for texts in (firsts, seconds))
    letters = {c: k for k, c in enumerate(sorted(set("".join(seconds))), 1)}  # 0: in none of them, or past the end
    if not letters or not longest:
        return out
    places = np.zeros((longest, len(firsts)), np.int64)
    for k, text in enumerate(firsts):
        places[: len(text), k] = [letters.get(c, 0) for c in text]
    bits = np.zeros((len(letters) + 1, len(seconds)), next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if width <= np.dtype(t).itemsize * 8))
    for k, text in enumerate(seconds):
        for j, c in enumerate(text):
            bits[letters[c], k] |= bits.dtype.type(1 << j)
    step = max(1, BITS // (longest * len(firsts) * bits.itemsize))
    for k in range(0, len(seconds), step):
        found = bits[:, k : k + step][places].reshape(longest, -1)  # by place; first and second
        begun = _cut_heads(found) if head else 0
        out[k : k + step] += (begun + _matched(found)).reshape(len(firsts), -1).T
    return out


def similarities(codes: list[str], sides: list[int], counts: list[int] | None = None) -> list[tuple[float, int]]:
    """For each program of a meeting of two blocks (side 0 and 1, or 2 for a block with itself) its summed similarity with those it meets there, and their number.

    ``counts``: how often each occurs; a program meets its own further occurrences where its block meets itself.
    """
    n = np.ones(len(codes), np.int64) if counts is None else np.array(counts, np.int64)
    side, size = np.array(sides, np.int64), np.array([len(c) for c in codes], np.int64)
    met = np.where(side == 2, n - 1, 0)
    sums, short = met.astype(np.float64), size <= SHORT
    for s in np.unique(side):
        firsts, seconds = np.flatnonzero(short & ((side == 2) | (side != s))), np.flatnonzero(short & (side == s))
        lengths = size[seconds][:, None] + size[firsts]
        ratios = np.where(lengths > 0, 2.0 * matches([codes[i] for i in firsts], [codes[j] for j in seconds]) / np.maximum(lengths, 1), 1.0)
        times = n[seconds][:, None] * (seconds[:, None] != firsts)
        sums[firsts] += (times * ratios).sum(axis=0)
        met[firsts] += times.sum(axis=0)
    if not short.all():
        matcher = SequenceMatcher(None)
        for j, b in enumerate(codes):
            matcher.set_seq2(b)  # what is learned of b serves all others
            for i in np.flatnonzero(((side == 2) | (side != side[j])) & ~(short & short[j])):
                if i != j:
                    matcher.set_seq1(codes[i])
                    sums[i] += n[j] * matcher.ratio()
                    met[i] += n[j]
    return list(zip(sums.tolist(), met.tolist(), strict=True))


def with_novelty(df: DataFrame, group: str, key: str, code: str, name: str = "novelty", block: int | None = None) -> DataFrame:
    """Adds ``name`` to every row. ``block``: programs of a block, else by their length (``BLOCK``, ``WIDE``); it changes no result."""
    df = df.drop(name, *[c for c in df.columns if c.startswith("_w_")])
    rows = df.select(F.col(group).alias("_w_group"), F.coalesce(F.col(code), F.lit("")).alias("_w_code"))
    rows = rows.withColumn("_w_id", F.md5("_w_code"))
    own = rows.groupBy("_w_group", "_w_id", "_w_code").agg(F.count(F.lit(1)).alias("_w_count"))
    whole = Window.partitionBy("_w_group")
    n, size = F.count(F.lit(1)).over(whole), F.sum(F.length("_w_code")).over(whole)
    blocks = F.ceil(n / block) if block else F.least(F.ceil(n / BLOCK), F.greatest(F.ceil(n / WIDE), F.ceil(size / (WIDE * SHORT))))
    own = own.withColumn("_w_n", blocks.cast("int")).withColumn("_w_b", F.expr("int(pmod(xxhash64(_w_id), _w_n))"))
    met = own.withColumn("_w_o", F.explode(F.sequence(F.lit(0), F.col("_w_n") - 1)))
    met = met.select("_w_group", "_w_id", "_w_code", "_w_count", F.least("_w_b", "_w_o").alias("_w_lo"), F.greatest("_w_b", "_w_o").alias("_w_hi"), F.expr("case when _w_b = _w_o then 2 when _w_b < _w_o then 0 else 1 end").alias("_w_side"))
    schema = f"_w_group {met.schema['_w_group'].dataType.simpleString()}, _w_id string, s double, n long"

    def each(table: pa.Table) -> pa.Table:
        found = similarities(*(table.column(c).to_pylist() for c in ("_w_code", "_w_side", "_w_count")))
        return table.select(["_w_group", "_w_id"]).append_column("s", pa.array([s for s, _ in found], pa.float64())).append_column("n", pa.array([k for _, k in found], pa.int64()))

    # by number: few bytes are much work here, so partitions must not be put together by their bytes
    met = met.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_w_group", "_w_lo", "_w_hi")
    summed = met.groupBy("_w_group", "_w_lo", "_w_hi").applyInArrow(each, schema).groupBy("_w_group", "_w_id").agg(F.sum("s").alias("_w_s"), F.sum("n").alias("_w_m"))
    same = F.col(group).eqNullSafe(F.col("_w_group")) & (F.md5(F.coalesce(F.col(code), F.lit(""))) == F.col("_w_id"))
    new = F.when(F.col("_w_m") > 0, 1 - F.col("_w_s") / F.col("_w_m")).otherwise(1.0)
    return df.join(summed, same).withColumn(name, new).select(*df.columns, name)
