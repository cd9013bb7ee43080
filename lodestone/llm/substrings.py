"""Substring dedup with a compressed FM-index per shard.

A passage of ``width`` words is removed wherever its word sequence also starts anywhere else. To keep the search within
shards, every window of ``width`` words is placed by its anchor, the least hash among its runs of ``GRAM`` words: equal
windows have equal anchors and so meet in one shard. Neighbouring windows with one anchor position make a segment. An
anchor seen at one place only cannot belong to a repeated window; the others' segments are sent to their shard, one copy
of each content from a batch. A shard concatenates its segments (a content seen more than once stands there twice),
sorts the suffixes, and keeps the Burrows-Wheeler transform as a wavelet tree of rank-indexed bit vectors. The segments
are streamed backwards through it, many in step: matching statistics give the longest suffix that occurs at least twice,
every window within it is repeated, and windows left of it are searched one by one. The result, a bit mask for each
content, goes to sorted hash arrays in the shared folder, from which a last pass over the texts removes the words.

Anchors of more than ``hot`` places (a passage in a large part of all texts, in many contexts) would fill one shard:
there each window is a segment of its own, placed by the hash of the whole window, and sent only if that hash recurs.

Results for odd input: null or empty text has no words (kept text empty); fewer than ``width`` words keep all; a window
repeated within one text counts; repeated rows remove each other's passages; an empty table gives an empty result;
columns of the input are kept, those added are named ``_d_*``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialise, table, trimmed, without_prefix
from lodestone.llm.hasharrays import HashArrays, build
from lodestone.llm.textscan import WHITE, Slice, mix, slices, windows

WIDTH = 35
GRAM = 8
HOT = 50_000
SHARD_WORDS = 1_500_000
_U = np.uint64
_W = np.uint64(0xC2B2AE3D27D4EB4F)
_W_INVERSE = np.uint64(pow(int(_W), -1, 1 << 64))


# ------------------------------------------------------------------ segments


class Ranges:
    """Hashes of ranges of a word sequence, from prefix sums."""

    def __init__(self, words: np.ndarray):
        steps = np.full(len(words) + 1, _W, np.uint64)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = _W_INVERSE
        self.down = np.multiply.accumulate(steps)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + lengths] - self.sums[starts]) * self.down[starts] + lengths.astype(np.uint64))


def anchors(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window within a row: its first word, its anchor's hash and position (the leftmost of equal ones)."""
    n = len(words) - GRAM + 1
    span = width - GRAM + 1
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for k in range(1, GRAM):
        h *= _U(0xD6E8FEB86659FD93)
        h += words[k : n + k]
        h ^= h >> _U(29)
    h = mix(h)
    at = np.arange(n)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        a, b = slice(0, len(h) - step), slice(step, None)
        right = h[b] < h[a]
        h, at = np.where(right, h[b], h[a]), np.where(right, at[b], at[a])
        reach += step
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    starts = np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return starts, h[starts], at[starts]


def segments(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor hash of each segment. No two rows share an anchor position."""
    starts, h, at = anchors(words, firsts, width)
    if not len(starts):
        return starts, starts, h
    edge = np.ones(len(starts), bool)
    edge[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(edge)
    return starts[begin], np.diff(np.append(begin, len(starts))), h[begin]


def split_hot(starts: np.ndarray, runs: np.ndarray, h: np.ndarray, hot: HashArrays | None) -> tuple[tuple, tuple | None]:
    """The segments without hot anchors, and the windows (as starts) of those with."""
    if hot is None or not hot.rows:
        return (starts, runs, h), None
    bad = hot.find(h)[0]
    if not bad.any():
        return (starts, runs, h), None
    lone = np.repeat(starts[bad] - np.concatenate(([0], np.cumsum(runs[bad])[:-1])), runs[bad]) + np.arange(runs[bad].sum())
    return (starts[~bad], runs[~bad], h[~bad]), (lone,)


def scan(text: pa.Array) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for s in slices(text):
        starts, ends, firsts = s.words()
        yield s, starts, ends, firsts, s.hashes(starts, ends)


# ------------------------------------------------------------------ FM-index


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((_U(1) << (i & 63).astype(np.uint64)) - _U(1)))


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in order of the next ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    done = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:] + 1 if done < n else 0
        key = rank * (n + 2) + after if done > 1 else rank * (int(text.max()) + 3) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.cumsum(ranked[1:] != ranked[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        done *= 2
        if done >= depth or fresh[-1] == n - 1:
            return order


class FMIndex:
    """Counts occurrences of patterns of at most ``depth`` symbols in a text over 0..sigma-1, read backwards."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        order = sorted_suffixes(text, depth + 1)
        symbols = text[order - 1]  # the first position wraps to the last
        self.n = len(text)
        self.depth = max(1, int(sigma - 1).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        every = np.arange(sigma)
        self.offset = self.first[:-1] - self._descend(every, np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            ones = bits.rank(i).astype(np.int64)
            i = np.where((symbols >> (self.depth - 1 - k)) & 1, bits.zeros + ones, i - ones)
        return i

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol to the left."""
        both = self._descend(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        return both[: len(low)] + self.offset[symbols], both[len(low) :] + self.offset[symbols]

    def longest_repeated(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Matching statistics: for each end, the length (up to ``most``) of the longest sequence before it with two occurrences."""
        length = np.zeros(len(ends), np.int64)
        active = np.flatnonzero(most > 0)
        low, high = np.zeros(len(active), np.int64), np.full(len(active), self.n, np.int64)
        while len(active):
            symbols = text[ends[active] - length[active] - 1]
            low, high = self.extend(symbols, low, high)
            good = high - low >= 2
            active, low, high = active[good], low[good], high[good]
            length[active] += 1
            more = length[active] < most[active]
            active, low, high = active[more], low[more], high[more]
        return length


def repeated_windows(contents: list[np.ndarray], twice: np.ndarray, width: int) -> np.ndarray:
    """For each segment the mask of its windows that occur at least twice; bit k is the window from word k."""
    masks = np.zeros(len(contents), np.int64)
    if not contents:
        return masks
    lengths = np.array([len(c) for c in contents])
    copies = np.flatnonzero(twice)
    flat = np.concatenate(contents)
    alphabet, ids = np.unique(flat, return_inverse=True)
    ends = np.cumsum(lengths + 1) - 1  # each content is followed by a 0
    text = np.zeros(int((lengths + 1).sum() + (lengths[copies] + 1).sum()), np.int64)
    here = np.ones(int((lengths + 1).sum()), bool)
    here[ends] = False
    text[: len(here)][here] = ids + 1
    at = len(here)
    for i in copies:
        text[at : at + lengths[i]] = text[ends[i] - lengths[i] : ends[i]]
        at += lengths[i] + 1
    index = FMIndex(text, len(alphabet) + 1, int(lengths.max()))
    runs = lengths - width + 1
    matched = index.longest_repeated(text, ends, lengths)
    from_start = np.clip(lengths - matched, 0, runs)  # windows from here on lie in the repeated suffix
    masks = ((np.int64(1) << runs) - 1) & ~((np.int64(1) << from_start) - 1)
    owner = np.repeat(np.arange(len(contents)), from_start)
    if len(owner):
        k = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(from_start)[:-1])), from_start)
        window_ends = ends[owner] - lengths[owner] + k + width
        good = index.longest_repeated(text, window_ends, np.full(len(owner), width)) >= width
        np.bitwise_or.at(masks, owner[good], np.int64(1) << k[good])
    return masks


# ------------------------------------------------------------------ passes


def _counted(docs: DataFrame, text: str, width: int, hot: HashArrays | None) -> DataFrame:
    """(h, n): how often each anchor (or, of hot anchors only, each whole window) occurs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, firsts, words in scan(batch.column(0)):
                starts, runs, h = segments(words, firsts, width)
                if hot is not None:
                    _, lone = split_hot(starts, runs, h, hot)
                    h = Ranges(words).of(lone[0], np.full(len(lone[0]), width)) if lone else h[:0]
                keys, n = np.unique(h, return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "n"])

    scanned = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(trimmed(each), "h long, n long")
    return scanned.groupBy("h").agg(F.sum("n").alias("n"))


def _sent(docs: DataFrame, text: str, width: int, recurring: HashArrays, hot: HashArrays | None, recurring_windows: HashArrays | None) -> DataFrame:
    """(h, content, id, twice): the segments to index, one of each content from a slice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, firsts, words in scan(batch.column(0)):
                (starts, runs, h), lone = split_hot(*segments(words, firsts, width), hot)
                ranges = Ranges(words)
                known = recurring.find(h)[0]
                starts, lengths, h = starts[known], runs[known] + width - 1, h[known]
                if lone is not None:
                    whole = ranges.of(lone[0], np.full(len(lone[0]), width))
                    again = recurring_windows.find(whole)[0]
                    starts, h = np.concatenate((starts, lone[0][again])), np.concatenate((h, whole[again]))
                    lengths = np.concatenate((lengths, np.full(again.sum(), width)))
                if not len(starts):
                    continue
                ids = ranges.of(starts, lengths)
                _, once, times = np.unique(ids, return_index=True, return_counts=True)
                starts, lengths = starts[once], lengths[once]
                take = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
                offsets = np.concatenate(([0], np.cumsum(lengths * 8))).astype(np.int32)
                content = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words[take]))])
                yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), content, pa.array(ids[once].view(np.int64)), pa.array(times >= 2)], names=["h", "content", "id", "twice"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(trimmed(each), "h long, content binary, id long, twice boolean")


def _indexed(sent: DataFrame, width: int, shards: int) -> DataFrame:
    """(h, mask): content id and mask of the contents with repeated windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, ids, twice, contents = [], [], [], []
        for batch in batches:
            h.append(batch.column(0).to_numpy())
            ids.append(batch.column(2).to_numpy())
            twice.append(batch.column(3).to_numpy(zero_copy_only=False))
            _, offsets, data = batch.column(1).buffers()
            offsets = np.frombuffer(offsets, np.int32)[batch.column(1).offset : batch.column(1).offset + batch.num_rows + 1]
            flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
            contents += np.split(flat, (offsets[1:-1] - offsets[0]) // 8)
        if not h:
            return
        h, ids, twice = np.concatenate(h), np.concatenate(ids), np.concatenate(twice)
        distinct, once, inverse = np.unique(ids, return_index=True, return_inverse=True)
        seen = np.bincount(inverse) >= 2
        np.logical_or.at(seen, inverse, twice)
        order = once[np.argsort(h[once], kind="stable")]
        seen = seen[inverse[order]]
        # equal anchors stay together; pieces keep the index small whatever fell to this task
        sizes = np.cumsum([len(contents[i]) + 1 for i in order])
        a = 0
        while a < len(order):
            b = int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 2 * SHARD_WORDS, "right"))
            b = max(b, a + 1)
            while b < len(order) and h[order[b]] == h[order[b - 1]]:
                b += 1
            masks = repeated_windows([contents[i] for i in order[a:b]], seen[a:b], width)
            some = masks != 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[order[a:b]][some]), pa.array(masks[some])], names=["h", "mask"])
            a = b

    return sent.repartition(shards, "h").mapInArrow(trimmed(each), "h long, mask long")


def repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, hot_limit: int = HOT) -> tuple[HashArrays, HashArrays | None]:
    """Masks by content of the segments with repeated windows, and the hot anchors."""
    counts = materialise(_counted(docs, text, width, None).where("n >= 2"), "anchors")
    stats = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.expr(f"int(n > {hot_limit})")).alias("hot")).first()
    recurring = build(counts.select("h"), stats.k, "anchors")
    hot = recurring_windows = None
    if stats.hot:
        hot = build(counts.where(f"n > {hot_limit}").select("h"), stats.hot, "hot-anchors")
        lone = materialise(_counted(docs, text, width, hot).where("n >= 2"), "hot-windows")
        recurring_windows = build(lone.select("h"), lone.count(), "hot-windows")
        discard(lone)
    discard(counts)
    places = stats.n or 0
    shards = max(1, -(-places * (width + (width - GRAM) // 2) // SHARD_WORDS))
    masks = materialise(_indexed(_sent(docs, text, width, recurring, hot, recurring_windows), width, shards), "masks")
    out = build(masks, masks.count(), "masks", {"mask": "i8"})
    discard(masks)
    return out, hot


def removed_words(words: np.ndarray, firsts: np.ndarray, width: int, masks: HashArrays, hot: HashArrays | None) -> np.ndarray:
    """Which words a repeated window covers."""
    (starts, runs, _), lone = split_hot(*segments(words, firsts, width), hot)
    lengths = runs + width - 1
    if lone is not None:
        starts, lengths = np.concatenate((starts, lone[0])), np.concatenate((lengths, np.full(len(lone[0]), width)))
    cover = np.zeros(len(words) + 1, np.int64)
    if len(starts):
        known, payload = masks.find(Ranges(words).of(starts, lengths))
        starts, mask = starts[known], payload["mask"][known]
        for k in range(width - GRAM + 1):
            at = starts[(mask >> k) & 1 == 1] + k
            cover += np.bincount(at, minlength=len(cover))
            cover -= np.bincount(at + width, minlength=len(cover))
    return np.cumsum(cover[:-1]) > 0


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, keep: list[str] | None = None, as_text: bool = True, hot_limit: int = HOT) -> DataFrame:
    """The columns ``keep`` (all by default), _d_n_words, _d_n_removed and _d_kept: the kept words joined by one space, or its SHA-256."""
    docs = without_prefix(docs, "_d_")
    names = docs.columns if keep is None else keep
    masks, hot = repeats(docs, text, width, hot_limit)
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_d_text"))
    schema = source.drop("_d_text").schema.add("_d_n_words", "long").add("_d_n_removed", "long").add("_d_kept", "string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for s, starts, ends, firsts, words in scan(batch.column(batch.num_columns - 1)):
                gone = removed_words(words, firsts, width, masks, hot)
                row = slice(s.first, s.first + s.rows)
                n[row] = np.diff(firsts)
                total = np.concatenate(([0], np.cumsum(gone)))
                removed[row] = total[firsts[1:]] - total[firsts[:-1]]
                a, b = starts[~gone], ends[~gone]
                owner = np.searchsorted(s.bounds, a, "right") - 1
                follows = np.zeros(len(a), bool)
                follows[:-1] = owner[1:] == owner[:-1]
                step = np.zeros(len(s.data) + 1, np.int8)
                step[a] += 1
                step[b] -= 1
                inside = np.cumsum(step[:-1], dtype=np.int8) > 0
                inside[b[follows]] = True
                out = np.where(WHITE[s.data], np.uint8(32), s.data)[inside].tobytes()
                cuts = np.concatenate(([0], np.cumsum(inside)))[s.bounds].tolist()
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    kept.append(out[i:j].decode() if as_text else hashlib.sha256(out[i:j]).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(removed), pa.array(kept, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(trimmed(each), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"], as_text=False)
    return out.select("doc_id", F.col("_d_n_words").alias("n_words"), F.col("_d_n_removed").alias("n_removed"), F.col("_d_kept").alias("kept_sha256"))
