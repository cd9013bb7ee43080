"""Interpolated modified Kneser-Ney n-gram model (order 3, or 2), counted in Spark and scored from memory-mapped sorted hash arrays.

Counting. The words of the training texts are counted (pre-aggregated in each task, summed in Spark) and stored as sorted
hash arrays; a word's shard and place there are its number. Every text is read as if ``START`` stood twice before it.
The pair before each word, its context, is one 64-bit hash of two numbers; (context, word) is counted in each task and sent
in blocks to the part of the context's hash, ``ROUNDS`` ranges of parts one after the other, so that a round's shuffle is
gone before the next. A part stores its contexts: those seen once with the word that followed (``once``; their three words
are not stored again), the others with their counts (``pairs``) and the counts of what followed (``triples``). A second
scan finds the different words before each pair of ``pairs`` (before a pair of ``once`` there is one); each part then
reports, for its words, how many different words stand before and after them, and these reports are summed by shard of the
vocabulary.

Scoring. p(w|uv) = (max(c(uvw) - D, 0) + g(uv) p(w|v)) / c(uv); p(w|v) likewise from the number of different words before
vw, p(w) from the number of different words before w, interpolated with the uniform distribution over the vocabulary and
one unknown word; D depends on whether the count is 1, 2 or more and comes from the counts of counts of its order (Chen and
Goodman). A context never seen leaves the lower order as it is. With ``order`` 2 the pair counts are those of the texts and
the model ends there. Workers map the arrays and look up the distinct words, pairs and triples of a slice of texts at a time.

Hot pairs: a pair's block has a row for each different neighbour of it in a task's flush, so it grows with the vocabulary
and the number of flushes, not with how often the pair stands in the corpus.

``PLACE_BITS``: word numbers have 32 bits (24 for the place within a shard), so a vocabulary may have 268 million words or
so; beyond it ``train`` raises. Results for odd input: a null or empty text is the end token alone; repeated rows count as
often as they stand there; without training texts every probability is that of the uniform distribution over the one
unknown word (scores 0); columns of the input are kept, those added are named ``_l_*``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import by_part, discard, joined, materialise, scratch, table, trimmed, without_prefix
from lodestone.llm.hasharrays import SHARD_ROWS, HashArrays, save, told
from lodestone.llm.textscan import Slice, mix, slices, unmix

PLACE_BITS = 24
PART_TOKENS = 2_000_000
FLUSH_ROWS = 1_000_000
ROUNDS, LEFT_ROUNDS = 3, 2
SCORE_BYTES = 2 << 20
_U = np.uint64
END = _U(0x0E4D0E4D0E4D0E4D)
START_ID, UNKNOWN_ID, NONE_ID = _U(0xFFFFFFFF), _U(0xFFFFFFFE), _U(0xFFFFFFFD)
_LOW = _U(0xFFFFFFFF)
_STATS = {"n1": "u4", "n2": "u4", "n3": "u4", "before": "u4", "total": "i8"}
_BLOCKS = "part long, h binary, id binary, c binary"


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the slice's texts with an end after each text, and the bounds of the texts."""
    starts, ends, firsts = s.words()
    h = s.word_hashes(starts, ends)
    h[h == END] += _U(1)
    return np.insert(h, firsts[1:], END), firsts + np.arange(len(firsts))


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(keys) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``np.unique`` with the inverse, but keys that differ only in the lowest bits, as many as number them, may be out of order and repeated.

    A key's number stands in these bits while they are sorted: several times faster than an indirect sort.
    """
    low = _U((1 << len(keys).bit_length()) - 1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).view(np.int64)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A bijection of two word numbers."""
    return mix((left << _U(32)) | right)


def _before(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number before each one of a text, the start before a text's first."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1][np.diff(bounds) > 0]] = START_ID
    return out


def _triple(h: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """A hash of a pair's hash and a word that stays in the shard of the pair."""
    t = mix(h + (word + _U(1)) * _U(0x9E3779B97F4A7C15))
    return t if not bits else (h >> _U(64 - bits) << _U(64 - bits)) | (t >> _U(bits))


@dataclass
class Model:
    """Where the arrays are and the few numbers besides."""

    order: int
    words: HashArrays
    once: HashArrays
    pairs: HashArrays
    triples: HashArrays
    total: int
    distinct: int
    start: tuple[int, int, int, int]
    top: tuple[float, float, float]
    middle: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_total: int
    lower_counts: tuple[int, int, int]

    def score(self, h: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """Sums by text of log10 probabilities: the model's and the base's, and the number of known tokens."""
        names, where = _distinct(h)
        known, got = self.words.find(names)
        c, before = got["c"].astype(float), got["before"].astype(float)
        uniform = 1.0 / (self.distinct + 1)
        if self.lower_total:
            rest = sum(d * n for d, n in zip(self.lower, self.lower_counts, strict=True)) / self.lower_total
            unigram = np.maximum(before - self._discount(before, self.lower), 0) / self.lower_total + rest * uniform
        else:
            unigram = np.full(len(names), uniform)
        ids = np.where(known, got["id"].astype(np.uint64), UNKNOWN_ID)[where]
        left = _before(ids, bounds)
        hashes, place = _distinct(np.append(_pair(left, ids), _pair(*np.full((2, 1), START_ID))))
        single, follows = self.once.find(hashes)
        several, counted = np.zeros(len(hashes), bool), {n: np.zeros(len(hashes), t) for n, t in self.pairs.payload.items()}
        others = np.flatnonzero(~single)
        several[others], found = self.pairs.find(hashes[others])
        for n, values in found.items():
            counted[n][others] = values
        pair = place[:-1]
        at = np.zeros(len(hashes), np.int64)  # a token of each pair: what hangs on the pair alone is found once
        at[pair] = np.arange(len(pair))
        first, previous = left[at] == START_ID, where[np.maximum(at - 1, 0)]
        stats = [np.where(first, self.start[k], got[n].astype(float)[previous]) for k, n in enumerate(("n1", "n2", "n3", "total"))]
        p = self._interpolated(np.where(single, 1.0, counted["left"]), stats[:3], stats[3], self.middle, unigram[where[at]])[pair]
        if self.order == 3:
            context = np.where(left == START_ID, place[-1], np.concatenate((pair[:1], pair[:-1])))
            count = (single[context] & (follows["next"][context] == ids)).astype(float)
            at = np.flatnonzero(several[context])
            keys, back = _distinct(_triple(hashes[context[at]], ids[at], self.pairs.bits))
            count[at] = self.triples.find(keys)[1]["c"][back]
            spared = sum(d * (counted[n].astype(float) + (single if n == "n1" else 0)) for d, n in zip(self.top, ("n1", "n2", "n3"), strict=True))
            p = self._mixed(count, spared[context], (counted["c"].astype(float) + single)[context], self.top, p)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        base = np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))[where]
        sums = lambda x: np.bincount(row, x, minlength=len(bounds) - 1)
        return {"score": sums(np.log10(p)), "base": sums(base), "known": sums(known[where]).astype(np.int64)}

    def _interpolated(self, count: np.ndarray, seen: list[np.ndarray], context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
        return self._mixed(count, sum(x * n for x, n in zip(d, seen, strict=True)), context, d, lower)

    def _mixed(self, count: np.ndarray, spared: np.ndarray, context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
        return np.where(context > 0, (np.maximum(count - self._discount(count, d), 0) + spared * lower) / np.maximum(context, 1), lower)

    @staticmethod
    def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array((0.0, *d))[np.minimum(count, 3).astype(np.int64)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; a count that none has leaves the plain one."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(np.clip(x, 0.05, k + 0.95)) for k, x in enumerate(d))


# ------------------------------------------------------------------ counting


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for s in slices(batch.column(0), lower=True):
                held.append(np.unique(tokens(s)[0], return_counts=True))
                size += len(held[-1][0])
                if size > 2 * FLUSH_ROWS:
                    held = [_grouped(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > FLUSH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "c"])
                        held, size = [], 0
        if held:
            keys, counts = _grouped(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(trimmed(each), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _store_words(vocabulary: DataFrame, distinct: int) -> HashArrays:
    """The vocabulary as sorted hash arrays with counts and numbers."""
    bits = int(np.ceil(np.log2(max(1, distinct) / SHARD_ROWS))) if distinct > SHARD_ROWS else 0
    if bits + PLACE_BITS > 32:
        raise ValueError(f"{distinct} words are too many for numbers of 32 bits")
    arrays = HashArrays(scratch(vocabulary.sparkSession, "words"), bits, {"c": "i8", "id": "u4"} | _STATS, distinct)
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (h, c) in by_part(batches):
            order = np.argsort(h.view(np.uint64))
            save(arrays.uri, f"{k}.c", c[order])
            save(arrays.uri, f"{k}.id", (np.arange(len(h)) + (k << PLACE_BITS)).astype(np.uint32))
            save(arrays.uri, f"{k}.hash", h[order].view(np.uint64))
            yield told(k, len(h))

    placed = vocabulary.select(shard.alias("_shard"), "h", "c").repartition(1 << bits, "_shard").sortWithinPartitions("_shard")
    return arrays.seal(placed.mapInArrow(trimmed(write), "shard long, n long"))


def _blocks(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows sorted by part as one row for each part, the columns as bytes."""
    edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    arrays = [pa.array(part[edges[:-1]].astype(np.int64))]
    for values in columns.values():
        arrays.append(pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["part", *columns])


def _gathered(docs: DataFrame, text: str, words: HashArrays, bits: int, chosen: tuple[int, int], rows_of: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(part, h, id, c): what ``rows_of`` gives for a slice's word numbers, a pair's hash and a word, counted by task; of the parts from chosen[0] up to chosen[1], which the function it is handed finds."""
    numbers = words.only("id")

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, word = map(np.concatenate, zip(*held, strict=True))
        h, rank = _distinct(h)
        keys = (rank.astype(np.uint64) << _U(32)) | word
        keys.sort()
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        c = np.diff(np.append(edge, len(keys)))
        h = h[keys[edge] >> _U(32)]
        return _blocks((h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), {"h": h, "id": (keys[edge] & _LOW).astype(np.uint32), "c": c.astype(np.uint32)})

    def inside(h: np.ndarray) -> np.ndarray:
        part = h >> _U(64 - bits) if bits else np.zeros(len(h), np.uint64)
        return np.flatnonzero((part >= _U(chosen[0])) & (part < _U(chosen[1])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for s in slices(batch.column(0), lower=True):
                tokens_, bounds = tokens(s)
                names, where = _distinct(tokens_)
                h, word = rows_of(numbers.find(names)[1]["id"].astype(np.uint64)[where], bounds, inside)
                if len(h):
                    held.append((h, word.astype(np.uint32)))
                    size += len(h)
                if size > 3 * FLUSH_ROWS // 2:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(trimmed(each), _BLOCKS)


def _ranges(bits: int, rounds: int) -> list[tuple[int, int]]:
    """The parts in as many ranges, fewer where there are fewer parts."""
    edges = sorted({(k << bits) // rounds for k in range(rounds + 1)})
    return list(zip(edges[:-1], edges[1:], strict=True))


def _followed(ids: np.ndarray, bounds: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word with the pair before it, and after each text its last pair with no word, so that every pair is a context."""
    left = _before(ids, bounds)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    h = np.concatenate((_pair(_before(left, bounds), left), _pair(left[last], ids[last])))
    good = inside(h)
    return h[good], np.concatenate((ids, np.full(len(last), NONE_ID)))[good]


def _store_contexts(blocks: DataFrame, once: HashArrays, pairs: HashArrays, triples: HashArrays, order: int) -> DataFrame:
    """Writes each part's contexts and what follows them; gives a part's sizes and how many triples were seen 1 to 4 times."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (hash_blocks, word_blocks, count_blocks) in by_part(batches):
            h, rank = np.unique(joined(hash_blocks, "u8"), return_inverse=True)
            keys, counts = _grouped((rank.astype(np.uint64) << _U(32)) | joined(word_blocks, "u4"), joined(count_blocks, "u4").astype(np.int64))
            rank, word = (keys >> _U(32)).astype(np.int64), keys & _LOW
            real = word != NONE_ID
            c = np.bincount(rank, counts, minlength=len(h)).astype(np.int64)
            single = c == 1
            save(once.uri, f"{k}.next", word[single[rank]].astype(np.uint32))
            save(once.uri, f"{k}.hash", h[single])
            save(pairs.uri, f"{k}.c", c[~single].astype(np.uint32))
            for n, good in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts >= 3)):
                save(pairs.uri, f"{k}.{n}", np.bincount(rank[good & real], minlength=len(h))[~single].astype(np.uint32))
            save(pairs.uri, f"{k}.hash", h[~single])
            several = real & ~single[rank] & (order > 2)
            t = _triple(h[rank[several]], word[several], pairs.bits)
            by_hash = np.argsort(t)
            save(triples.uri, f"{k}.c", counts[several][by_hash].astype(np.uint32))
            save(triples.uri, f"{k}.hash", t[by_hash])
            told = [k, int(single.sum()), int((~single).sum()), len(t), *[int((real & (counts == n)).sum()) for n in (1, 2, 3, 4)]]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in told], names=["part", "once", "pairs", "triples", *"abcd"])

    schema = "part long, once long, pairs long, triples long, a long, b long, c long, d long"
    return _by_hash(blocks, pairs.bits).mapInArrow(trimmed(each), schema)


def _by_hash(blocks: DataFrame, bits: int) -> DataFrame:
    return blocks.repartition(1 << bits, "part").sortWithinPartitions("part")


def _store_left(blocks: DataFrame, once: HashArrays, pairs: HashArrays, order: int, chosen: tuple[int, int]) -> DataFrame:
    """Writes how many different words stand before each pair; gives (part, ids, n1, n2, n3, before, total) by shard of the vocabulary: part -1 has counts of counts, -2 the start."""
    parts = blocks.sparkSession.range(*chosen).select(F.col("id").alias("part"), *[F.expr("X''").alias(c) for c in ("h", "id", "c")])

    def report(part: np.ndarray, ids: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        return _blocks(part, {"ids": ids.astype(np.uint32), **{n: np.asarray(v).astype(np.uint32) for n, v in zip(_STATS, values, strict=True)}})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (hash_blocks, word_blocks, _) in by_part(batches):
            h, counted = pairs.shard(k)
            if order > 2:
                at = np.searchsorted(h, joined(hash_blocks, "u8")).astype(np.uint64)
                keys = (at << _U(32)) | joined(word_blocks, "u4")
                keys.sort()
                left = np.bincount((keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]] >> _U(32)).astype(np.int64), minlength=len(h))
            else:
                left = np.asarray(counted["c"]).astype(np.int64)
            save(pairs.uri, f"{k}.left", left.astype(np.uint32))
            single = once.shard(k)[0]
            keys, counts = unmix(np.concatenate((h, single))), np.concatenate((left, np.ones(len(single), np.int64)))
            inside = (keys & _LOW) != START_ID
            keys, counts = keys[inside], counts[inside]
            yield report(np.array([-1]), np.zeros(1), [*[np.array([(counts == n).sum()]) for n in (1, 2, 3, 4)], np.zeros(1)])
            if not len(keys):
                continue
            ids, place = _distinct(np.concatenate((keys >> _U(32) << _U(32), keys << _U(32))))
            ids >>= _U(32)
            v, w = place[: len(keys)], place[len(keys) :]
            values = [np.bincount(v[good], minlength=len(ids)) for good in (counts == 1, counts == 2, counts >= 3)]
            values += [np.bincount(w, minlength=len(ids)), np.bincount(v, counts, minlength=len(ids))]
            shard = np.where(ids == START_ID, -2, (ids >> _U(PLACE_BITS)).astype(np.int64))
            by_shard = np.argsort(shard, kind="stable")
            yield report(shard[by_shard], ids[by_shard], [x[by_shard] for x in values])

    schema = "part long, ids binary, " + ", ".join(f"{n} binary" for n in _STATS)
    return _by_hash(blocks.unionByName(parts), pairs.bits).mapInArrow(trimmed(each), schema)


def _store_stats(reports: DataFrame, words: HashArrays) -> DataFrame:
    """Sums the reports by shard and stores them; gives rows (part, a, b, c, d, e, f): numbers for the model."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, columns in by_part(batches):
            ids = joined(columns[0], "u4")
            values = [joined(c, "u4").astype(np.int64) for c in columns[1:]]
            if k < 0:
                sums = [*[int(v.sum()) for v in values], 0]
            else:
                place = ids & ((1 << PLACE_BITS) - 1)
                summed = [np.bincount(place, v, minlength=words.size(k)).astype(np.int64) for v in values]
                for (n, t), v in zip(_STATS.items(), summed, strict=True):
                    save(words.uri, f"{k}.{n}", v.astype(t))
                before = summed[3]
                sums = [*[int((before == n).sum()) for n in (1, 2, 3, 4)], int(before.sum()), int((before >= 3).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (k, *sums)], names=["part", *"abcdef"])

    return reports.repartition((1 << words.bits) + 2, "part").sortWithinPartitions("part").mapInArrow(trimmed(each), "part long, a long, b long, c long, d long, e long, f long")


def train(docs: DataFrame, text: str = "text", order: int = 3) -> Model:
    """Count the whole texts of ``docs`` and store the model in the shared folder. ``order``: 2 or 3 words."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    vocabulary = materialise(_word_counts(docs, text), "vocabulary", free=True)
    seen_words = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    total = seen_words.n or 0
    words = _store_words(vocabulary, seen_words.v)
    discard(vocabulary)
    bits = int(np.ceil(np.log2(total / PART_TOKENS))) if total > PART_TOKENS else 0
    once, pairs, triples = (HashArrays(scratch(spark, n), bits, p, 0) for n, p in (("once", {"next": "u4"}), ("pairs", dict.fromkeys(("c", "n1", "n2", "n3", "left"), "u4")), ("triples", {"c": "u4"})))
    sizes = {n: np.zeros(1 << bits, np.uint64) for n in ("once", "pairs", "triples")}
    top = [0] * 4
    for chosen in _ranges(bits, ROUNDS):
        stored = materialise(_store_contexts(_gathered(docs, text, words, bits, chosen, _followed), once, pairs, triples, order), "contexts", free=True)
        for r in stored.toLocalIterator():  # one row a part of two million words or so
            for n, size in sizes.items():
                size[r.part] = r[n]
            top = [x + r[n] for x, n in zip(top, "abcd", strict=True)]
        discard(stored)
    for arrays, size in zip((once, pairs, triples), sizes.values(), strict=True):
        arrays.rows = int(size.sum())
        save(arrays.uri, "sizes", size)
    several = pairs.only()

    def before_pairs(ids: np.ndarray, bounds: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left = _before(ids, bounds)
        h = _pair(left, ids)
        good = inside(h)
        hashes, place = _distinct(h[good])
        seen = several.find(hashes)[0][place]
        return h[good[seen]], _before(left, bounds)[good[seen]]

    found = docs if order > 2 else docs.limit(0)
    reports = [materialise(_store_left(_gathered(found, text, words, bits, chosen, before_pairs), once, pairs.only("c"), order, chosen), "left", free=True) for chosen in _ranges(bits, LEFT_ROUNDS)]
    every = reports[0]
    for r in reports[1:]:
        every = every.unionByName(r)
    stats = materialise(_store_stats(every, words), "stats", free=True)
    by = {r.part: r for r in stats.groupBy(F.expr("least(part, 0)").alias("part")).agg(*[F.sum(c).alias(c) for c in "abcdef"]).collect()}
    for df in (*reports, stats):
        discard(df)
    numbers = lambda k, columns: tuple(by[k][c] for c in columns) if k in by else (0,) * len(columns)
    return Model(order, words, once, pairs, triples, total, seen_words.v, numbers(-2, "abce"), discounts(top), discounts(numbers(-1, "abcd")), discounts(numbers(0, "abcd")), *numbers(0, "e"), numbers(0, "abf"))


def with_scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default), _l_n_tokens, _l_n_known, _l_base, _l_score (log10) and _l_perplexity."""
    docs = without_prefix(docs, "_l_")
    names = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_l_text"))
    schema = source.drop("_l_text").schema.add("_l_n_tokens", "long").add("_l_n_known", "long").add("_l_base", "double").add("_l_score", "double").add("_l_perplexity", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known, base, score = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float))
            for s in slices(batch.column(batch.num_columns - 1), lower=True, most=SCORE_BYTES):
                h, bounds = tokens(s)
                row = slice(s.first, s.first + s.rows)
                told = model.score(h, bounds)
                n[row], known[row], base[row], score[row] = np.diff(bounds), told["known"], told["base"], told["score"]
            perplexity = 10.0 ** (-score / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, (n, known, base, score, perplexity))], names=schema.fieldNames())

    return source.mapInArrow(trimmed(each), schema)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    model = train(docs.where(~held_out))
    scored = with_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_l_n_tokens").alias("n_tokens"), F.col("_l_n_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.col("_l_base").alias("base_score"), F.col("_l_score").alias("score"))
