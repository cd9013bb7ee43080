"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents of equal sets are one entity from the
start. Two sets of sizes a <= b with Jaccard at least t differ in at most H(a + b) elements. Sizes fall into bands; the
smaller set of a pair is indexed in its own band, the larger one probes its own band and those below that can hold a
partner. In each band the universe of shingles is dealt by hash into m segments: if the pair differs in at most H
elements, then of any segments of the larger set whose allowances (an exact match counts 1, a match up to one deletion
counts 2) add up to H + 1 at least one matches within its allowance. The allocation goes by cost, twice. For a band: the
number of segments m and of those that also index their one-deletion neighbourhoods, from the expected number of keys and
of accidental matches. For a document: all keys are counted first, over the whole corpus, and it probes just as many of
its segments as its own H needs, those of the fewest sets first. Most documents have enough segments that no other set
has, and probe nothing. Empty segments are never keys. A set whose non-empty segments cannot add up (it is small, or its
elements fell together) probes H + 1 of its shingles by themselves, one of which every partner has.

Entities that share a probed key are a bucket. Pairs within a bucket are not listed: first each meets the bucket's pivot;
what that links is one component. Buckets of several components get other pivots, one for each bucket, as long as that
links more. Then buckets that still have several are cut into blocks of bounded size, and pairs of blocks are compared
with array operations: only pairs of different components whose parity bitmaps (a lower bound of the difference of two
sets) admit a link go on. Every accepted link is verified on the whole sets; no pair that could join two components is
left untested, so the components are exact (up to 64-bit collisions). Links are within components, so the links of a
document are counted there, again by pairs of blocks, as products of incidence matrices; ``linked_pairs`` writes them out.

Results for odd input: null or empty text, or text without a word, is an empty set, linked with nothing; fewer words than
a shingle make one shingle of the whole sequence; equal texts and repeated rows are one component; a null id takes part,
but a component's name is its least id that is not null (null if it has none); an empty table gives an empty result;
columns of the input are kept, those added are named ``_j_*``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import by_part, discard, joined, materialise, scratch, table, trimmed, without_prefix
from lodestone.llm.components import connected_components
from lodestone.llm.hasharrays import HashArrays, build, shard_bits, told, write_shard
from lodestone.llm.textscan import mix, slices, windows

BAND_RATIO = 1.5
BITMAP_LONGS = 16
#: Rounds at most in which each open bucket has a pivot of its own before the pairs across components are joined.
PIVOT_ROUNDS = 2
_U = np.uint64


# ------------------------------------------------------------------ sets


def sets_of(text: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of the texts: index of its first row, sorted distinct shingle hashes row after row, bounds of rows."""
    for s in slices(text, lower=True):
        starts, ends, firsts = s.words()
        words = s.hashes(starts, ends)
        counts = np.diff(firsts)
        shingles, _ = windows(words, firsts, width)
        sizes = np.maximum(counts - width + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = np.array([_sequence(words[firsts[i] : firsts[i + 1]]) for i in short], np.uint64)
            shingles = np.insert(shingles, (np.cumsum(sizes) - sizes)[short], whole)
            sizes[short] = 1
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for i in np.flatnonzero(sizes > 1).tolist():  # a row's hashes are sorted in place, far cheaper than one order of all rows
            shingles[bounds[i] : bounds[i + 1]].sort()
        fresh = np.ones(len(shingles), bool)
        fresh[1:] = shingles[1:] != shingles[:-1]
        fresh[bounds[:-1][sizes > 0]] = True
        yield s.first, shingles[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values of ``x``, sorted."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` (from 0 to 2^31) sorted, and where each value stood: one sort of both together is cheaper than an order of the values."""
    both = x.astype(np.uint64) << _U(32) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    return (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.int64)


def _sequence(words: np.ndarray) -> int:
    h = len(words)
    for w in words.tolist():
        h = ((h * 0xD6E8FEB86659FD93) + w) & 0xFFFFFFFFFFFFFFFF
    return h


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the ranges of ``values`` (modulo 2^64)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def entity_ids(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever the order of its elements."""
    return mix(_sums(mix(shingles), bounds) ^ mix(_sums(mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5)), bounds)))


def bitmaps(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps: bit b of a set is the parity of its elements with hash b; two sets differ in as many elements at least as their bitmaps in bits."""
    n, size = len(bounds) - 1, BITMAP_LONGS * 64
    spot = (mix(shingles ^ _U(0x1234567)) >> _U(54)).astype(np.int64) % size
    row = np.repeat(np.arange(n), np.diff(bounds))
    parity = (np.bincount(row * size + spot, minlength=n * size) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, size), axis=1).view(np.uint64).reshape(n, BITMAP_LONGS) if n else np.zeros((0, BITMAP_LONGS), np.uint64)


# ------------------------------------------------------------------ allocation


def difference(total: int, t: int) -> int:
    """Most elements in which two sets of ``total`` elements together differ when their Jaccard is at least t / 100."""
    return total * (100 - t) // (100 + t)


@dataclass(frozen=True)
class Band:
    """Sizes low <= a < high of indexed sets; ``segments`` of them, the first ``loose`` with one-deletion neighbourhoods."""

    number: int
    low: int
    high: int
    segments: int
    loose: int


def allocate(low: int, high: int, t: int) -> tuple[int, int]:
    """Segments and loose segments of a band: the cheapest by expected keys and accidental matches of a set of middling size."""
    a = high - 1
    need = difference(a + a * 100 // t, t) + 1
    size = (low + a) / 2
    best = None
    for loose in range(1, max(2, need // 8) + 1):
        segments = max(1, need - loose)
        while True:  # empty segments match for nothing: room for as many as are likely
            empty = math.exp(-low / segments)
            room = segments * empty + 2 * math.sqrt(segments * empty)
            if segments - room + loose >= need or segments > 2 * need + 8:
                break
            segments += 1
        filled = size / segments
        cost = segments + 2 * loose * filled + 20 * segments * math.exp(-filled) * (1 + filled)
        if best is None or cost < best[0]:
            best = cost, segments, loose
    return best[1], min(best[2], best[1])


@lru_cache(maxsize=64)
def bands(largest: int, t: int) -> tuple[Band, ...]:
    """Bands up to a size. Their edges do not depend on ``largest``, so all tasks agree."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, math.ceil(low * BAND_RATIO))
        out.append(Band(len(out), low, high, *allocate(low, high, t)))
        low = high
    return tuple(out)


@dataclass
class Cells:
    """Non-empty segments of some sets in one band, and the one-deletion variants of the loose ones among them.

    A cell belongs to the set ``row``; ``keys`` are the exact keys of the cells. ``owner`` is the cell of each variant. A
    loose segment of one element has no variant: the empty segment it leaves is never a key.
    """

    row: np.ndarray
    keys: np.ndarray
    owner: np.ndarray
    variants: np.ndarray
    #: what the set needs of matching segments, and whether the band is its own (it is indexed there)
    needed: np.ndarray
    own: bool


def cells_of(shingles: np.ndarray, bounds: np.ndarray, t: int) -> Iterator[Cells]:
    """The cells of the sets in their own band and in those below that can hold a partner. ``needed`` is by set."""
    sizes = np.diff(bounds)
    if not len(sizes) or not sizes.max():
        return
    for band in bands(int(sizes.max()), t):
        if not difference(band.high - 1 + (band.high - 1) * 100 // t, t):
            continue  # only equal sets link here, and they are one entity
        most = (band.high - 1) * 100 // t
        own = np.flatnonzero((sizes >= band.low) & (sizes < band.high))
        above = np.flatnonzero((sizes >= band.high) & (sizes <= most))
        for chosen, mine in ((own, True), (above, False)):
            # in pieces of bounded size
            for piece in np.array_split(chosen, max(1, int(sizes[chosen].sum()) // 400_000)) if len(chosen) else []:
                if len(piece):
                    yield _band_cells(shingles, bounds, piece, band, mine, t)


def _band_cells(shingles: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, band: Band, own: bool, t: int) -> Cells:
    sizes = (bounds[1:] - bounds[:-1])[chosen]
    m = band.segments
    take = np.repeat(bounds[chosen] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    tokens = shingles[take]
    spread = mix(tokens ^ _U(band.number * 0x9E3779B9 + 77))
    segment = ((spread >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
    cell = np.repeat(np.arange(len(chosen)), sizes) * m + segment
    cell, order = _ranked(cell)
    weights = mix(tokens[order] ^ _U(0x5DEECE66D))
    begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    filled = np.diff(np.append(begin, len(cell)))
    content = np.add.reduceat(weights, begin)
    row, seg = np.divmod(cell[begin], m)
    name = mix(np.arange(m, dtype=np.uint64) + _U(band.number << 32))[seg]
    loose = np.repeat((seg < band.loose) & (filled >= 2), filled)
    owner = np.repeat(np.arange(len(begin)), filled)[loose]
    variants = mix(content[owner] - weights[loose] + name[owner])
    needed = np.zeros(len(bounds) - 1, np.int64)
    needed[chosen] = (sizes + np.minimum(sizes, band.high - 1)) * (100 - t) // (100 + t) + 1
    return Cells(chosen[row], mix(content + name), owner, variants, needed, own)


def probes(cells: Cells, cost: np.ndarray, variant_cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which cells are probed, which are probed with their variants too, and the sets that their cells cannot cover.

    The costs are the numbers of sets that have the keys. A probed cell counts 1, with variants 1 more; the cheapest are
    taken until a set has what it needs.
    """
    soft = np.bincount(cells.owner, variant_cost, minlength=len(cells.keys))
    able = np.flatnonzero(np.bincount(cells.owner, minlength=len(cells.keys)) > 0)
    cell = np.concatenate((np.arange(len(cells.keys)), able))
    price = np.concatenate((cost, soft[able] + cost[able]))
    row = cells.row[cell]
    order = np.lexsort((cell, price, row))
    first = np.searchsorted(row[order], row[order])
    taken = order[np.arange(len(order)) - first < cells.needed[row[order]]]
    exact, softened = np.zeros(len(cells.keys), bool), np.zeros(len(cells.keys), bool)
    exact[cell[taken]] = True
    softened[cell[taken[taken >= len(cells.keys)]]] = True
    offered = np.bincount(row, minlength=len(cells.needed))
    return exact, softened, np.flatnonzero(offered < cells.needed)


# ------------------------------------------------------------------ join


def _scan(docs: DataFrame, text: str, names: list[str], schema: str, each) -> DataFrame:
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("_j_text"))
    return source.mapInArrow(trimmed(each), schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def entities(docs: DataFrame, text: str, width: int, keep: list[str]) -> DataFrame:
    """The columns ``keep``, _j_n (size of the set) and _j_entity (null for an empty set)."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_j_text"))
    schema = source.drop("_j_text").schema.add("_j_n", "long").add("_j_entity", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for first, shingles, bounds in sets_of(batch.column(batch.num_columns - 1), width):
                n[first : first + len(bounds) - 1] = np.diff(bounds)
                ids[first : first + len(bounds) - 1] = entity_ids(shingles, bounds)
            columns = [*batch.columns[:-1], pa.array(n), pa.array(ids.view(np.int64), mask=n == 0)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return source.mapInArrow(trimmed(each), schema)


PART_KEYS = 500_000
_FLUSH = 500_000
#: So many keys are looked up together: a lookup goes through every part of the counted keys, and their number grows with the corpus.
LOOKUP_KEYS = 500_000
_LONE = _U(0x6C6F6E65)


def _distinct_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, shingles and bounds of the sets of a batch, repeated and empty ones once and not at all."""
    seen = np.zeros(0, np.uint64)
    for _, shingles, bounds in sets_of(batch.column(0), width):
        ids, sizes = entity_ids(shingles, bounds), np.diff(bounds)
        once = np.zeros(len(ids), bool)
        once[np.unique(ids, return_index=True)[1]] = True
        once &= ~np.isin(ids, seen) & (sizes > 0)
        seen = np.concatenate((seen, ids[once]))
        yield ids[once], shingles[np.repeat(once, sizes)], np.concatenate(([0], np.cumsum(sizes[once])))


def counted_keys(docs: DataFrame, text: str, width: int, t: int, expected: int) -> HashArrays:
    """Sorted arrays of the keys that more than one set has, with the number of sets (payload n).

    A key is sent as 32 bits within its part, with 32 bits that stand for the set under this key. Two keys that fall
    together are counted together, which makes them look dearer and loses nothing.
    """
    bits = shard_bits(expected, PART_KEYS)
    arrays = HashArrays(scratch(docs.sparkSession, "shared-keys"), bits, {"n": "u4"}, 0)
    shift = _U(64 - bits) if bits else None

    def flush(held: list[np.ndarray], parts: np.ndarray) -> pa.RecordBatch:
        both = np.concatenate(held)
        parts, order = _ranked(parts)
        both = both[order]
        edges = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]))
        blocks = [_distinct(both[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(parts[edges[:-1]]), pa.array(blocks, pa.binary())], names=["part", "rows"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = [], [], 0
        for batch in batches:
            for ids, shingles, bounds in _distinct_sets(batch, width):
                for cells in cells_of(shingles, bounds, t):
                    row = np.concatenate((cells.row, cells.row[cells.owner]))
                    keys = np.concatenate((cells.keys, cells.variants))
                    low = (keys << _U(bits)) >> _U(32)
                    held.append(low << _U(32) | mix(ids[row] ^ keys) >> _U(32))
                    parts.append(keys >> shift if bits else np.zeros(len(keys), np.uint64))
                    size += len(keys)
                    if size > _FLUSH:
                        yield flush(held, np.concatenate(parts))
                        held, parts, size = [], [], 0
        if size:
            yield flush(held, np.concatenate(parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (blocks,) in by_part(batches):
            low = _distinct(joined(blocks, "u8")) >> _U(32)
            begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            n = np.diff(np.append(begin, len(low)))
            often = n >= 2
            keys = low[begin[often]] << _U(32 - bits)
            if bits:
                keys |= _U(k) << shift
            if often.any():
                yield told(k, write_shard(arrays, k, keys, {"n": n[often]}))

    sent = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(trimmed(send), "part long, rows binary")
    return arrays.seal(sent.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(trimmed(count), "shard long, n long"))


def bucket_rows(docs: DataFrame, text: str, width: int, t: int, counts: HashArrays) -> DataFrame:
    """(key, entity, n, indexed, probing, lone) of the keys that more than one set has, once for each set.

    ``lone``: a shingle of a set whose segments cannot cover what it needs; any of so many of its shingles that one must
    be in every partner.
    """
    mask = ~((_U(1) << _U(32 - counts.bits)) - _U(1))

    def found(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, Cells]]) -> Iterator[pa.RecordBatch]:
        counted = counts.find(np.concatenate([keys for *_, cells in held for keys in (cells.keys, cells.variants)]) & mask)[1]["n"].astype(np.int64)
        parts, upto = [], 0
        for ids, shingles, bounds, cells in held:
            sizes = np.diff(bounds)
            n = counted[upto : upto + len(cells.keys) + len(cells.variants)]
            upto += len(n)
            cost, variant_cost = n[: len(cells.keys)], n[len(cells.keys) :]
            exact, softened, lone = probes(cells, cost, variant_cost)
            row = np.concatenate((cells.row, cells.row[cells.owner]))
            keys = np.concatenate((cells.keys, cells.variants))
            probing = np.concatenate((exact, softened[cells.owner]))
            sent = (n >= 2) & (probing | cells.own)
            alone = [(i, mix(shingles[bounds[i] : bounds[i] + difference(2 * sizes[i], t) + 1] ^ _LONE)) for i in lone.tolist()]
            at = np.concatenate((row[sent], *[np.full(len(k), i) for i, k in alone])).astype(np.int64)
            more = sum(len(k) for _, k in alone)
            flags = [np.concatenate((x, np.full(more, y))) for x, y in ((np.full(sent.sum(), cells.own), False), (probing[sent], True), (np.zeros(sent.sum(), bool), True))]
            parts.append((np.concatenate((keys[sent], *[k for _, k in alone])), ids[at], sizes[at], *flags))
        keys, entity, sizes, *flags = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(keys):
            yield pa.RecordBatch.from_arrays([_signed(keys), _signed(entity), pa.array(sizes.astype(np.int32)), *map(pa.array, flags)], names=["key", "entity", "n", "indexed", "probing", "lone"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for ids, shingles, bounds in _distinct_sets(batch, width):
                for cells in cells_of(shingles, bounds, t):
                    held.append((ids, shingles, bounds, cells))
                    size += len(cells.keys) + len(cells.variants)
                    if size > LOOKUP_KEYS:
                        yield from found(held)
                        held, size = [], 0
            if held:
                yield from found(held)

    return _scan(docs, text, [], "key long, entity long, n int, indexed boolean, probing boolean, lone boolean", each)


def lone_partners(docs: DataFrame, text: str, width: int, t: int, wanted: HashArrays, largest: int | None = None) -> DataFrame:
    """Rows as ``bucket_rows`` gives them of every set that has a shingle in ``wanted`` and is small enough to link with the largest set that probes it.

    Sets whose segments cannot cover what they need are small, so a text of any other size never comes to these buckets,
    however common a shingle is. ``largest``: the size of the largest set that probes; the shingles of sets too large for it
    are not looked up.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, shingles, bounds in _distinct_sets(batch, width):
                if largest is not None:
                    small = t * np.diff(bounds) <= 100 * largest
                    ids, shingles, sizes = ids[small], shingles[np.repeat(small, np.diff(bounds))], np.diff(bounds)[small]
                    bounds = np.concatenate(([0], np.cumsum(sizes)))
                keys = mix(shingles ^ _LONE)
                known, found = wanted.find(keys)
                owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
                good = known & (t * np.diff(bounds)[owner] <= 100 * found["most"].astype(np.int64))
                at = owner[good]
                if len(at):
                    yes, no = np.ones(len(at), bool), np.zeros(len(at), bool)
                    yield pa.RecordBatch.from_arrays([_signed(keys[good]), _signed(ids[at]), pa.array(np.diff(bounds)[at].astype(np.int32)), *map(pa.array, (yes, no, no))], names=["key", "entity", "n", "indexed", "probing", "lone"])

    return _scan(docs, text, [], "key long, entity long, n int, indexed boolean, probing boolean, lone boolean", each)


def buckets(docs: DataFrame, text: str, width: int, t: int, expected: int) -> DataFrame:
    """(key, entity, n, indexed, probing) of the keys that some set probes and another has."""
    counts = counted_keys(docs, text, width, t, expected)
    once = ["key", "entity", "n"]
    flags = [F.max(c).alias(c) for c in ("indexed", "probing", "lone")]
    rows = materialise(bucket_rows(docs, text, width, t, counts).groupBy(*once).agg(*flags), "keys")
    counts.discard()
    alone = rows.where("lone").groupBy(F.col("key").alias("h")).agg(F.max("n").alias("most"))
    asked = alone.agg(F.count(F.lit(1)).alias("keys"), F.max("most").alias("largest")).first()
    if asked.keys:
        wanted = build(alone, asked.keys, "lone", {"most": "u4"})
        more = materialise(rows.unionByName(lone_partners(docs, text, width, t, wanted, asked.largest)).groupBy(*once).agg(*flags), "keys")
        wanted.discard()
        discard(rows)
        rows = more
    told_ = rows.groupBy("key").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"), F.max("probing").alias("p"), F.max("indexed").alias("i"))
    shared = materialise(rows.drop("lone").join(told_.where("lo <> hi and p and i").select("key"), "key"), "buckets")
    discard(rows)
    return shared


# ------------------------------------------------------------------ blocks


def in_blocks(rows: DataFrame, group: str, g: Column) -> DataFrame:
    """``rows`` dealt so that every two of a group meet: ``_g`` names the meeting, ``_side`` is 0, 1, or 2 (both) there.

    A group is cut by hash of the entity into ``g`` blocks of bounded size; each pair of blocks is a meeting, so no task
    holds a group, however large it is.
    """
    own = rows.withColumn("_n", g.cast("int")).withColumn("_b", F.expr("int(pmod(xxhash64(entity), _n))"))
    met = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.expr("case when _b = _o then 2 when _b < _o then 0 else 1 end")
    return met.select("*", F.xxhash64(group, F.least("_b", "_o"), F.greatest("_b", "_o")).alias("_g"), side.alias("_side")).drop("_n", "_b", "_o")


def _grouped_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of the first column, which is sorted, with the bounds of the groups. Only one group is ever held beyond a batch."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.RecordBatch, np.ndarray]:
        table_ = pa.Table.from_batches(held).combine_chunks()
        batch = table_.to_batches()[0]
        g = batch.column(0).to_numpy()
        return batch, np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield whole()
            held = []
        elif held and held[-1].column(0)[-1].as_py() != g[0]:
            yield whole()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield whole()


def _all_pairs(bounds: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i not j, of the rows of each group, in pieces of about ``most``."""
    sizes = np.diff(bounds)
    row = np.arange(bounds[0], bounds[-1])
    partners = np.repeat(sizes, sizes)
    upto = np.cumsum(partners)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        n = partners[a:b]
        i = np.repeat(row[a:b], n)
        first = np.repeat(bounds[:-1], sizes)[a:b]
        j = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        keep = i != j
        yield i[keep], j[keep]
        a = b


def _nearest(i: np.ndarray, j: np.ndarray, component: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the pairs are, for one of their two components, the pair least apart."""
    both = np.concatenate((component[i], component[j]))
    order = np.lexsort((np.concatenate((apart, apart)), both))
    first = np.ones(len(order), bool)
    first[1:] = both[order][1:] != both[order][:-1]
    return np.unique(order[first] % len(i))


def crossing(rest: DataFrame, t: int, nearest: bool = False, block: int = 512) -> DataFrame:
    """(src, dst): the pairs of sets of different components in a bucket, one probing and the other indexed, whose sizes and bitmaps admit a link.

    ``nearest``: of these only each component's nearest pair of a piece of a meeting, so that there are no more pairs than rows.
    """
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    dealt = in_blocks(rest.join(sizes, "key"), "key", F.col("_blocks")).select("_g", "_side", "entity", "n", "indexed", "probing", "component", "bits")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _grouped_batches(batches):
            side, entity, n, indexed, probing, component = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))
            lists = batch.column(7)
            bits = lists.flatten().to_numpy().view(np.uint64).reshape(-1, BITMAP_LONGS)
            for i, j in _all_pairs(bounds):
                a, b = n[j].astype(np.int64), n[i].astype(np.int64)
                good = probing[i] & indexed[j] & (component[i] != component[j]) & (a <= b) & (100 * a >= t * b) & ((side[i] == 2) | (side[i] != side[j]))
                i, j, total = i[good], j[good], (a + b)[good]
                apart = np.zeros(len(i), np.int64)
                for k in range(BITMAP_LONGS):
                    apart += np.bitwise_count(bits[i, k] ^ bits[j, k])
                good = np.flatnonzero(apart * (100 + t) <= total * (100 - t))
                if nearest and len(good):
                    good = good[_nearest(i[good], j[good], component, apart[good] / total[good])]
                if len(good):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(entity[i[good]], entity[j[good]])), pa.array(np.maximum(entity[i[good]], entity[j[good]]))], names=["src", "dst"])

    return dealt.repartition("_g").sortWithinPartitions("_g").mapInArrow(trimmed(each), "src long, dst long").distinct()


def _intersections(tokens: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right`` (indices), as products of incidence matrices."""
    names, column = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(names), columns):
        lo, hi = np.searchsorted(column, (a, a + columns))
        dense = np.zeros((len(bounds) - 1, min(columns, len(names) - a)), np.float32)
        dense[row[lo:hi], column[lo:hi] - a] = 1
        out += dense[left] @ dense[right].T
    return out.astype(np.int64)


def all_links(members: DataFrame, t: int, pairs: bool = False, block: int = 1024, tokens: int = 2_000_000) -> DataFrame:
    """Every link between different sets of one component. ``members``: component, entity, n, shingles.

    With ``pairs`` the links themselves (src, dst), as many as there are; otherwise (entity, copies): the entity once for
    each block it meets and the sum of ``copies``, a column of ``members``, over those it is linked with there.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / tokens)).alias("_blocks"))
    dealt = in_blocks(members.join(sizes, "component"), "component", F.col("_blocks")).select("_g", "_side", "entity", "copies", "shingles")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _grouped_batches(batches):
            side, entity, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            lists = batch.column(4)
            at = lists.offsets.to_numpy()[: batch.num_rows + 1]
            flat = lists.values.to_numpy().view(np.uint64)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                here = side[a:b]
                left = np.flatnonzero(here != 1)
                right = left if here[0] == 2 else np.flatnonzero(here == 1)
                if not len(left) or not len(right):
                    continue
                cut = at[a : b + 1] - at[a]
                common = _intersections(flat[at[a] : at[b]], cut, left, right)
                size = np.diff(cut)
                linked = 100 * common >= t * (size[left][:, None] + size[right][None, :] - common)
                if here[0] == 2:
                    np.fill_diagonal(linked, False)
                if pairs:
                    i, j = np.nonzero(np.triu(linked) if here[0] == 2 else linked)
                    x, y = entity[a:b][left[i]], entity[a:b][right[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["src", "dst"])
                    continue
                sums = [(left, linked @ copies[a:b][right])] + ([] if here[0] == 2 else [(right, copies[a:b][left] @ linked)])
                for who, n in sums:
                    yield pa.RecordBatch.from_arrays([pa.array(entity[a:b][who]), pa.array(n.astype(np.int64))], names=["entity", "copies"])

    return dealt.repartition("_g").sortWithinPartitions("_g").mapInArrow(trimmed(each), "src long, dst long" if pairs else "entity long, copies long")


def sets_in(docs: DataFrame, text: str, width: int, wanted: HashArrays) -> DataFrame:
    """(entity, n, bits, shingles) of the entities in ``wanted``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shingles, bounds in sets_of(batch.column(0), width):
                ids, sizes = entity_ids(shingles, bounds), np.diff(bounds)
                once = np.zeros(len(ids), bool)
                once[np.unique(ids, return_index=True)[1]] = True
                once &= wanted.find(ids)[0] & (sizes > 0)
                if not once.any():
                    continue
                kept, cut = shingles[np.repeat(once, sizes)], np.concatenate(([0], np.cumsum(sizes[once])))
                bits = bitmaps(kept, cut)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), _signed(kept))
                bit_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * BITMAP_LONGS), _signed(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([_signed(ids[once]), pa.array(sizes[once].astype(np.int32)), bit_lists, lists], names=["entity", "n", "bits", "shingles"])

    return _scan(docs, text, [], "entity long, n int, bits array<long>, shingles array<long>", each).dropDuplicates(["entity"])


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Those of the pairs (src, dst) that link: first by sizes and bitmaps alone, then by the whole sets."""
    light = sets.select("entity", "n", "bits")
    left = light.select(F.col("entity").alias("src"), F.col("n").alias("a"), F.col("bits").alias("x"))
    right = light.select(F.col("entity").alias("dst"), F.col("n").alias("b"), F.col("bits").alias("y"))
    apart = " + ".join(f"bit_count(x[{i}] ^ y[{i}])" for i in range(BITMAP_LONGS))
    likely = pairs.join(left, "src").join(right, "dst").where(f"100 * least(a, b) >= {t} * greatest(a, b)").where(f"({apart}) * {100 + t} <= (a + b) * {100 - t}").select("src", "dst")
    whole = sets.select("entity", "shingles")
    both = likely.join(whole.select(F.col("entity").alias("src"), F.col("shingles").alias("x")), "src").join(whole.select(F.col("entity").alias("dst"), F.col("shingles").alias("y")), "dst")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", common).where(f"100 * i >= {t} * (size(x) + size(y) - i)").select("src", "dst")


def links(docs: DataFrame, text: str, width: int, t: int, expected: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the entities that have a link, component being an entity; and the sets of the entities in buckets."""
    shared = buckets(docs, text, width, t, expected)
    members = shared.select(F.col("entity").alias("h")).distinct()
    arrays = build(members, members.count(), "bucketed")
    sets = materialise(sets_in(docs, text, width, arrays), "sets")
    arrays.discard()
    parts = None
    for turn in range(PIVOT_ROUNDS):
        rest = materialise(_open_rows(shared, parts), "open")
        rank = F.xxhash64("entity") if not turn else F.xxhash64(F.lit(turn), "key", "entity")
        pivots = rest.groupBy("key").agg(F.min(F.struct(rank.alias("r"), F.col("entity").alias("p"), F.col("component").alias("c"))).alias("m")).select("key", "m.p", "m.c")
        met = rest.join(pivots, "key").where("component <> c").select(F.least("p", "entity").alias("src"), F.greatest("p", "entity").alias("dst")).distinct()
        more = materialise(_verified(met, sets, t), "links")
        discard(rest)
        if more.isEmpty():
            discard(more)
            break
        parts = _merged(parts, more)
    # nearest pairs first: what they join needs none of its other pairs, so a group of near copies does not bring them all
    for nearest in (True, False):
        rest = materialise(_open_rows(shared, parts).join(sets.select("entity", "bits"), "entity"), "open")
        more = materialise(_verified(crossing(rest, t, nearest), sets, t), "links")
        if parts is None or not more.isEmpty():
            parts = _merged(parts, more)
        for used in (rest, more):
            discard(used)
    discard(shared)
    return parts, sets


def _open_rows(shared: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The rows of buckets of more than one component, with the component."""
    if parts is None:
        return shared.withColumn("component", F.col("entity"))
    named = shared.join(parts.select(F.col("node").alias("entity"), "component"), "entity", "left").withColumn("component", F.coalesce("component", "entity"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return named.join(mixed, "key")


def _merged(parts: DataFrame | None, more: DataFrame) -> DataFrame:
    """Components of the known ones and further links together; ``more`` is given up."""
    edges = more if parts is None else parts.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more)
    out = materialise(connected_components(edges), "parts")
    discard(parts)
    discard(more)
    return out


def _members(parts: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    named = parts.select(F.col("node").alias("entity"), "component")
    return sets.select("entity", "n", "shingles").join(named, "entity").join(copies, "entity")


def _expected(known: DataFrame) -> int:
    """About how many keys the sets have: their segments are some .3 of their size, and half as many again below."""
    return int(0.5 * (known.agg(F.sum("_j_n")).first()[0] or 0))


def linked_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, t: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as (src, dst) of entities, and the membership (``key``, entity) of the documents."""
    docs = without_prefix(docs, "_j_")
    known = materialise(entities(docs, text, width, [key]), "entities")
    parts, sets = links(docs, text, width, t, _expected(known))
    pairs = materialise(all_links(_members(parts, sets, sets.select("entity", F.lit(1).cast("long").alias("copies"))), t, pairs=True), "pairs")
    for used in (parts, sets):
        discard(used)
    return pairs, known.select(key, F.col("_j_entity").alias("entity"))


def with_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, t: int = 80, keep: list[str] | None = None, count: bool = False) -> DataFrame:
    """The columns ``keep`` (all by default), _j_n (size of the set), _j_group (the component; null for an empty set) and _j_component (its least ``key``).

    With ``count`` also _j_links: with how many other documents it is linked itself, copies included.
    """
    docs = without_prefix(docs, "_j_")
    names = docs.columns if keep is None else keep
    known = materialise(entities(docs, text, width, list(dict.fromkeys([*names, key]))), "entities")
    parts, sets = links(docs, text, width, t, _expected(known))
    # by entity first: combined before the shuffle, so a text with many copies is one row here
    single = known.where("_j_entity is not null").groupBy("_j_entity").agg(F.min(F.col(f"`{key}`")).alias("_j_least"), F.count(F.lit(1)).alias("_j_copies"))
    placed = single.join(parts.select(F.col("node").alias("_j_entity"), F.col("component").alias("_j_part")), "_j_entity", "left").withColumn("_j_group", F.coalesce("_j_part", "_j_entity")).drop("_j_part")
    told_ = placed.groupBy("_j_group").agg(F.min("_j_least").alias("_j_component"))
    named = placed.drop("_j_least").join(told_, "_j_group")
    extra = []
    if count:
        copies = single.select(F.col("_j_entity").alias("entity"), F.col("_j_copies").alias("copies"))
        linked = all_links(_members(parts, sets, copies), t).groupBy(F.col("entity").alias("_j_entity")).agg(F.sum("copies").alias("_j_linked"))
        named = named.join(linked, "_j_entity", "left").withColumn("_j_links", F.col("_j_copies") - 1 + F.coalesce("_j_linked", F.lit(0)))
        extra = [F.coalesce("_j_links", F.lit(0)).cast("long").alias("_j_links")]
    named = materialise(named.select("_j_entity", "_j_group", "_j_component", *(["_j_links"] if count else [])), "named")
    for used in (parts, sets):
        discard(used)
    # the documents of one text may be a large part of all: this join has no aggregate beside it, so the planner can split them
    out = known.join(named, "_j_entity", "left").withColumn("_j_component", F.coalesce("_j_component", F.col(f"`{key}`")))
    return out.select(*[F.col(f"`{c}`") for c in names], "_j_n", "_j_group", "_j_component", *extra)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = with_components(docs, width=4, t=85, keep=["doc_id"], count=True)
    return out.select("doc_id", F.col("_j_n").alias("n_shingles"), F.col("_j_component").alias("component_id"), F.col("_j_links").alias("n_links"))
