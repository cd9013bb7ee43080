"""SentencePiece encoding with seeded merge-dropout, and decoding.

The merge-type segmentation of a word starts from its characters and joins, again and again, the neighbouring pieces
whose union has the best score in the vocabulary (the leftmost of equal ones), by an agenda. With dropout, a candidate
merge is skipped when it comes up if a keyed hash of (seed, document key, position of the word in the document, place,
rank of the union) falls below the rate: no state is drawn from, so an encoding depends on nothing but its key and can be
repeated on any executor, and every occurrence of a word is segmented for itself. Characters outside the vocabulary
become byte pieces, so every text decodes to itself. As merges cross neither from a word into the space before the next
one nor a newline (checked when the vocabulary is read), work is done by word. The agendas of many words are worked off
together, one step of each at a time, with array operations. A word without dropout is worked off once and remembered, in
a memory of bounded size that only saves time, with the candidates that it meets; an occurrence none of whose candidates
is skipped takes that way, and every other occurrence has its agenda worked off for itself.

Another seed (for another epoch) gives other segmentations.
The vocabulary's path is a parameter; the driver reads the file and sends it to the tasks.

Results for odd input: null text gives null ids, which decode to null; the empty text gives no ids; a null key is a key
like others; repeated rows give repeated results; an empty table gives an empty result; the letter that marks spaces is
encoded by its bytes, so it is not taken for a space; columns of the input are kept, but for one
of the new column's name, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import table, trimmed, without_prefix

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED = 100_000
SHORT = 40
BLOCK = 100_000
BLOCK_BYTES = 1 << 20
NEVER = 1 << 62
NONE = (1 << 31) - 1
_NORMAL, _USER, _BYTE = 1, 4, 6


@dataclass(eq=False)
class Vocabulary:
    """Pieces of a merge-type model with byte pieces and no normalisation."""

    ids: dict[str, int]
    rank: dict[str, int]
    bytes_: list[int]
    spelled: list[bytes]
    dummy_prefix: bool
    words: re.Pattern

    _merges: Merges | None = None

    def merges(self) -> Merges:
        if self._merges is None:
            self._merges = Merges(self)
        return self._merges

    @staticmethod
    def parse(content: bytes) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(content)
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte pieces is needed")
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("the model's normaliser changes texts: they could not be decoded without loss")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (_NORMAL, _USER)}
        if any("\n" in p or p.strip(MARK) and MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("the vocabulary has pieces across words")
        if MARK not in ids:
            raise ValueError("the vocabulary has no space")
        by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        spelled = [p.piece.replace(MARK, " ").encode() for p in model.pieces]
        for b, i in by_byte.items():
            spelled[i] = bytes([b])
        order = {x: r for r, x in enumerate(sorted({-model.pieces[i].score for i in ids.values()}))}
        return Vocabulary(ids, {p: order[-model.pieces[i].score] for p, i in ids.items()}, [by_byte[b] for b in range(256)], spelled, model.normalizer_spec.add_dummy_prefix, re.compile(f" *[^ \n{MARK}]+| +|\n|{MARK}"))

    def encode_word(self, word: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """Ids of a run of spaces and letters; each candidate merge whose hash under ``key`` falls below ``rate`` is skipped."""
        if word == MARK:
            return [self.bytes_[b] for b in word.encode()]
        bound = int(rate * 2**64)
        own = key | 1 if bound else 0
        merge = self._merged_short if len(word) <= SHORT else self._merged_long
        return self.ids_of(merge(word.replace(" ", MARK), own, bound))

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            k = self.ids.get(p)
            if k is None:
                out += [self.bytes_[b] for b in p.encode()]
            else:
                out.append(k)
        return out

    def _merged_short(self, word: str, own: int, bound: int) -> list[str]:
        """The agenda as a list of the neighbours' ranks: for words of some letters the fastest way to its least."""
        rank = self.rank.get
        pieces, starts = list(word), list(range(len(word)))
        ranks = [rank(a + b, NEVER) for a, b in zip(word, word[1:])]  # noqa: B905
        while ranks:
            r = min(ranks)
            if r == NEVER:
                break
            i = ranks.index(r)
            if bound and own * (r << 33 | starts[i] << 1 | 1) & 0xFFFFFFFFFFFFFFFF < bound:
                ranks[i] = NEVER
                continue
            union = pieces[i] = pieces[i] + pieces.pop(i + 1)
            del starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(union + pieces[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(pieces[i - 1] + union, NEVER)
        return pieces

    def _merged_long(self, word: str, own: int, bound: int) -> list[str]:
        """The same with a heap and links between the pieces: n log n for a word of any length."""
        rank = self.rank.get
        pieces = list(word)
        n = len(pieces)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = pieces[i], after[i]
            if not left or j >= n or rank(left + pieces[j]) != r:
                continue  # merged since
            if bound and own * (r << 33 | i << 1 | 1) & 0xFFFFFFFFFFFFFFFF < bound:
                continue
            union = pieces[i] = left + pieces[j]
            pieces[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(union + pieces[k])) is not None:
                    heappush(agenda, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(pieces[h] + union)) is not None:
                heappush(agenda, r << 32 | h)
        return [p for p in pieces if p]

    def encode(self, text: str, memory: Memory, key: int = 0) -> bytes:
        """Ids of a text as 32-bit numbers. ``key``: of the document, for dropout."""
        return memory.encode([text], [key])[0].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of the ids."""
        spelled = self.spelled
        out = b"".join([spelled[k] for k in ids])
        return (out[1:] if self.dummy_prefix and out[:1] == b" " else out).decode("utf-8", "replace")


def _mixed(key: int, first: int, n: int) -> np.ndarray:
    """An odd number for each of n positions of a document (splitmix64)."""
    return _own(np.full(n, key & 0xFFFFFFFFFFFFFFFF, np.uint64), np.arange(first, first + n))


def _own(keys: np.ndarray, positions: np.ndarray) -> np.ndarray:
    x = (positions.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + keys
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31) | np.uint64(1)


def _flat(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ranges ``which``, one after another, and their lengths."""
    n = (bounds[1:] - bounds[:-1])[which]
    ends = np.cumsum(n)
    return np.repeat(bounds[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), n


class Merges:
    """The vocabulary's merges as a hash table from two neighbours to rank and union, and agendas worked off in step.

    A piece is its id; a letter that is no piece is its code point plus the size of the vocabulary, and merges with nothing
    but what the vocabulary says.
    """

    def __init__(self, v: Vocabulary):
        self.size = len(v.spelled)
        self.letter = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in v.ids.items():
            if len(p) == 1 and p != MARK:
                self.letter[ord(p)] = i
        self.letter[0x20] = v.ids[MARK]
        self.by_byte = np.array(v.bytes_, np.int32)
        name = lambda p: v.ids.get(p, self.size + ord(p) if len(p) == 1 else None)
        table: dict[int, tuple[int, int]] = {}
        for p, i in v.ids.items():
            for k in range(1, len(p)):
                a, b = name(p[:k]), name(p[k:])
                if a is not None and b is not None:
                    table[a << 32 | b] = v.rank[p], i
        keys = np.fromiter(table, np.int64, len(table))
        values = np.array(list(table.values()), np.int32).reshape(-1, 2)
        self.shift = np.uint64(64 - max(4, (len(keys) * 8).bit_length()))
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        # linear probing: a key goes to its slot or the first free one after it
        place = np.maximum.accumulate(slots[order] - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else slots
        self.reach = int((place - slots[order]).max()) + 1 if len(keys) else 0
        room = int(place[-1]) + 2 + self.reach if len(keys) else 2
        self.keys = np.full(max(room, (1 << int(64 - int(self.shift))) + self.reach + 1), -1, np.int64)
        self.ranks, self.unions = np.full(len(self.keys), NONE, np.int32), np.full(len(self.keys), -1, np.int32)
        self.keys[place], self.ranks[place], self.unions[place] = keys[order], values[order, 0], values[order, 1]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the pairs; one whose rank is NONE where there is no such merge."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = self._slot(keys)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.reach):
            if not len(open_):
                break
            at[open_] += 1
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        at[self.keys[at] != keys] = len(self.keys) - 1  # never taken
        return at

    def run(self, flat: np.ndarray, bounds: np.ndarray, own: np.ndarray | None = None, bound: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words (letters one after another) and their bounds; without ``own`` also the codes of the merges made, and their bounds."""
        n = np.diff(bounds)
        rows = len(n)
        done: list[tuple] = []
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 8, 10, 13, 18, 26, SHORT):
            group = np.flatnonzero((n > low) & (n <= high))
            low = high
            for some in np.array_split(group, max(1, len(group) * high // 400_000)) if len(group) else []:
                done.append((some, *self._run(flat, bounds, some, high, None if own is None else own[some], bound)))
        out, out_bounds = _gathered(rows, [(d[0], d[1]) for d in done], np.int32, -1)
        codes, code_bounds = _gathered(rows, [(d[0], d[2]) for d in done], np.uint64, 0)
        return out, out_bounds, codes, code_bounds

    def _run(self, flat: np.ndarray, bounds: np.ndarray, which: np.ndarray, width: int, own: np.ndarray | None, bound: int) -> tuple[np.ndarray, np.ndarray]:
        # a piece stays in the column of its first letter: merges only change what its neighbours are, nothing is moved
        columns = np.arange(width + 1)
        at = bounds[which][:, None] + columns
        piece = np.where(at < bounds[which + 1][:, None], flat[np.minimum(at, len(flat) - 1)], -1)
        out = piece[:, :width].copy()
        codes = np.zeros((len(which), max(0, width - 1)), np.uint64)
        if width < 2:
            return out, codes
        after = np.broadcast_to((columns + 1).astype(np.int8), piece.shape).copy()
        before = np.broadcast_to((columns - 1).astype(np.int8), piece.shape).copy()
        rank = np.full((len(which), width), NONE, np.int32)
        rank[:, :-1] = self.ranks[self.look(piece[:, : width - 1].ravel(), piece[:, 1:width].ravel())].reshape(len(which), -1)
        live, step = np.arange(len(which)), 0
        while True:
            k = rank.argmin(1)
            every = np.arange(len(live))
            best = rank[every, k]
            going = best != NONE
            n = np.count_nonzero(going)
            if 4 * n < 3 * len(live):
                out[live[~going]] = piece[~going, :width]
                if not n:
                    return out, codes
                live, piece, after, before, rank, k, best = (x[going] for x in (live, piece, after, before, rank, k, best))
                every = np.arange(n)
            elif n < len(live):
                every = np.flatnonzero(going)
                k, best = k[every], best[every]
            code = best.astype(np.uint64) << np.uint64(33) | k.astype(np.uint64) << np.uint64(1) | np.uint64(1)
            if own is None:
                codes[live[every], step] = code
            else:
                skipped = own[live[every]] * code < np.uint64(bound)
                if skipped.any():
                    rank[every[skipped], k[skipped]] = NONE
                    every, k = every[~skipped], k[~skipped]
                    if not len(every):
                        continue
            right = after[every, k].astype(np.int64)
            union = self.unions[self.look(piece[every, k], piece[every, right])]
            beyond = after[every, right].astype(np.int64)
            piece[every, k], piece[every, right], rank[every, right] = union, -1, NONE
            after[every, k], before[every, beyond] = beyond, k
            rank[every, k] = self.ranks[self.look(union, piece[every, beyond])]
            left = before[every, k]
            some = np.flatnonzero(left >= 0)
            row, left = every[some], left[some].astype(np.int64)
            rank[row, left] = self.ranks[self.look(piece[row, left], union[some])]
            step += 1

    def spelled(self, pieces: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces: letters that are no pieces as bytes."""
        odd = pieces >= self.size
        if not odd.any():
            return pieces, bounds
        point = pieces - self.size
        length = np.where(odd, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        to = np.concatenate(([0], np.cumsum(length)))
        out = np.repeat(pieces, length)
        for i in np.flatnonzero(odd).tolist():
            out[to[i] : to[i + 1]] = self.by_byte[list(chr(point[i]).encode())]
        return out, to[bounds]


def _gathered(rows: int, parts: list[tuple[np.ndarray, np.ndarray]], dtype, nothing) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of some rows each, padded with ``nothing`` at the right, as one sequence in order of the rows."""
    n = np.zeros(rows, np.int64)
    for some, values in parts:
        n[some] = (values != nothing).sum(1)
    bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(bounds[-1], dtype)
    for some, values in parts:
        out[_flat(bounds, some)[0]] = values[values != nothing]
    return out, bounds


class _Numbers(dict):
    """Numbers of words, given when first asked for."""

    def __init__(self, prefix: str, words: list[str]):
        super().__init__()
        self.prefix, self.words = prefix, words

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.words)
        self.words.append(self.prefix + word)
        return k


class Memory:
    """Words met by a task, with what their agenda gives without dropout; forgotten when there are too many."""

    def __init__(self, v: Vocabulary, rate: float = 0.0):
        self.v, self.rate, self.bound = v, rate, min(int(rate * 2**64), 2**64 - 1)
        self.merges = v.merges()
        self._forget()

    def _forget(self) -> None:
        self.words: list[str] = []
        self.plain, self.spaced = _Numbers("", self.words), _Numbers(" ", self.words)
        none, zero = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # letters, ids without dropout and codes of the merges, each with bounds by word
        self.letters, self.ids, self.codes = [none, zero], [none, zero], [none.astype(np.uint64), zero]
        self.long = np.zeros(0, bool)

    def _learn(self) -> None:
        """Work off the agendas of the words that are new."""
        new = self.words[len(self.long) :]
        if not new:
            return
        n = np.array([len(w) for w in new])
        long = n > SHORT
        letters = self.merges.letter[np.frombuffer("".join(w for w in new if len(w) <= SHORT).encode("utf-32-le", "surrogatepass"), np.uint32)]
        bounds = np.concatenate(([0], np.cumsum(np.where(long, 0, n))))
        pieces, piece_bounds, codes, code_bounds = self.merges.run(letters, bounds)
        ids, id_bounds = self.merges.spelled(pieces, piece_bounds)
        if long.any() and not self.bound:
            cut = np.diff(id_bounds)
            parts = np.split(ids, id_bounds[1:-1])
            for i in np.flatnonzero(long).tolist():
                parts[i] = np.array(self.v.encode_word(new[i]), np.int32)
                cut[i] = len(parts[i])
            ids, id_bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum(cut)))
        for held, values, at in ((self.letters, letters, bounds), (self.ids, ids, id_bounds), (self.codes, codes, code_bounds)):
            held[0], held[1] = np.concatenate((held[0], values)), np.concatenate((held[1], at[1:] + held[1][-1]))
        self.long = np.concatenate((self.long, long))

    def _numbers(self, text: str) -> list[int]:
        v, plain, spaced = self.v, self.plain, self.spaced
        text = " " + text if v.dummy_prefix and text else text
        if MARK in text or "  " in text:
            return [plain[w] for w in v.words.findall(text)]
        out: list[int] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if first:
                out.append(plain[first])
            out.extend(map(spaced.__getitem__, rest))
            out.append(plain["\n"])
        out.pop()
        return out

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of some texts (as much as can be held several times), under the keys of their documents."""
        if len(self.words) > REMEMBERED:
            self._forget()
        found = [np.array(self._numbers(t), np.int64) for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        word = np.concatenate(found) if found else np.zeros(0, np.int64)
        self._learn()
        size = np.diff(self.ids[1])[word]
        hit = np.zeros(len(word), bool)
        dropped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if self.bound and len(word):
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            own = _own(np.repeat(np.array(keys, np.int64).view(np.uint64), n), np.arange(len(word)) - np.repeat(first, n))
            for a in range(0, len(word), BLOCK):
                block = slice(a, min(a + BLOCK, len(word)))
                at, times = _flat(self.codes[1], word[block])
                owner = np.repeat(np.arange(block.start, block.stop), times)
                hit[owner[self.codes[0][at] * own[owner] < np.uint64(self.bound)]] = True
            hit |= self.long[word]
            for a in range(0, len(word), BLOCK):
                some = a + np.flatnonzero(hit[a : a + BLOCK] & ~self.long[word[a : a + BLOCK]])
                if len(some):
                    at, times = _flat(self.letters[1], word[some])
                    pieces, bounds, _, _ = self.merges.run(self.letters[0][at], np.concatenate(([0], np.cumsum(times))), own[some], self.bound)
                    ids, bounds = self.merges.spelled(pieces, bounds)
                    dropped.append((some, ids, bounds))
            for i in np.flatnonzero(self.long[word]).tolist():
                ids = np.array(self.v.encode_word(self.words[word[i]], self.rate, int(own[i])), np.int32)
                dropped.append((np.array([i]), ids, np.array([0, len(ids)])))
        for some, _, bounds in dropped:
            size[some] = np.diff(bounds)
        to = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(to[-1], np.int32)
        rest = np.flatnonzero(~hit)
        out[_flat(to, rest)[0]] = self.ids[0][_flat(self.ids[1], word[rest])[0]]
        for some, ids, _ in dropped:
            out[_flat(to, some)[0]] = ids
        return np.split(out, to[np.cumsum(n)[:-1]]) if len(texts) else []


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as source:
        return Vocabulary.parse(source.read())


@lru_cache(maxsize=2)
def _parsed(model: bytes) -> Vocabulary:
    return Vocabulary.parse(model)


def _shipped(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast: some hundred KB, whatever the data."""
    with open(path, "rb") as source:
        return spark.sparkContext.broadcast(source.read())


def with_ids(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = "ids", seed: int = 1, rate: float = 0.1, model: str = MODEL, keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the ids of each whole text. ``rate`` 0: the plain segmentation.

    ``decoded``: also the text that these ids decode to, under this name, in the same pass (one Python worker a task).
    """
    docs = without_prefix(docs, "_v_")
    names = [c for c in (docs.columns if keep is None else keep) if c not in (name, decoded)]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("_v_key"), F.col(f"`{text}`").cast("string").alias("_v_text"))
    schema = source.drop("_v_key", "_v_text").schema.add(name, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")

    shared = _shipped(docs.sparkSession, model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _parsed(shared.value)
        memory = Memory(v, rate)  # of this task only: a worker serves other stages too
        for batch in batches:
            keys = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            texts = batch.column(batch.num_columns - 1)
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            done = 0
            while done < batch.num_rows:  # some texts at a time: bounded memory
                end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + BLOCK_BYTES, "right")))
                part = slice(done, end)
                some = texts[part]
                ids = memory.encode([t or "" for t in some.to_pylist()], keys[part].tolist())
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids), pa.int32()), mask=some.is_null())
                back = [pa.array([None if null else v.decode(x.tolist()) for x, null in zip(ids, some.is_null().to_pylist(), strict=True)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*[c[part] for c in batch.columns[:-2]], lists, *back], names=schema.fieldNames())
                done = end

    return source.mapInArrow(trimmed(each), schema)


def with_text(encoded: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and the text of the ids of each row."""
    encoded = without_prefix(encoded, "_v_")
    names = [c for c in (encoded.columns if keep is None else keep) if c != name]
    source = encoded.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias("_v_ids"))
    schema = source.drop("_v_ids").schema.add(name, "string")

    shared = _shipped(encoded.sparkSession, model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _parsed(shared.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            texts = [None if null[i] else v.decode(flat[bounds[i] : bounds[i + 1]].tolist()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(trimmed(each), schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return with_ids(docs, keep=["doc_id", "text"], decoded="decoded").select(
        "doc_id", F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
