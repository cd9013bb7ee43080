"""Sorted arrays of 64-bit hashes in the shared folder, written by tasks and memory-mapped by Python workers.

A table is cut by the top bits of the hash into shards of bounded size, each sorted by the task that owns it and put in
place with an atomic rename, so a repeated or speculative task does no harm. Beside the hashes stand any number of
payload arrays. A manifest, written by the driver when all shards are there, has the rows of each: a shard that it names
and that is missing or short is an error, never an empty one. Workers map the files of a shard when they first need it;
where the shared folder is not a mounted file system, shards are read into memory, the least used ones let go beyond
``HELD_BYTES``.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialise, remove, scratch, trimmed

SHARD_ROWS = 1 << 20
HELD_BYTES = 64 << 20


def _store(uri: str) -> tuple[fs.FileSystem, str, bool]:
    """File system, path and whether the path can be mapped. ``uri`` has a scheme (``common.shared_dir`` sees to it)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), True
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, False


def save(uri: str, name: str, values: np.ndarray) -> None:
    """Write one array in place at once."""
    system, path, local = _store(uri)
    system.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(np.ascontiguousarray(values).data if len(values) else b"")
    if local:
        os.replace(temporary, f"{path}/{name}")
    else:
        system.move(temporary, f"{path}/{name}")


def load(uri: str, name: str, dtype: str, rows: int | None = None) -> np.ndarray:
    """An array that ``save`` wrote. A missing one, or one not of ``rows`` values where that is given, is an error."""
    system, path, local = _store(uri)
    at = f"{path}/{name}"
    info = system.get_file_info(at)
    size = np.dtype(dtype).itemsize
    if info.type == fs.FileType.NotFound or rows is not None and info.size != rows * size:
        raise FileNotFoundError(f"{uri}/{name} is missing or incomplete")
    if not info.size:
        return np.zeros(0, dtype)
    if local:
        return np.memmap(at, dtype, "r")
    with system.open_input_stream(at) as source:
        return np.frombuffer(source.read(), dtype)


@dataclass
class HashArrays:
    """What is needed to open the arrays; cheap to send to tasks."""

    uri: str
    bits: int
    payload: dict[str, str]
    rows: int
    _open: OrderedDict = field(default_factory=OrderedDict)
    _sizes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": OrderedDict(), "_sizes": None}

    def only(self, *columns: str) -> HashArrays:
        """The same arrays with some of the payload."""
        return HashArrays(self.uri, self.bits, {c: self.payload[c] for c in columns}, self.rows)

    def seal(self, written: DataFrame) -> HashArrays:
        """Runs ``written``, whose tasks write the shards and give (shard, n), and notes the rows of every shard.

        The driver sees one number a shard of about a million rows.
        """
        sizes = np.zeros(1 << self.bits, np.uint64)
        noted = materialise(written.select("shard", "n"), "sizes", free=True)
        for r in noted.toLocalIterator():
            sizes[r.shard] = r.n
        discard(noted)
        self.rows = int(sizes.sum())
        save(self.uri, "sizes", sizes)
        return self

    def discard(self) -> None:
        """Delete the files, once nothing reads them any more."""
        remove(SparkSession.active(), self.uri)

    def size(self, k: int) -> int:
        if self._sizes is None:
            self._sizes = load(self.uri, "sizes", "u8", 1 << self.bits)
        return int(self._sizes[k])

    def shard(self, k: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        if k not in self._open:
            n = self.size(k)
            if n:
                self._open[k] = load(self.uri, f"{k}.hash", "u8", n), {c: load(self.uri, f"{k}.{c}", t, n) for c, t in self.payload.items()}
            else:
                self._open[k] = np.zeros(0, np.uint64), {c: np.zeros(0, t) for c, t in self.payload.items()}
            held = sum(a.nbytes for h, p in self._open.values() for a in (h, *p.values()) if not isinstance(a, np.memmap))
            while held > HELD_BYTES and len(self._open) > 1:
                h, p = self._open.popitem(last=False)[1]
                held -= sum(a.nbytes for a in (h, *p.values()) if not isinstance(a, np.memmap))
        else:
            self._open.move_to_end(k)
        return self._open[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each hash is there, and its payload (0 where it is not)."""
        known = np.zeros(len(hashes), bool)
        out = {c: np.zeros(len(hashes), t) for c, t in self.payload.items()}
        if not self.rows or not len(hashes):
            return known, out
        order = None if bool((hashes[1:] >= hashes[:-1]).all()) else np.argsort(hashes)  # neighbours in the files are read together
        ranked = hashes if order is None else hashes[order]
        shards = ranked >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(ranked), np.uint64)
        edges = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ranked)], strict=True):
            values, payload = self.shard(int(shards[a]))
            if not len(values):
                continue
            values, payload = np.asarray(values), {c: np.asarray(array) for c, array in payload.items()}  # a map's own slicing is slow
            at = np.searchsorted(values, ranked[a:b])
            at[at == len(values)] = 0
            good = values[at] == ranked[a:b]
            if order is None:
                known[a:b] = good
                where = np.flatnonzero(good)
                for c, array in payload.items():
                    out[c][a:b][where] = array[at[where]]
                continue
            where = order[a:b][good]
            known[where] = True
            for c, array in payload.items():
                out[c][where] = array[at[good]]
        return known, out


def shard_bits(rows: int, most: int = SHARD_ROWS) -> int:
    """How many bits of the hash tell shards of about ``most`` rows apart."""
    return max(0, int(np.ceil(np.log2(rows / most)))) if rows > most else 0


def write_shard(arrays: HashArrays, k: int, hashes: np.ndarray, payload: dict[str, np.ndarray]) -> int:
    """Sort and store a whole shard; gives its rows."""
    order = np.argsort(hashes)
    for c, t in arrays.payload.items():
        save(arrays.uri, f"{k}.{c}", payload[c][order].astype(t))
    save(arrays.uri, f"{k}.hash", hashes[order])
    return len(hashes)


def told(k: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64())], names=["shard", "n"])


def build(df: DataFrame, rows: int, label: str, payload: dict[str, str] | None = None) -> HashArrays:
    """Arrays of ``df``: a bigint column ``h`` without repetitions and the payload columns (name: numpy type). ``rows``: about how many."""
    payload = payload or {}
    spark = df.sparkSession
    bits = shard_bits(rows)
    shards = 1 << bits
    arrays = HashArrays(scratch(spark, label), bits, payload, rows)
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    placed = df.select(F.col("h").cast("long").alias("h"), *payload).withColumn("_shard", shard).repartition(max(1, min(shards, 4096)), "_shard").sortWithinPartitions("_shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            joined = [np.concatenate(c) for c in zip(*held, strict=True)]
            return told(now, write_shard(arrays, now, joined[0].view(np.uint64), dict(zip(payload, joined[1:], strict=True))))

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            edges = [0, *(np.flatnonzero(np.diff(columns[-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if now is not None and columns[-1][a] != now:
                    yield flush()
                    held = []
                now = int(columns[-1][a])
                held.append([c[a:b] for c in columns[:-1]])
        if held:
            yield flush()

    return arrays.seal(placed.mapInArrow(trimmed(write), "shard long, n long"))
