"""Shared pieces of the training-data operators: inputs, shared scratch, small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Texts are long: so many rows at most go to a Python worker at once where the session has Spark's own default.
BATCH_ROWS, _DEFAULT_ROWS = 2_000, "10000"


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == _DEFAULT_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, with its scheme: spark.checkpoint.dir, or, where that is unset (tests on one machine), a new one.

    A path without a scheme is one of the cluster's default file system, as Spark itself takes it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


#: Spark's own setting for deleting the shuffle files of a query when it has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. ``free``: delete the write's shuffle files at its end."""
    path = scratch(df.sparkSession, label)
    before = df.sparkSession.conf.get(_FREE_SHUFFLES, "false")
    df.sparkSession.conf.set(_FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(_FREE_SHUFFLES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` without columns named as an operator names its own: what stood there (from an earlier run, say) is replaced."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(spark: SparkSession) -> int:
    """Partitions for a keyed exchange, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns of batches sorted by their first column, one value of it at a time."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = np.concatenate(([0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1, [batch.num_rows]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if columns[0][a] != now and held:
                yield int(now), [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = columns[0][a]
            held.append([c[a:b] for c in columns[1:]])
    if held:
        yield int(now), [np.concatenate(c) for c in zip(*held, strict=True)]


def joined(blocks: np.ndarray, dtype: str) -> np.ndarray:
    """Blocks of bytes as one array."""
    return np.frombuffer(b"".join(blocks), dtype)


#: After so many batches a worker gives free memory back.
_TRIM_EVERY = 8


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` for mapInArrow, giving free memory back to the system now and then and at its end: workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(each(batches), 1):
            yield batch
            if k % _TRIM_EVERY == 0:
                del batch
                _trim()
        gc.collect()
        _trim()

    return run
