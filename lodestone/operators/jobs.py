"""Work that can be taken up again: batches that are committed once, and columns kept under the content of their input.

A job gives each row of its pool a batch once, by order, and stores the pool by batch; a batch's decisions are a table of
their own, committed by Spark's marker file. A batch without the marker is done anew, one with it never again, so a row
is decided once however often the job is stopped. Reading a batch does not read the others.

A fingerprint is that of a table's columns, number of rows and rows' hashes, whatever their order or partitions.

Results for odd input: an empty pool has no batches; a null key is a key like others; rows of equal order are dealt in any
order, but once; repeated keys are decided each; a validation that gives other keys than it was given is an error; other settings, or another pool,
than a stored job's are an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.groups import numbered
from lodestone.sources import files


def fingerprint(df: DataFrame) -> dict:
    """Columns, rows and two sums over 64-bit hashes of rows."""
    row = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in sorted(df.columns)])
    other = F.xxhash64(F.lit(2), *[F.col(f"`{c}`") for c in sorted(df.columns)])
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("a"), F.sum(other.cast("decimal(38,0)")).cast("string").alias("b")).first()
    return {"columns": sorted(f"{n} {t}" for n, t in df.dtypes), "rows": found.n, "hashes": [found.a, found.b]}


def kept_columns(df: DataFrame, compute: Callable[[DataFrame], DataFrame], folder: str, settings: Mapping | None = None) -> DataFrame:
    """``compute(df)``, stored in ``folder`` under the content of ``df`` and the settings (which have to name the computation): found again instead of computed again.

    An incomplete table of an earlier attempt is overwritten.
    """
    told = json.dumps([fingerprint(df), dict(settings or {})], sort_keys=True)
    path = f"{folder}/{hashlib.sha256(told.encode()).hexdigest()[:32]}"
    spark = df.sparkSession
    if not files.committed(spark, path):
        compute(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class BatchJob:
    """Validates a pool batch by batch in a folder that the cluster shares."""

    def __init__(self, pool: DataFrame, folder: str, key: str, order: str, size: int, settings: Mapping | None = None) -> None:
        if size <= 0:
            raise ValueError("a batch has at least one row")
        self.spark: SparkSession = pool.sparkSession
        self.folder, self.key = folder, key
        manifest = {"pool": fingerprint(pool), "key": key, "order": order, "size": size, "settings": dict(settings or {})}
        stored = files.read_json(self.spark, f"{folder}/manifest.json")
        if stored is None:
            batched = numbered(pool, order, key, name="_n").withColumn("_batch", F.floor(F.col("_n") / size)).drop("_n")
            batched.repartition("_batch").write.mode("overwrite").partitionBy("_batch").parquet(f"{folder}/pool")
            files.write_json(self.spark, f"{folder}/manifest.json", manifest)
        elif stored != json.loads(json.dumps(manifest)):
            changed = sorted(k for k in manifest if stored.get(k) != json.loads(json.dumps(manifest[k])))
            raise ValueError(f"the job in {folder} has other {', '.join(changed)}")
        self.schema = pool.schema
        self.batches = -(-manifest["pool"]["rows"] // size)

    def _path(self, batch: int) -> str:
        return f"{self.folder}/decisions/{batch:08d}"

    def done(self) -> list[int]:
        """The committed batches, in order."""
        return [int(name) for name in files.committed_below(self.spark, f"{self.folder}/decisions")]

    def decisions(self) -> DataFrame | None:
        """The decisions of all committed batches, with ``_batch``; none before the first."""
        done = self.done()
        if not done:
            return None
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/decisions/(\d+)/", 1).cast("int")
        return self.spark.read.parquet(*[self._path(k) for k in done]).withColumn("_batch", at)

    def run(self, validate: Callable[[DataFrame], DataFrame], accepted: Column, source: str, targets: Mapping[str, int] | None = None, most: int = 0) -> dict:
        """Works off open batches in order: at most ``most`` (0: all), and none once every source with a target above 0 has as many accepted rows.

        ``validate`` gives its input's rows with their decisions. The report tells batches, accepted and rejected rows by
        source, and why the run ended; it is stored as progress.json after each batch.
        """
        wanted = {s: n for s, n in (targets or {}).items() if n > 0}
        counts: dict[str, list[int]] = {}

        def counted(k: int) -> None:
            for r in self.spark.read.parquet(self._path(k)).groupBy(F.col(source).alias("s")).agg(F.sum(F.coalesce(accepted, F.lit(False)).cast("long")).alias("a"), F.count(F.lit(1)).alias("n")).collect():
                held = counts.setdefault(str(r.s), [0, 0])
                held[0], held[1] = held[0] + r.a, held[1] + r.n - r.a

        finished = set(self.done())
        for k in finished:
            counted(k)
        waiting = [k for k in reversed(range(self.batches)) if k not in finished]
        met = lambda: bool(wanted) and all(counts.get(s, [0])[0] >= n for s, n in wanted.items())
        ran = 0
        while True:
            why = "completed" if not waiting else "targets" if finished and met() else "stopped" if most and ran >= most else None
            report = {"status": why or "running", "batches": len(finished), "of": self.batches, "sources": {s: {"accepted": a, "rejected": r} for s, (a, r) in sorted(counts.items())}}
            files.write_json(self.spark, f"{self.folder}/progress.json", report)
            if why:
                return report
            open_ = waiting.pop()
            rows = self.spark.read.parquet(f"{self.folder}/pool").where(F.col("_batch") == open_).select(*self.schema.fieldNames())
            validate(rows).write.mode("overwrite").parquet(self._path(open_))
            given, back = (df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(self.key).cast("decimal(38,0)")).alias("h")).first() for df in (rows, self.spark.read.parquet(self._path(open_))))
            if tuple(given) != tuple(back):
                files.discard(self.spark, self._path(open_))
                raise ValueError(f"the validation of batch {open_} gave other rows than it was given")
            counted(open_)
            finished.add(open_)
            ran += 1
