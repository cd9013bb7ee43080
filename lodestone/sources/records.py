"""Record sources and sinks: JSON lines, JSON containers and Parquet, with the order of the records kept.

JSON lines are read as text lines with their place in the file, so that limits and "up to the first bad line" have a
meaning whatever the partitions; files of any size are split as Spark splits them.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources import files

CONTAINER_KEYS = ("train", "test", "validation", "data", "examples", "problems")


def placed_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, block, row, value): every line, its place told by (file, block, row).

    Files are split by bytes as Spark splits them, and no file is a row of its own: ``block`` is where the split begins,
    ``row`` grows within it. Reading the same files again with the same settings gives the same numbers.
    """
    text = spark.read.text([paths] if isinstance(paths, str) else list(paths), recursiveFileLookup=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line, value): every line of the files with its number.

    The lines of each split are counted in a scan of their own; the counts, one row for each task of the scan, are
    broadcast, so no line is shuffled.
    """
    lines = placed_lines(spark, path)
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return lines.join(F.broadcast(counts), ["file", "block"]).select("file", (F.col("_before") + F.col("row") - F.col("_first")).alias("line"), "value")


def parsed(lines: DataFrame, schema: T.StructType, mode: str = "strict", place: Sequence[str] = ("line",)) -> DataFrame:
    """Records of JSON lines in order (file, place, columns). Blank lines are skipped.

    ``strict``: a line that is no record is an error; ``prefix``: a file ends at its first line that is no JSON; ``lossy``:
    such lines are skipped. Other JSON than records is left out in both. The first bad places, one row a file at most,
    are broadcast.
    """
    wanted = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    record = F.ltrim("value").startswith("{")
    corrupt = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    at = F.struct(*place)
    if mode == "strict":
        named = F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in place])
        rows = rows.withColumn("r", F.when(corrupt | ~record, F.raise_error(F.concat(F.lit("bad record in "), named, F.lit(" of "), F.col("file")))).otherwise(F.col("r")))
    elif mode in ("prefix", "lossy"):
        bad = F.when(record, corrupt).otherwise(F.try_parse_json("value").isNull())
        if mode == "prefix":
            first = rows.where(bad).groupBy("file").agg(F.min(at).alias("_bad"))
            rows = rows.join(F.broadcast(first), "file", "left").where(F.col("_bad").isNull() | (at < F.col("_bad")))
        rows = rows.where(record & ~bad)
    else:
        raise ValueError(f"mode {mode!r}")
    return rows.select("file", *place, *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def read_json_container(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, placed: bool = False) -> DataFrame:
    """JSON files that are lists of records, or objects whose first list among the usual keys has them, or one record each. ``placed``: with their places (_f, _b, _l)."""
    text = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).select("value", F.col("_metadata.file_path").alias("_f"))
    as_list = F.from_json("value", T.ArrayType(schema))
    within = F.from_json("value", T.StructType([T.StructField(k, T.ArrayType(schema)) for k in CONTAINER_KEYS]))
    single = F.array(F.from_json("value", schema))
    unwrapped = F.when(F.ltrim("value").startswith("["), as_list).otherwise(F.coalesce(*[within[k] for k in CONTAINER_KEYS], single))
    rows = text.select("_f", F.posexplode(F.filter(unwrapped, lambda r: r.isNotNull())).alias("_l", "_r"))
    records = [F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields]
    return rows.select(*records, "_f", F.lit(0).cast("long").alias("_b"), F.col("_l").cast("long").alias("_l")) if placed else rows.select(*records)


SUFFIXES = (".jsonl", ".json", ".parquet")


def _frame(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None, mode: str) -> tuple[DataFrame, list[str]]:
    """Records of files of all suffixes with their places (_f, _b, _l), and the names of their columns."""
    out, columns = None, None
    for suffix in SUFFIXES:
        some = [p for p in paths if p.endswith(suffix)]
        if not some:
            continue
        if suffix == ".jsonl":
            df = parsed(placed_lines(spark, some), _needed(schema), mode, ("block", "row")).withColumnsRenamed({"file": "_f", "block": "_b", "row": "_l"})
        elif suffix == ".json":
            df = read_json_container(spark, some, _needed(schema), placed=True)
        else:
            df = spark.read.parquet(*some)
            df = (df.select(*schema.fieldNames()) if schema else df).select("*", F.col("_metadata.file_path").alias("_f"), F.lit(0).cast("long").alias("_b"), F.col("_metadata.row_index").alias("_l"))
        names = [c for c in df.columns if c not in ("_f", "_b", "_l")]
        columns = columns or names
        out = df if out is None else out.unionByName(df)
    return out, columns


def _enough(spark: SparkSession, paths: list[str], schema: T.StructType | None, mode: str, limit: int) -> list[str]:
    """As many of the first files as have so many records. They are counted by 1, 2, 4... files at a time, without being parsed where every line counts."""
    held, at, step = 0, 0, 1
    while at < len(paths) and held < limit:
        some = paths[at : at + step]
        counts: dict[str, int] = {}
        plain = [p for p in some if p.endswith(".jsonl")] if mode == "strict" else []
        frames = [placed_lines(spark, plain).where(F.trim("value") != "").select(F.col("file").alias("_f"))] if plain else []
        rest = [p for p in some if p not in plain]
        for frame in [*frames, *([_frame(spark, rest, schema, mode)[0]] if rest else [])]:
            counts |= {unquote(r["_f"]).rpartition(":")[2].lstrip("/"): r["count"] for r in frame.groupBy("_f").count().collect()}
        for path in some:
            at += 1
            name = path.rpartition(":")[2].lstrip("/")
            held += sum(n for f, n in counts.items() if f == name or f.startswith(f"{name}/"))
            if held >= limit:
                break
        step *= 2
    return paths[:at]


def load(spark: SparkSession, path: str, schema: T.StructType | None = None, limit: int | None = None, mode: str = "strict", ordered: bool = True) -> DataFrame:
    """Records of a .jsonl, .json or .parquet file, or of all such files below a folder, in order of path and place, at most ``limit`` (0 and none: all).

    With a limit only as many files are read as it needs, in order of their paths; their records are counted first.
    ``ordered`` False leaves out the sort of a reading without a limit. No such file is an error, in mode ``prefix`` an
    empty table.
    """
    paths = files.listed(spark, path, SUFFIXES)
    if not paths:
        if mode == "prefix":
            return spark.createDataFrame([], _needed(schema))
        if "." in path.rpartition("/")[2] and not path.endswith(SUFFIXES) or files.exists(spark, path):
            raise ValueError(f"unsupported file {path}")
        raise FileNotFoundError(path)
    if limit and limit > 0:
        paths = _enough(spark, paths, schema, mode, limit)
    df, columns = _frame(spark, paths, schema, mode)
    if ordered or limit and limit > 0:
        df = df.orderBy("_f", "_b", "_l")
    return capped(df, limit).select(*columns)


def _needed(schema: T.StructType | None) -> T.StructType:
    if schema is None:
        raise ValueError("JSON needs a schema")
    return schema


def capped(df: DataFrame, limit: int | None) -> DataFrame:
    """None and what is not above 0 mean no cap."""
    return df.limit(limit) if limit and limit > 0 else df


def download_count(explicit: int, minimum: int, target: int, buffer: float) -> int:
    return explicit if explicit > 0 else max(minimum, round(target * buffer))


#: What says that a path cannot be read, whatever reads it.
UNREADABLE = (AnalysisException, Py4JJavaError, FileNotFoundError, ValueError)


def first_readable(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The first of the paths that is there, has a known kind and whose columns can be told; the last error if none is."""
    for k, path in enumerate(paths):
        try:
            return load(spark, path, schema)
        except UNREADABLE:
            if k + 1 == len(paths):
                raise
    raise ValueError("no paths")


def splits(frames: dict[str, DataFrame]) -> DataFrame:
    """Several splits as one table with a split column."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no splits")
    return out


def save_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def save_completions(df: DataFrame, path: str, step: str = "step") -> None:
    """Completions of logged steps, by step."""
    df.write.mode("append").partitionBy(step).parquet(path)


def test_report(lines: DataFrame) -> DataFrame:
    """Totals by log file of a test report: records, failures, the failed names, and durations with four places or N/A."""
    schema = T.StructType([T.StructField("nodeid", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("duration", T.DoubleType())])
    rows = parsed(lines, schema, "lossy").withColumn("shown", F.when(F.col("duration").isNull(), "N/A").otherwise(F.format_string("%.4f", "duration")))
    failed = F.when(F.col("outcome") == "failed", F.struct("line", "nodeid", "shown"))
    by = rows.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum((F.col("outcome") == "failed").cast("long")).alias("failed"), F.array_sort(F.collect_list(failed)).alias("_f"))
    return by.select("file", "records", "failed", F.transform("_f", lambda x: F.concat_ws(" ", x["nodeid"], x["shown"])).alias("failures"), (F.col("records") == 0).alias("empty"))
