"""Small files beside tables, on whatever file system a path names: existence, markers, texts written whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    files, there = _at(spark, path)
    return files.exists(there)


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """A file, or the files below a folder, that end with one of the suffixes, by path. A folder that itself bears a suffix is a table."""
    files, there = _at(spark, path)
    if not files.exists(there):
        return []
    if files.getFileStatus(there).isFile() or path.rstrip("/").endswith(suffixes):
        return [path] if path.rstrip("/").endswith(suffixes) else []
    out, found = [], files.listFiles(there, True)
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(suffixes) and not name.rpartition("/")[2].startswith(("_", ".")):
            out.append(name)
    return sorted(out)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written a table there to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def committed_below(spark: SparkSession, path: str) -> list[str]:
    """The names of the tables in a folder that Spark has written to their end, sorted."""
    files, there = _at(spark, path)
    if not files.exists(there):
        return []
    names = [x.getPath().getName() for x in files.listStatus(there) if x.isDirectory()]
    return sorted(n for n in names if committed(spark, f"{path}/{n}"))


def write_json(spark: SparkSession, path: str, value) -> None:
    """Writes a JSON file beside its place and renames it there: readers see the old one or the new one."""
    files, there = _at(spark, path)
    beside = there.suffix(f".{uuid.uuid4().hex}")
    out = files.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    finally:
        out.close()
    if not files.rename(beside, there):  # some file systems do not replace
        files.delete(there, False)
        if not files.rename(beside, there):
            raise OSError(f"cannot write {path}")


def read_json(spark: SparkSession, path: str):
    """The value of a JSON file; none if there is no file."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a file or a table."""
    files, there = _at(spark, path)
    files.delete(there, True)
