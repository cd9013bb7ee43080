"""A Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups' roots, and proofs.

Leaves are numbered within their groups over range partitions. A task reads consecutive leaves and keeps a mountain-range
stack, one short list of digests for each level: when a list reaches the end of a run of ``fanout`` (or of the level),
the run is written out and its digest is carried to the next level. A run that began before the task's first leaf, and
what is left on the stack at the end, are written out as fragments. Fragments are few (at most two runs a level for each
task and group); they are merged by run, level by level, with a grouped aggregation, so no group meets in one task. Short
runs are hashed as they are, without padding; a lone leaf is its own root.

The digest of a node is that of its children's hex digests one after another. Paths are found from the roots down by one
join a level on (group, run), so a proof needs no walk; a path has, for each level, what stands before and after the
node in its run.

Results for odd input: a null group is a group of its own, before all others; a null key comes first; nulls in leaf
columns are written ``-``; repeated rows are leaves each, and as they are equal their order does not matter; rows that share a
key are ordered by their digests; an empty table has no leaves and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, discard, materialise, table
from lodestone.llm.ordinals import indexed

FANOUT = 16
_HEX = 64
_PIECES = "_m_group string, level int, run long, at int, whole boolean, _o_of long, digests string"
_PATH = "array<struct<before:string,after:string>>"


def digest_of(columns: list[Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and the value, a null as ``-``."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Range:
    """The stack of a task: pushes consecutive nodes of a group, level by level, and writes out runs."""

    def __init__(self, fanout: int) -> None:
        self.fanout, self.group, self.next = fanout, None, -1
        self.held: list[list[str]] = []
        self.out: list[tuple] = []

    def begin(self, group: str, at: int, of: int) -> None:
        """Another group or another stretch of it: what is held becomes fragments."""
        self.end()
        self.group, self.of, self.next = group, of, at
        self.sizes = [of]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // self.fanout))
        self.held = [[] for _ in self.sizes]
        self.first = [0] * len(self.sizes)

    def push(self, digest: str) -> None:
        at, self.next = self.next, self.next + 1
        for level, size in enumerate(self.sizes[:-1]):
            held = self.held[level]
            if not held:
                self.first[level] = at
            held.append(digest)
            run, place = divmod(at, self.fanout)
            if place + 1 < self.fanout and at + 1 < size:
                return
            whole = self._write(level)
            if not whole:
                return
            digest, at = hashlib.sha256(whole.encode()).hexdigest(), run

    def _write(self, level: int) -> str:
        """Writes out what a level holds; its digests if they are a whole run."""
        run, place = divmod(self.first[level], self.fanout)
        count = len(self.held[level])
        whole = place == 0 and (count == self.fanout or run * self.fanout + count == self.sizes[level])
        digests = "".join(self.held[level])
        self.held[level] = []
        self.out.append((self.group, level, run, place, whole, self.of, digests))
        return digests if whole else ""

    def end(self) -> None:
        for level, held in enumerate(self.held):
            if held:
                self._write(level)
        self.held, self.group = [], None


def _climb(fanout: int):
    names = [x.split()[0] for x in _PIECES.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]

    def taken(stack: Range) -> pa.RecordBatch:
        rows, stack.out = stack.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Range(fanout)
        for batch in batches:
            for group, at, of, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != stack.group or at != stack.next:
                    stack.begin(group, at, of)
                stack.push(digest)
            if stack.out:
                yield taken(stack)
        stack.end()
        if stack.out:
            yield taken(stack)

    return each


@dataclass
class Forest:
    """A tree for each group. ``leaves``: the given columns with ``_o_at`` and ``_o_of``; ``runs``: group, level, run, digests; ``roots``: group, size and root."""

    leaves: DataFrame
    runs: DataFrame
    roots: DataFrame
    levels: int
    fanout: int


def forest(leaves: DataFrame, order: list[str], digest: str = "leaf", fanout: int = FANOUT) -> Forest:
    """Trees over stored rows with a non-null ``_m_group``, leaves by ``order``."""
    numbered = indexed(leaves, "_m_group", order, "merkle-leaves")
    pieces = materialise(numbered.select("_m_group", "_o_at", "_o_of", digest).mapInArrow(_climb(fanout), _PIECES), "merkle-pieces")
    most = numbered.agg(F.max("_o_of")).first()[0] or 0
    levels = 0
    while fanout**levels < most:
        levels += 1
    names = ("_m_group", "level", "run", "_o_of", "digests")
    runs = pieces.where("whole").select(*names)
    made = None
    for level in range(levels):  # only fragments: their number goes by tasks, not by leaves
        parts = pieces.where(f"not whole and level = {level}").drop("whole", "level")
        parts = parts if made is None else parts.unionByName(made)
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "digests"))), lambda x: x.digests)
        merged = materialise(parts.groupBy("_m_group", "run", "_o_of").agg(F.array_join(ordered, "").alias("digests")).select("_m_group", F.lit(level).alias("level"), "run", "_o_of", "digests"), "merkle-merged")
        above = merged.where(F.col("_o_of") > fanout ** (level + 1))
        made = above.select("_m_group", F.expr(f"run div {fanout}").alias("run"), F.expr(f"cast(run % {fanout} as int)").alias("at"), "_o_of", F.sha2("digests", 256).alias("digests"))
        runs = runs.unionByName(merged)
    top = F.lit(False)
    for level in range(levels):
        top = top | ((F.col("level") == level) & (F.col("_o_of") > fanout**level) & (F.col("_o_of") <= fanout ** (level + 1)))
    lone = numbered.where("_o_of = 1").select("_m_group", "_o_of", F.col(digest).alias("root"))
    roots = runs.where(top).select("_m_group", "_o_of", F.sha2("digests", 256).alias("root")).unionByName(lone)
    return Forest(numbered, runs, roots, levels, fanout)


def paths(trees: Forest, above: DataFrame) -> DataFrame:
    """The leaves with ``_m_path`` and the columns of ``above``: one row a group with ``_m_group``, ``_o_of``, ``_m_path`` and others to hand on."""
    f = trees.fanout
    others = [c for c in above.columns if c not in ("_m_group", "_o_of", "_m_path")]
    nodes = None
    out = trees.leaves.where("_o_of = 1").join(above.drop("_o_of"), "_m_group")

    def step(place: Column) -> Column:
        before, after = F.substring("digests", F.lit(1), place * _HEX), F.substring("digests", (place + 1) * _HEX + 1, F.lit(f * _HEX))
        return F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), F.col("_m_path"))

    for level in reversed(range(trees.levels)):
        tops = above.where((F.col("_o_of") > f**level) & (F.col("_o_of") <= f ** (level + 1))).select("_m_group", F.lit(0).cast("long").alias("run"), "_m_path", *others)
        uppers = tops if nodes is None else nodes.unionByName(tops)
        here = trees.runs.where(f"level = {level}").select("_m_group", "run", "digests").join(uppers, ["_m_group", "run"])
        if level:
            each = F.explode(F.sequence(F.lit(0), (F.length("digests") / _HEX).cast("int") - 1))
            nodes = here.withColumn("place", each).select("_m_group", (F.col("run") * f + F.col("place")).alias("run"), step(F.col("place")).alias("_m_path"), *others)
        else:
            kept = trees.leaves.where("_o_of > 1").withColumn("run", F.expr(f"_o_at div {f}"))
            met = kept.join(here, ["_m_group", "run"])
            out = out.unionByName(met.withColumn("_m_path", step((F.col("_o_at") % f).cast("int"))).drop("run", "digests"))
    return out


@dataclass
class Manifest:
    """``groups``: a tree for each group; ``whole``: the tree over their roots; ``root``: its root (None for an empty table)."""

    groups: Forest
    whole: Forest
    root: str | None


def manifest(leaves: DataFrame, group: str, key: str, fanout: int = FANOUT) -> Manifest:
    """The manifest of rows with a ``leaf`` digest; other columns of ``leaves`` stay with the leaves."""
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # a null before all, names by their bytes
    kept = materialise(leaves.withColumn("_m_group", named), "merkle-rows")
    trees = forest(kept, [f"`{key}`", "leaf"], fanout=fanout)
    roots = materialise(trees.roots.select(F.lit("").alias("_m_group"), F.col("_m_group").alias("name"), F.col("_o_of").alias("size"), F.col("root").alias("leaf")), "merkle-roots")
    over = forest(roots, ["name"], fanout=fanout)
    discard(kept)
    first = over.roots.first()
    return Manifest(trees, over, first.root if first else None)


def with_proofs(made: Manifest) -> DataFrame:
    """The leaves with ``_m_subroot``, ``_m_root`` and ``_m_path``, the siblings from the leaf's run up to the root's."""
    root = F.lit(made.root)
    start = made.whole.roots.select("_m_group", "_o_of", F.array().cast(_PATH).alias("_m_path"))
    groups = paths(made.whole, start).select(F.col("name").alias("_m_group"), F.col("size").alias("_o_of"), F.col("leaf").alias("_m_subroot"), "_m_path")
    return paths(made.groups, groups).withColumn("_m_root", root)


def proof(path: Column) -> Column:
    """The siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x.before, x.after)), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda held, x: F.sha2(F.concat(x.before, held, x.after), 256))


#: What the query's leaves hash, and which rows it tampers with.
_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_TAMPERED = 5


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *_COLUMNS)
    columns = [F.col(c) for c in _COLUMNS]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % _TAMPERED == 0, digest_of([*columns[:-1], ascii_lower(F.col("text"))]))
    made = manifest(docs.select("doc_id", "source", digest_of(columns).alias("leaf"), altered.alias("tampered")), "source", "doc_id")
    refolded = folded(F.col("_m_path"), F.coalesce("tampered", "leaf"))
    out = with_proofs(made).select("doc_id", "leaf", F.col("_m_subroot").alias("subroot"), F.col("_m_root").alias("root"), F.sha2(proof(F.col("_m_path")), 256).alias("proof_sha256"), refolded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
