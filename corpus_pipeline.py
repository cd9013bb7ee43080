"""A corpus pipeline: five stages over documents, each one operator of the library.

Each stage takes the documents that the one before it left (as Parquet, read again), and its decisions take effect:
rejected documents go, of linked documents one stays, contaminated documents go, personal data is replaced, and what is
left becomes token ids. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, pieces, pii, quality, setjoin
from lodestone.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or a certified cutoff of the document's language rejects."""
    judged, _ = quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.where("_q_kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, Jaccard at least 0.8) the one with the least doc_id stays.

    Documents without a word are linked with nothing and stay. A null id comes after all others; of one id the text of
    the least MD5 stays, and of repeated rows one. Only ids and digests take part in the choice; the texts are joined
    once, with the chosen.
    """
    marked = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("_n_md5"))
    grouped = setjoin.with_components(marked, width=5, t=80, keep=["doc_id", "_n_md5"]).where("_j_n > 0")
    rows = grouped.groupBy("_j_group", "doc_id", "_n_md5").agg(F.count(F.lit(1)).alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_n_md5").alias("md5"), "rows")).alias("b")
    chosen = materialise(rows.groupBy("_j_group").agg(best).select("b.id", "b.md5", "b.rows"), "chosen")
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = (F.col("_n_md5") == F.col("md5")) & F.col("doc_id").eqNullSafe(F.col("id"))
    kept = marked.where(wordy).join(chosen.where("rows = 1"), same, "left_semi")
    if not chosen.where("rows > 1").isEmpty():  # only repeated rows are brought together with their texts
        kept = kept.unionByName(marked.where(wordy).join(chosen.where("rows > 1"), same, "left_semi").dropDuplicates(["_n_md5", "doc_id"]))
    return kept.unionByName(marked.where(~wordy)).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    judged = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return judged.where("not _b_contaminated").select(*COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind in brackets; overlapping spans are replaced together."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with merge-dropout."""
    encoded = pieces.with_ids(docs.select(*COLUMNS), keep=["doc_id", "lang", "source", "text"])
    return encoded.select("doc_id", "lang", "source", "ids", F.greatest(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("redact_pii", redact_pii),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: Components, boosted trees and merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
