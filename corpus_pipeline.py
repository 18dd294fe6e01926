"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. Rows that repeat doc_id and text in full are one document to every decision and stay or go together.
Rows of one doc_id and different texts are judged apart. Further columns pass unchanged, whatever their names; an empty table
gives an empty one. Pseudonyms follow the key in spark.gaugeleaf.pii.key; without it each driver draws its own, so that two runs, or one
that is started anew, differ in them: set it where that matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm import byte_bpe, decontamination, near_dedup, pii, quality_resampling
from gaugeleaf.llm.common import materialize, packed, table, unpacked


def _those(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text (by hash, among rows of that doc_id) are among rows (doc_id, row)."""
    left = packed(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    right = rows.select(F.col("doc_id").alias("kept_id"), F.col("row").alias("kept_row"))
    return unpacked(left.join(right, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row")), "left_semi"), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects. Null and empty texts have log weight 0 and are drawn like others."""
    return _those(docs, quality_resampling.resample(docs, table(spark, sf_dir, "labels")).where("selected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each near-duplicate group. Texts without words are groups of their own."""
    return _those(docs, near_dedup.near_duplicates(docs).where("kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts have none and stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms. A null text stays null."""
    return pii.private(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the decoded bytes. A null text has no ids."""
    path, pattern = byte_bpe.vocabulary()
    rows = byte_bpe.encode(docs, path, pattern)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(byte_bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private", private),
    ("tokens", tokens),
]

#: SQL can't state a trained model, Gumbel noise by hash or ranked merges: tests hold each stage against plain Python and the
#: last one against the tokenizer's library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
