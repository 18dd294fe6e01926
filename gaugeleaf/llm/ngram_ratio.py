"""Hashed n-gram models of trusted target text and of the whole corpus, and the log ratio between them.

Tokens are runs of letters, digits, underscores and non-ASCII bytes, and runs of other signs (A-Z lower-cased). Token
unigrams and bigrams are hashed to `buckets` counters. Counting covers every whole text; each task sends its non-zero
counters only, so what is shuffled is bounded by tasks times buckets, and the driver gets one row a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeleaf.llm.common import LOWER, WordHash, chunks, mixed, raw_texts, texts

BUCKETS = 1 << 15
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id and target of all documents that labels calls good: whether it is in the half that is counted, or in the half that
    thresholds are set by, so that no threshold rests on texts the model has seen as target."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return good.withColumn("target", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a hash of both."""
    return texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def with_target(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """rows_of(docs) with target and held: whether a trusted row is counted, or sets thresholds.

    Beyond `broadcast_rows` trusted ids Spark joins as it sees fit, and the texts are shuffled once where that takes it.
    """
    ids = trusted_ids(labels)
    if ids.limit(broadcast_rows + 1).count() <= broadcast_rows:
        ids = F.broadcast(ids)
    rows = rows_of(docs).join(ids, "doc_id", "left")
    return rows.withColumn("held", F.coalesce(~F.col("target"), F.lit(False))).withColumn("target", F.coalesce("target", F.lit(False)))


def held(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of trusted documents that set thresholds; for narrow rows with doc_id."""
    return rows.join(trusted_ids(labels).where("not target"), "doc_id", "left_semi")


def _ngrams(batch: pa.RecordBatch, cache: WordHash, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a chunk and the document of each."""
    tokens: list[bytes] = []
    bounds = [0]
    for t in raw_texts(batch):
        tokens += _TOKEN.findall(t.translate(LOWER))
        bounds.append(len(tokens))
    h = cache.array(tokens)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = doc[1:] == doc[:-1]
    two = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair]
    return np.concatenate([mixed(h), two]).astype(np.uint64) % np.uint64(buckets), np.concatenate([doc, doc[1:][pair]])


def log_ratio(marked: DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | corpus) by counts over all documents; zeros where there is no target."""

    def count(batches):
        cache, raw, target = WordHash(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in chunks(batches):
            g, doc = _ngrams(batch, cache, buckets)
            g = g.astype(np.int64)
            raw += np.bincount(g, minlength=buckets)
            target += np.bincount(g[batch.column("target").to_numpy(zero_copy_only=False)[doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in rows:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smooth) / (target.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))


def sums(batch: pa.RecordBatch, cache: WordHash, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a chunk: the sum of ratio over its n-grams and how many n-grams it has."""
    g, doc = _ngrams(batch, cache, len(ratio))
    n = batch.num_rows
    return np.bincount(doc, ratio[g.astype(np.int64)], minlength=n), np.bincount(doc, minlength=n)


def scored(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, row, total (summed log ratio) and n_ngrams, a row for each of rows (rows_of)."""

    def score(batches) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in chunks(batches):
            total, n = sums(batch, cache, ratio)
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(total, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "row", "total", "n_ngrams"])

    return rows.mapInArrow(score, "doc_id long, row long, total double, n_ngrams long")
