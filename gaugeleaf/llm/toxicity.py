"""Toxicity: embeddings of hashed character n-grams, averaged over a text into a linear softmax, trained jointly in numpy.

A text is its bag of 3- to 5-byte grams inside its distinct words, with a blank at a word's edge; A-Z are lower-cased. Each
gram has an embedding (by hash), a text is the mean of its grams' embeddings (with `PAD` zeros, so that a few grams alone
say little), and a linear softmax of two classes reads that mean. Repeating a passage does not change a score. A
misspelt word shares most grams with the word. Embeddings and softmax are trained together by AdaGrad.

Cases: an empty or null text, or one without grams, has the mean zero and so the score of the bias alone. Repeated rows
get equal scores. Rows of labels with a null toxic teach nothing; without rows of both classes every score is 0.5 by an
untrained model. A null doc_id is not held out. Other columns are not read. An empty table gives an empty result.

Size: training takes `most` labelled rows at most, half of each class where there are enough, chosen by hash; scoring is one
scan of the texts without a shuffle, and the model is one array of 2**20 floats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import LOWER, chunks, materialize, raw_texts, table, texts

BITS, SIZES, FOLDS, PAD = 20, (3, 4, 5), 5, 64
_MULT = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n) for n in SIZES}


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all grams of some texts, and the text of each."""
    bags = [b" ".join(dict.fromkeys(t.translate(LOWER).split())) for t in raw]
    x = np.frombuffer(b" " + b" ".join(bags) + b" ", np.uint8)
    doc = np.repeat(np.arange(len(bags)), [len(t) + 1 for t in bags])
    blank = x == 32
    wide, found, which = x.astype(np.uint64), [], []
    for n in SIZES:
        m = len(x) - n + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)
        key = np.zeros(m, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | wide[k : k + m]
            if 0 < k < n - 1:
                inner |= blank[k : k + m]
        at = np.flatnonzero(~inner)
        found.append((((key[at] + np.uint64(n)) * _MULT[n]) >> np.uint64(64 - BITS)).astype(np.int32))
        which.append(doc[np.minimum(at, len(doc) - 1)])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(which)


def train(raw: list[bytes], toxic: np.ndarray, dim: int = 2, epochs: int = 8, rate: float = 0.5, least: int = 4, seed: int = 5) -> tuple[np.ndarray, float]:
    """For each bucket, what a gram adds to the mean that the softmax reads (class 1 less class 0), and the bias.

    Grams of fewer than `least` training texts keep the embedding zero: they could only be learnt by heart.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    if len(set(toxic.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    bags = []
    for t in raw:
        ids, count = np.unique(grams([t])[0], return_counts=True)
        bags.append((ids.astype(np.int32), (count / (PAD + count.sum())).astype(np.float32)))
    known = np.bincount(np.concatenate([b[0] for b in bags]), minlength=1 << BITS) >= least
    emb[~known] = 0
    seen = np.full(emb.shape, 1e-8, np.float32)
    seen_out, seen_bias = np.full(out.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    scale = np.float32(np.sqrt(np.mean([len(b[0]) for b in bags])))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), 32):
            part = order[a : a + 32]
            ids = np.concatenate([bags[i][0] for i in part])
            weight = np.concatenate([bags[i][1] for i in part]) * scale
            row = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
            picked = emb[ids] * weight[:, None]
            mean = np.stack([np.bincount(row, picked[:, d], minlength=len(part)) for d in range(dim)], axis=1).astype(np.float32)
            logit = mean @ out + bias
            prob = np.exp(logit - logit.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            err = prob
            err[np.arange(len(part)), toxic[part]] -= 1
            err /= len(part)
            back = err @ out.T
            used, spot = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(spot, weight * back[row, d], minlength=len(used)) for d in range(dim)], axis=1).astype(np.float32)
            step *= known[used, None]
            for value, grad, past in ((out, mean.T @ err, seen_out), (bias, err.sum(axis=0), seen_bias)):
                past += grad**2
                value -= rate * grad / np.sqrt(past)
            seen[used] += step**2
            emb[used] -= rate * 0.2 * step / np.sqrt(seen[used])
    return (scale * (emb @ (out[:, 1] - out[:, 0]))).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, most: int = 5_000, most_bytes: int = 64 << 20) -> tuple[np.ndarray, float]:
    """Train on rows outside the held-out fold only: whole texts in an order by hash, `most` of them and `most_bytes` bytes at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(most // 2).unionByName(known.where("toxic = 0").orderBy(*order).limit(most // 2))
    rows = texts(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))))
    sizes = rows.select("doc_id", "toxic", "size").orderBy(*order).collect()
    held, ids = {0: 0, 1: 0}, []
    for r in sizes:
        if held[r.toxic] + r.size <= most_bytes // 2:  # a text that doesn't fit is left out alone
            held[r.toxic] += r.size
            ids.append(r.doc_id)
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    taught = sorted(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect(), key=lambda r: r.doc_id)
    return train([(r.text or "").encode() for r in taught], np.array([r.toxic for r in taught], np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score, a row for each row of docs."""
    weights, bias = model

    def read(batches):
        for batch in chunks(batches, 2 << 20):
            ids, doc = grams(raw_texts(batch))
            n = batch.num_rows
            mean = np.bincount(doc, weights[ids], minlength=n) / (PAD + np.bincount(doc, minlength=n))
            yield pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(mean + bias, -60, 60))), pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(read, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
