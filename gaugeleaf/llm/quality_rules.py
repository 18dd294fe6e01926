"""Quality rules: counts that fail a text outright, then a length-normalised hashed n-gram log-likelihood ratio.

The ratio compares multinomials of trusted target text and of the whole corpus, averaged over a text's n-grams. The
threshold is the `floor` quantile of trusted documents' scores, of those that the target model has not counted, so the verdict on every document is a fixed
function of the corpus. Base rules: fewer than 20 words, or more than 30 % of words in 8-word windows found twice or more.

Cases: a null or empty text has no words and fails the base rules. Repeated rows get equal rows. Without any trusted row
every score is 0 and only the base rules decide. Other columns are not read. An empty table gives an empty result.

Size: two scans of the texts; all trusted documents are counted, and up to a million of their ids are broadcast. The threshold is
found by histograms over narrow rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import WordHash, chunks, hashed_words, materialize, raw_texts, starts_inside, table, window_hashes
from gaugeleaf.llm.ngram_ratio import held, log_ratio, rows_of, sums, with_target
from gaugeleaf.llm.quality_resampling import quantile

WINDOW, SPACE, SYMBOLS = 8, b" \t\n\v\f\r", b"#*$%&|<>"


def _repeated_words(raw: list[bytes], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its words, and those in windows that the text has twice or more."""
    h, bounds = hashed_words(raw, cache)
    w, inside = window_hashes(h, WINDOW), starts_inside(bounds, WINDOW)
    doc = np.repeat(np.arange(len(raw)), np.diff(bounds))
    hit = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(inside)
    if len(at):
        order = np.lexsort((w[at], doc[at]))
        d, x = doc[at][order], w[at][order]
        same = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
        twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        np.add.at(hit, twice, 1)
        np.add.at(hit, twice + WINDOW, -1)
    covered = np.cumsum(hit)[: len(h)] > 0
    return np.diff(bounds), np.bincount(doc[covered], minlength=len(raw))


def _counts(raw: bytes) -> tuple[int, int, int]:
    solid = raw.translate(None, SPACE)
    seen, again = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line.strip(SPACE):
                again += line in seen
                seen.add(line)
    return len(solid.decode()), len(solid) - len(solid.translate(None, SYMBOLS)), again


def judge(docs: DataFrame, labels: DataFrame, floor: float = 0.005) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score: a row per row of docs."""
    ratio = log_ratio(with_target(docs, labels))

    def count(batches):
        cache, tokens = WordHash(), WordHash()
        for batch in chunks(batches):
            raw = raw_texts(batch)
            n_words, again = _repeated_words(raw, cache)
            total, n = sums(batch, tokens, ratio)
            chars, signs, lines = zip(*map(_counts, raw))
            columns = {"n_words": n_words, "word_chars": chars, "n_symbols": signs, "n_dup_lines": lines, "n_repeat_words": again}
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns.values()), pa.array(total / np.maximum(n, 1), pa.float64())],
                ["doc_id", *columns, "score"],
            )

    rows = materialize(rows_of(docs).mapInArrow(count, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"))
    lowest = quantile(held(rows, labels), "score", floor)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = F.lit(True) if lowest is None else F.col("score") >= lowest
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
