"""Models and thresholds by all trusted documents, however many; words of a block by parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeleaf.llm import common, ngram_ratio, quality_resampling


def test_all_trusted_documents_count(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    docs = labels.select("doc_id", F.lit("a b").alias("text"))
    for bound in (1_000_000, 10):  # with a broadcast and without
        n = ngram_ratio.with_target(docs, labels, broadcast_rows=bound).agg(F.count_if("target"), F.count_if("held"), F.count("*")).first()
        assert n[0] + n[1] == 30_000 == n[2] and min(n[0], n[1]) > 14_000


def test_quantile_as_percentile(spark):
    values = [0.5, -1.25, 3.0, 3.0, 7.5, 2.0, 11.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for share in (0.0, 0.005, 0.5, 0.77, 1.0):
        assert quality_resampling.quantile(df, "x", share) == pytest.approx(np.percentile(values, 100 * share))
    assert quality_resampling.quantile(df.limit(0), "x", 0.5) is None


def test_words_by_parts_are_the_same():
    raw = [b"a b  c", b"", b"d e", b"f"]
    whole, parts = common.hashed_words(raw, common.WordHash()), common.hashed_words(raw, common.WordHash(), at_once=2)
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(whole, parts)) and common.hashed_words([], common.WordHash())[0].dtype == np.uint64
