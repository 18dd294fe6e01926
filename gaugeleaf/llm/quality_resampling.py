"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's log weight is the log likelihood of its n-grams under the target model less that under the model of the
whole corpus. Gumbel noise (a fixed function of seed and doc_id) is added, and the k documents with the largest sums are
selected: a sample without replacement, with chances in proportion to the weights. k is either `keep` times the rows, or,
by default, the number of rows whose log weight reaches the lowest `floor` share of the weights of trusted
documents that the target model has not counted.

Cases: a null or empty text has no n-grams and log weight 0. Rows that tie at the cut are all selected, so repeated rows
share a fate. A null doc_id takes the noise of null. Without any trusted row all weights are 0 and all rows are selected.
Other columns are not read. An empty table gives an empty result.

Size: two scans of the texts, without a shuffle of them. All trusted documents are counted; the k-th largest sum
is found by histograms of 4096 bins over (doc_id, weight) rows, each narrowing to one bin, never by a global sort.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import materialize, table
from gaugeleaf.llm.ngram_ratio import held, log_ratio, rows_of, scored, with_target


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column without nulls; None if there are fewer than k rows or k is 0."""
    x, low_open = F.col(column), values
    while k > 0:
        least, most, n = low_open.agg(F.min(x), F.max(x), F.count("*")).first()
        if n < k:
            return None
        width = (most - least) / bins if n else 0
        if least == most or least + width in (least, most):
            if least == most:
                return least
            rows = low_open.groupBy(x.alias("x")).count().orderBy(F.desc("x")).limit(bins).collect()
        else:
            rows = low_open.groupBy(F.least(F.floor((x - least) / width), F.lit(bins - 1)).alias("x")).count().orderBy(F.desc("x")).collect()
        for value, count in rows:
            if k <= count:
                break
            k -= count
        if least + width in (least, most):
            return value
        low_open = low_open.where(F.least(F.floor((x - least) / width), F.lit(bins - 1)) == value)
    return None


def quantile(values: DataFrame, column: str, share: float) -> float | None:
    """The value at `share` of a column without nulls, between its two neighbours as F.percentile has it, but no task holds all values; None without rows."""
    values = materialize(values.select(column))
    n = values.count()
    at = share * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    below = kth_largest(values, column, n - low) if n else None
    return below if low == high or not n else (high - at) * below + (at - low) * kth_largest(values, column, n - high)


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, floor: float = 0.005, seed: int = 17) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n_ngrams, log_weight, perturbed, selected: one row per row of docs."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = scored(rows_of(docs), log_ratio(with_target(docs, labels))).withColumn("perturbed", F.col("total") - F.log(-F.log(u)))
    rows = materialize(rows)
    if keep is None:
        lowest = quantile(held(rows, labels), "total", floor)
        k = rows.count() if lowest is None else rows.where(F.col("total") >= lowest).count()
    else:
        k = round(keep * rows.count())
    cut = kth_largest(rows.select("perturbed"), "perturbed", k)
    selected = F.lit(False) if cut is None else F.col("perturbed") >= cut
    return rows.select("doc_id", "row", "n_ngrams", F.col("total").alias("log_weight"), "perturbed", selected.alias("selected"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
