"""Spans of text: those that no other span of the same text contains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def widest(spans: DataFrame, by: list[str], width: int = 4096) -> DataFrame:
    """spans (by, start, end and others) without those that another one of the same text contains; equal spans contain each other.

    No pairs are made. Spans are counted by start and end, so that equal ones are out, and sorted by start, longer ones first: a span is
    contained if an earlier one ends where it does or later, which a running maximum of ends tells. The maximum runs in stretches of
    `width` positions, to which that of the stretches before is added, so that a long text is no single task.
    """
    others = [c for c in spans.columns if c not in (*by, "start", "end")]
    rows = spans.groupBy(*by, "start", "end").agg(F.count("*").alias("n"), F.first(F.struct(F.lit(0).alias("any"), *others)).alias("rest"))
    rows = rows.withColumn("stretch", F.floor(F.col("start") / width))
    ends = rows.groupBy(*by, "stretch").agg(F.max("end").alias("far"))
    ends = ends.withColumn("far", F.max("far").over(Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    near = F.max("end").over(Window.partitionBy(*by, "stretch").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    left = rows.withColumn("near", near).join(ends.where("far is not null"), [*by, "stretch"], "left")
    kept = left.where((F.col("n") == 1) & (F.coalesce(F.greatest("near", "far") < F.col("end"), F.lit(True))))
    return kept.select(*(F.col(c) if c not in others else F.col("rest")[c].alias(c) for c in spans.columns))
