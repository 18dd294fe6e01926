"""From answers to sentences, claims and triplets, all evaluations at once. One window by evaluation, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeleaf.config import Config
from gaugeleaf.functions import providers
from gaugeleaf.functions import text as t


def spans(evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, sent_ord, sentence, verifiable, abstractive: every sentence, kept or routed."""
    rows = evals.select("eval_id", F.posexplode(providers.provider("segmenter", settings.segmenter)(F.col("answer"))).alias("sent_ord", "sentence"))
    return rows.withColumn("verifiable", t.is_verifiable(F.col("sentence"))).withColumn("abstractive", t.is_abstractive(F.col("sentence")))


def context_subject(chunks: DataFrame) -> DataFrame:
    """eval_id, subject: the last subject of the chunks, in chunk order. Only subjects are gathered, one a chunk."""
    last = t.last_subject(F.col("text"))
    found = chunks.select("eval_id", "chunk_ord", last.alias("s"))
    return found.groupBy("eval_id").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("chunk_ord"))).alias("subject"))


def claims(evals: DataFrame, chunks: DataFrame | None = None, settings: Config = Config()) -> DataFrame:
    """eval_id, sent_ord, clause_ord, claim_id, text, source_sentence, decontextualized, citation.

    A leading pronoun stands for the last subject of all sentences before, routed ones too, else of the chunks.
    """
    rows = spans(evals, settings).withColumn("own", t.last_subject(F.col("sentence")))
    before = Window.partitionBy("eval_id").orderBy("sent_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("carried", F.last("own", ignorenulls=True).over(before))
    if chunks is not None:
        rows = rows.join(context_subject(chunks), "eval_id", "left").withColumn("carried", F.coalesce("carried", "subject"))
    kept = rows.where(F.col("verifiable") & ~F.col("abstractive"))
    parts = kept.select("eval_id", "sent_ord", "sentence", "carried", F.posexplode(providers.provider("clauses", settings.clause_parser)(F.col("sentence"))).alias("clause_ord", "clause"))
    parts = parts.withColumn("text", providers.provider("coreference", settings.coreference)(F.col("clause"), F.col("carried")))
    return parts.select(
        "eval_id", "sent_ord", "clause_ord", t.short_hash("claim:", F.col("text")).alias("claim_id"), "text", F.col("sentence").alias("source_sentence"),
        (~t.has_leading_pronoun(F.col("text"))).alias("decontextualized"), t.citation(F.col("sentence")).alias("citation"),
    )


def triplets(claims: DataFrame) -> DataFrame:
    """eval_id, sent_ord, clause_ord, trip_ord, triplet_id, claim_id, subject, predicate, obj, text, citation."""
    rows = claims.select("eval_id", "sent_ord", "clause_ord", "claim_id", "citation", F.posexplode(t.triplets(F.col("text"))).alias("trip_ord", "p")).select("*", "p.*").drop("p")
    rows = rows.withColumn("text", F.array_join(F.filter(F.array("subject", "predicate", "obj"), lambda x: x != ""), " "))
    return rows.withColumn("triplet_id", t.short_hash("triplet:", F.concat_ws("|", "claim_id", "text")))


def stability(runs: DataFrame) -> DataFrame:
    """eval_id, stability: ids in all runs over ids in any run, from (eval_id, run, id)."""
    n = runs.groupBy("eval_id").agg(F.count_distinct("run").alias("runs"))
    ids = runs.groupBy("eval_id", "id").agg(F.count_distinct("run").alias("held"))
    joined = ids.join(n, "eval_id").groupBy("eval_id").agg(F.count_if(F.col("held") == F.col("runs")).alias("all"), F.count("*").alias("any"))
    return joined.select("eval_id", (F.col("all") / F.col("any")).alias("stability"))
