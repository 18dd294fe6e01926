"""Which chunks support which triplets and claims: one entailment pass whose result three dimensions share.

Triplets meet the chunks of their own evaluation in an equi-join, and a ranked window keeps the k chunks of largest cosine. Chunk
vectors and token sets are made once a chunk, from one list of its words. The built-in entailment is judged where they meet: a chunk's
tokens are cut there to those that some triplet of the evaluation has, so that they need not be shuffled to the kept pairs once more.
Other models see the kept pairs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeleaf.config import Config
from gaugeleaf.functions import providers
from gaugeleaf.functions import text as t

KEY = ["eval_id", "sent_ord", "clause_ord", "trip_ord"]


def doc_key() -> Column:
    return F.coalesce(F.nullif("domain", F.lit("")), F.nullif("url", F.lit("")), F.col("chunk_id"))


def prefilter(triplets: DataFrame, chunks: DataFrame, settings: Config = Config()) -> DataFrame:
    """KEY, claim_id, tokens, chunk_ord, chunk_id, doc, cosine, rank: the k nearest chunks of each triplet. Texts stay out of the ranking."""
    return _nearest(_met(_hypotheses(triplets, settings), _vectors(chunks, settings).drop("words")), settings)


def _hypotheses(triplets: DataFrame, settings: Config) -> DataFrame:
    rows = triplets.select(*KEY, "claim_id", t.slots(F.col("text"), settings.embedding_seed, settings.embedding_dim).alias("slots"), t.tokens(F.col("text")).alias("tokens"))
    return rows.withColumn("slots_length", t.slots_norm(F.col("slots")))


def _vectors(chunks: DataFrame, settings: Config) -> DataFrame:
    rows = chunks.select("eval_id", "chunk_ord", "chunk_id", doc_key().alias("doc"), t.words(F.col("text")).alias("words"))
    counts = t.slot_counts(t.word_slots(F.col("words"), settings.embedding_seed, settings.embedding_dim), settings.embedding_dim)
    return rows.withColumn("counts", counts).withColumn("counts_length", t.norm(F.col("counts")))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    met = left.join(right, "eval_id").withColumn("cosine", t.slots_cosine(F.col("slots"), F.col("slots_length"), F.col("counts"), F.col("counts_length")))
    return met.drop("slots", "slots_length", "counts", "counts_length")


def _nearest(met: DataFrame, settings: Config) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("cosine"), "chunk_ord"))
    return met.withColumn("rank", rank).where(F.col("rank") <= max(1, settings.groundedness_k))


def labelled(triplets: DataFrame, chunks: DataFrame, settings: Config = Config()) -> DataFrame:
    """The kept pairs with label and raw."""
    if settings.entailment == "lexical":
        left = _hypotheses(triplets, settings)
        asked = left.select("eval_id", F.explode_outer("tokens").alias("token")).groupBy("eval_id").agg(F.collect_set("token").alias("asked"))
        right = _vectors(chunks, settings).withColumn("said", t.content(F.col("words"))).drop("words").withColumn("denies", t.negates(F.col("said")))
        right = right.join(asked, "eval_id").withColumn("premise", F.array_intersect("said", "asked")).drop("said", "asked")
        met = _met(left, right).withColumn("e", t.entailment(F.col("premise"), F.col("tokens"), settings.entail_tau, settings.contra_tau, F.col("denies")))
        return _nearest(met.select("*", "e.label", "e.raw").drop("e", "premise", "denies", "tokens"), settings)
    kept = prefilter(triplets, chunks, settings).drop("tokens")
    pairs = kept.join(chunks.select("eval_id", "chunk_ord", F.col("text").alias("premise")), ["eval_id", "chunk_ord"]).join(triplets.select(*KEY, F.col("text").alias("hypothesis")), KEY)
    judged = pairs.withColumn("e", providers.provider("entailment", settings.entailment)(F.col("premise"), F.col("hypothesis"))).drop("hypothesis", "premise")
    return judged.select("*", "e.label", "e.raw").drop("e")


def triplet_labels(triplets: DataFrame, pairs: DataFrame) -> DataFrame:
    """KEY, claim_id, label, confidence, chunks, docs: a triplet without chunks is N at 0."""
    up = pairs.groupBy(*KEY).agg(
        F.bool_or(F.col("label") == "E").alias("e"), F.bool_or(F.col("label") == "C").alias("c"), F.max("raw").alias("confidence"),
        F.collect_set(F.when(F.col("label") == "E", F.col("chunk_id"))).alias("chunks"), F.collect_set(F.when(F.col("label") == "E", F.col("doc"))).alias("docs"),
    )
    rows = triplets.select(*KEY, "claim_id").join(up, KEY, "left")
    none = F.array().cast("array<string>")
    return rows.select(
        *KEY, "claim_id", F.when(F.col("e"), "E").when(F.col("c"), "C").otherwise("N").alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("chunks", none).alias("chunks"), F.coalesce("docs", none).alias("docs"),
    )


def claim_support(labels: DataFrame) -> DataFrame:
    """eval_id, claim_id, grounded, confidence (the largest), confidences (one a triplet, sorted), chunks, docs (sorted unions)."""
    union = lambda n: F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n)
    return labels.groupBy("eval_id", "claim_id").agg(F.bool_and(F.col("label") == "E").alias("grounded"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list("confidence")).alias("confidences"), union("chunks"), union("docs"))


def answer_support(labels: DataFrame) -> DataFrame:
    """eval_id, n_docs, supported: support of the answer as a whole."""
    flat = labels.select("eval_id", F.explode_outer("docs").alias("doc"))
    return flat.groupBy("eval_id").agg(F.count_distinct("doc").alias("n_docs"), (F.count("doc") > 0).alias("supported"))


def label_rates(labels: DataFrame) -> DataFrame:
    """eval_id, total and the rates of E, N and C."""
    rate = lambda x: (F.count_if(F.col("label") == x) / F.count("*")).alias(f"{x.lower()}_rate")
    return labels.groupBy("eval_id").agg(F.count("*").alias("total"), rate("E"), rate("N"), rate("C"))
