"""Groundedness, hallucination, source quality, attribution and accuracy, for all evaluations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.config import Config
from gaugeleaf.functions import providers, scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators import graph, support


def _scored(rows: DataFrame, k: Column, n: Column, settings: Config) -> DataFrame:
    low, high = scoring.wilson(k, n)
    return rows.withColumn("band", scoring.band(F.col("score"), settings)).withColumn("ci_low", low).withColumn("ci_high", high)


def groundedness(labels: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, supported, total, score, band, ci_low, ci_high: the share of triplets that some chunk entails."""
    rows = labels.groupBy("eval_id").agg(F.count_if(F.col("label") == "E").alias("supported"), F.count("*").alias("total"))
    return _scored(rows.withColumn("score", F.col("supported") / F.col("total")), F.col("supported"), F.col("total"), settings)


def citation_exists(citation: Column, retrieved: Column, settings: Config = Config()) -> Column:
    """Links and DOIs go to the resolver, by default one that knows marks of made-up ones; others have to be retrieved."""
    x = t.strip(citation)
    remote = x.startswith("http://") | x.startswith("https://") | x.startswith("10.") | x.startswith("doi:")
    return F.when(remote, resolves(x, settings)).otherwise(retrieved)


def resolves(reference: Column, settings: Config = Config()) -> Column:
    return F.coalesce(providers.provider("resolver", settings.resolver)(reference), F.lit(False))


def fabrication(citations: DataFrame, chunks: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, citation, exists, from (eval_id, citation), once each."""
    ids = chunks.select("eval_id", F.col("chunk_id").alias("id"), F.lit(True).alias("held"))
    rows = citations.where("citation is not null").distinct().withColumn("id", t.strip(F.col("citation"))).join(ids, ["eval_id", "id"], "left")
    return rows.select("eval_id", "citation", citation_exists(F.col("citation"), F.coalesce("held", F.lit(False)), settings).alias("exists"))


def hallucination(labels: DataFrame, cited: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, score, band, the rates and gate_failed: a citation that does not exist makes the band R."""
    gate = cited.groupBy("eval_id").agg(F.bool_or(~F.col("exists")).alias("failed"))
    rows = support.label_rates(labels).join(gate, "eval_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    score = 1 - F.col("e_rate")
    band = F.when(F.col("failed"), "R").otherwise(scoring.band(1 - score, settings))
    return rows.select("eval_id", score.alias("score"), band.alias("band"), F.col("n_rate").alias("neutral_rate"), F.col("c_rate").alias("contradiction_rate"), F.col("failed").cast("double").alias("gate_failed"))


def reliable(domain: Column, settings: Config = Config()) -> Column:
    allowed = c.ALLOWED if settings.allowed is None else settings.allowed
    denied = c.DENIED if settings.denied is None else settings.denied
    return F.when(domain.isNull(), True).when(domain.isin(*denied), False).when(domain.isin(*allowed), True).otherwise(F.lit(not allowed))


def disinterested(domain: Column, author: Column, claim: Column, settings: Config = Config()) -> Column:
    """False by deny list or affiliation, true without domain and author, else null."""
    place = F.lower(F.concat_ws(" ", F.coalesce(domain, F.lit("")), F.coalesce(author, F.lit(""))))
    names = F.regexp_extract_all(claim, F.lit(rf"(^|{t.EDGE})([A-Z][a-zA-Z0-9]+)"), F.lit(2))
    own = F.exists(names, lambda n: (F.length(n) > 2) & F.contains(place, F.lower(n))) if settings.affiliation_rule else F.lit(False)
    nobody = (F.coalesce(domain, F.lit("")) == "") & (F.coalesce(author, F.lit("")) == "")
    domains = c.COI_DOMAINS if settings.coi_domains is None else settings.coi_domains
    authors = c.COI_AUTHORS if settings.coi_authors is None else settings.coi_authors
    denied = F.coalesce(domain.isin(*domains), F.lit(False)) | F.coalesce(author.isin(*authors), F.lit(False))
    return F.when(denied, False).when(own, False).when(nobody, True)


def source_checks(claim: Column, n_docs: Column, supported: Column, settings: Config = Config()) -> list[Column]:
    """The seven properties of a source, from url, domain, date and author."""
    internal = F.col("url").isNull() & F.col("domain").isNull()
    return [
        internal | resolves(F.col("url"), settings), internal | F.coalesce(F.col("date") <= settings.as_of, F.lit(False)), internal | (F.coalesce("author", F.lit("")) != ""),
        reliable(F.col("domain"), settings), n_docs >= settings.corroboration_min, supported,
        F.coalesce(disinterested(F.col("domain"), F.col("author"), claim, settings), sampled_disinterest(claim, settings)),
    ]


def sampled_disinterest(claim: Column, settings: Config = Config()) -> Column:
    """Where rules don't decide: true, but for a share of sources, by a hash of chunk_id, that the judge decides (reads text)."""
    if settings.disinterest_sample_rate <= 0:
        return F.lit(True)
    asked = F.lit("Is this source disinterested (not self-serving)?")
    verdict = providers.provider("judge", settings.judge)(asked, F.concat("text", F.lit("\n[reference] "), claim))
    return F.when(t.hash_bucket(F.col("chunk_id")) < settings.disinterest_sample_rate * 100, verdict).otherwise(True)


def source_score(claim: Column, n_docs: Column, supported: Column, settings: Config = Config()) -> Column:
    total = F.lit(0)
    for check in source_checks(claim, n_docs, supported, settings):
        total = total + check.cast("int")
    return total / 7


def scored_sources(chunks: DataFrame, labels: DataFrame, evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, chunk_ord, chunk_id, source_score, ok: sources judged by support of the whole answer."""
    rows = chunks.join(evals.select("eval_id", "answer"), "eval_id").join(support.answer_support(labels), "eval_id", "left")
    score = source_score(F.col("answer"), F.coalesce("n_docs", F.lit(0)), F.coalesce("supported", F.lit(False)), settings)
    return rows.select("eval_id", "chunk_ord", "chunk_id", score.alias("source_score")).withColumn("ok", F.col("source_score") >= settings.adequacy)


def source_quality(chunks: DataFrame, labels: DataFrame, evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, adequate_sources, total_sources, score, band."""
    rows = scored_sources(chunks, labels, evals, settings).groupBy("eval_id").agg(F.count_if("ok").alias("adequate_sources"), F.count("*").alias("total_sources"))
    rows = rows.withColumn("score", F.col("adequate_sources") / F.col("total_sources"))
    return rows.withColumn("band", scoring.band(F.col("score"), settings))


def cited_sets(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """claims with cited (array) and chunks: explicit ids, else the last explicit ones as far as they support; then the claim's own.

    claims has explicit (array of retrieved ids in the source sentence) and own (a retrieved id or null).
    """
    before = Window.partitionBy("eval_id").orderBy("sent_ord", "clause_ord").rowsBetween(Window.unboundedPreceding, -1)
    scope = F.last(F.when(F.size("explicit") > 0, F.col("explicit")), ignorenulls=True).over(before)
    none = F.array().cast("array<string>")
    rows = claims.withColumn("scope", F.coalesce(scope, none)).join(supports.select("eval_id", "claim_id", "grounded", "confidence", "chunks", "docs"), ["eval_id", "claim_id"], "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", none))
    found = F.when(F.size("explicit") > 0, F.col("explicit")).otherwise(F.array_intersect("scope", "chunks"))
    return rows.withColumn("cited", F.array_union(found, F.when(F.col("own").isNotNull(), F.array("own")).otherwise(none))).drop("scope")


def attribution(sets: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, cited_claims, citation_precision, mis_cited, uncited_supported, excluded_no_citation, band, ci_low, ci_high."""
    cites, holds = F.size("cited") > 0, F.size(F.array_intersect("cited", "chunks")) > 0
    rows = sets.groupBy("eval_id").agg(
        F.count_if(cites).alias("cited_claims"), F.count_if(cites & holds).alias("held"), F.count_if(cites & ~holds).alias("mis_cited"),
        F.count_if(~cites & (F.size("chunks") > 0)).alias("uncited_supported"), F.count_if(~cites).alias("excluded_no_citation"),
    )
    rows = rows.withColumn("score", F.coalesce(F.col("held") / F.nullif("cited_claims", F.lit(0)), F.lit(0.0)))
    return _scored(rows, F.col("held"), F.col("cited_claims"), settings)


def with_explicit(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims with explicit (all ids in brackets in the source sentence that were retrieved) and own (the first, if retrieved)."""
    ids = chunks.select("eval_id", F.col("chunk_id").alias("id"))
    named = claims.select("eval_id", "sent_ord", F.explode(F.regexp_extract_all("source_sentence", F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("id")).distinct()
    found = named.join(ids, ["eval_id", "id"], "left_semi").groupBy("eval_id", "sent_ord").agg(F.array_sort(F.collect_set("id")).alias("explicit"))
    rows = claims.join(found, ["eval_id", "sent_ord"], "left").withColumn("explicit", F.coalesce("explicit", F.array().cast("array<string>")))
    return rows.withColumn("own", F.when(F.array_contains("explicit", F.col("citation")), F.col("citation")))


def source_numbers(chunks: DataFrame) -> DataFrame:
    """eval_id, y: every number of the sources, a row each."""
    return chunks.select("eval_id", F.explode(t.all_numbers(F.col("text"))).alias("y")).distinct()


def local_support(sets: DataFrame, chunks: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, claim_id, entailed: claims that no exported label covers, against all sources of their evaluation together.

    The sources enter token by token and by whether they negate; no text is gathered. Without sources a judge has the word.
    """
    bare = sets.where("grounded is null").select("eval_id", "claim_id", "text").distinct().withColumn("tokens", t.tokens(F.col("text")))
    words = chunks.select("eval_id", F.explode(t.tokens(F.col("text"))).alias("token")).distinct()
    met = bare.select("eval_id", "claim_id", F.explode("tokens").alias("token")).join(words, ["eval_id", "token"], "left_semi").groupBy("eval_id", "claim_id").agg(F.count("*").alias("met"))
    negates = words.where(F.col("token").isin(c.NEGATION)).select("eval_id", F.lit(True).alias("negates")).distinct()
    sourced = chunks.where("text <> ''").select("eval_id", F.lit(True).alias("any")).distinct()
    rows = bare.join(met, ["eval_id", "claim_id"], "left").join(negates, "eval_id", "left").join(sourced, "eval_id", "left").fillna(0, ["met"]).fillna(False, ["negates", "any"])
    raw = F.when(F.size("tokens") == 0, 0.0).otherwise(F.col("met") / F.size("tokens"))
    against = (raw >= settings.contra_tau) & (F.col("negates") != F.arrays_overlap("tokens", F.array(*map(F.lit, c.NEGATION))))
    judged = providers.provider("judge", settings.residual)(F.lit("Is this claim true?"), F.col("text"))
    return rows.select("eval_id", "claim_id", F.when(F.col("any"), ~against & (raw >= settings.entail_tau)).otherwise(judged).alias("entailed"))


def axioms(sets: DataFrame, chunks: DataFrame, gate: float = 0.5, settings: Config = Config(), local: DataFrame | None = None) -> DataFrame:
    """sets with axiom: grounded with matching numbers, from an adequate source if one is cited, and attributed if it cites.

    held, adequate, attributed, number, numeric_ok, sourced and placed show why. A claim's number has to be near some number of
    the sources; these are read only if some claim has one, so the claims' numbers are checkpointed. A claim without an exported label has that of local
    (local_support()); where that is not given either, it counts as held if there are no sources to ask.
    """
    text = ["text"] if settings.disinterest_sample_rate > 0 else []
    places = chunks.select("eval_id", F.col("chunk_id").alias("own"), "url", "domain", "date", "author", *(F.col(x).alias("source_text") for x in text))
    rows = sets.join(places.withColumn("placed", F.lit(True)), ["eval_id", "own"], "left").withColumn("placed", F.coalesce("placed", F.lit(False)))
    rows = rows.join(chunks.where("text <> ''").select("eval_id").distinct().withColumn("sourced", F.lit(True)), "eval_id", "left").withColumn("sourced", F.coalesce("sourced", F.lit(False)))
    judged = rows.withColumn("claim", F.col("text")).withColumn("chunk_id", F.col("own"))
    judged = judged.withColumn("text", F.col("source_text")) if text else judged
    score = source_score(F.col("claim"), F.size(F.coalesce("docs", F.array().cast("array<string>"))), F.size("chunks") > 0, settings)
    rows = judged.withColumn("adequate", F.when(F.col("placed"), score >= settings.adequacy).otherwise(F.lit(True))).withColumn("text", F.col("claim")).drop("claim", "chunk_id", "source_text")
    attributed = F.when(F.size("cited") > 0, (F.size(F.array_intersect("cited", "chunks")) > 0) & (F.coalesce("confidence", F.lit(0.0)) >= gate)).otherwise(F.lit(True))
    rows = rows.withColumn("attributed", attributed).withColumn("number", t.first_number(F.col("text")))
    x, y = F.col("number"), F.col("y")
    asked = graph.shared_checkpoint(sets.select("eval_id", t.first_number(F.col("text")).alias("number")).where("number is not null").distinct())
    if asked.isEmpty():
        rows = rows.withColumn("met", F.lit(None).cast("boolean"))
    else:
        near = F.abs(x - y) <= settings.numeric_tolerance * F.greatest(F.abs(x), F.abs(y))
        met = asked.join(source_numbers(chunks), "eval_id").where(near).select("eval_id", "number", F.lit(True).alias("met")).distinct()
        rows = rows.join(met, ["eval_id", "number"], "left")
    rows = rows.withColumn("numeric_ok", x.isNull() | ~F.col("sourced") | F.coalesce("met", F.lit(False))).drop("met")
    if local is not None:
        rows = rows.join(local.select("eval_id", "claim_id", "entailed"), ["eval_id", "claim_id"], "left").withColumn("grounded", F.coalesce("grounded", "entailed")).drop("entailed")
    rows = rows.withColumn("held", F.coalesce("grounded", ~F.col("sourced")) & F.col("numeric_ok"))
    return rows.withColumn("axiom", F.col("held") & F.col("adequate") & F.col("attributed"))


def accuracy(claims: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, n, successful_claims, score, band, ci: dag_resolution over axiom atoms, one subject for each claim id."""
    atoms = claims.select("eval_id", F.col("claim_id").alias("subject"), F.lit("axiom").alias("role"), F.col("axiom").alias("verdict"), F.lit(1.0).alias("weight"), F.struct("sent_ord", "clause_ord").alias("seq"))
    last = claims.groupBy("eval_id", "claim_id").agg(F.max_by("axiom", F.struct("sent_ord", "clause_ord")).alias("axiom"), F.count("*").alias("times"))
    n = last.groupBy("eval_id").agg(F.sum("times").alias("n"), F.count_if("axiom").alias("successful_claims"))
    rows = scoring.dag_resolution(atoms, ["eval_id"]).join(n, "eval_id")
    return _scored(rows, F.col("successful_claims"), F.col("n"), settings)
