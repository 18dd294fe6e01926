"""Atoms and result rows of the eight dimensions, for all evaluations at once.

A dimension first emits its atoms, one DataFrame of log rows; a result row then has the score that its formula gives for the
atoms it names, so that replay from the log gives the same number. Every evaluation has a row in every dimension: one
without atoms has n 0, the formula's value for none, and abstains where the dimension says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeleaf.config import Config
from gaugeleaf.functions import providers, scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators import atoms as log
from gaugeleaf.operators import dimensions as dim
from gaugeleaf.operators import graph, tasks

#: The order of dimensions in reports.
ORDER = ("accuracy", "completeness", "relevance", "task_success", "groundedness", "hallucination", "source_quality", "source_attribution")
RESULT = ("eval_id", "dimension", "score", "band", "ci_low", "ci_high", "n", "inputs_hash", "atom_ids", "formula_id", "abstained", "extra", "assurance_mode")
CLAIM_ORDER = ("sent_ord", "clause_ord")


def place(*order: str | Column) -> Column:
    """The place of a row among its evaluation's, from 0."""
    return F.row_number().over(Window.partitionBy("eval_id").orderBy(*order)) - 1


def listed(ids: Column) -> Column:
    """An array of texts as the log's evidence spells it."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def hashed(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("||", *parts).cast("binary"), 256), 1, 16)


def text_hashes(chunks: DataFrame) -> DataFrame:
    """eval_id, sources: a hash of the ordered hashes of an evaluation's chunks; no text is gathered."""
    one = F.struct("chunk_ord", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    rows = chunks.select("eval_id", one.alias("x")).groupBy("eval_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("eval_id", F.sha2(F.array_join(F.transform("xs", lambda x: x["h"]), "").cast("binary"), 256).alias("sources"))


def result(dimension: str, evals: DataFrame, atoms: DataFrame, formula_id: str | Column, facts: DataFrame, settings: Config, extra: dict[str, str], interval: bool = True, band: Column | None = None) -> DataFrame:
    """RESULT rows from the atoms that count, which their dimension has checkpointed: ids, scores and the log read them. facts: eval_id, n, k (successes), abstained, inputs_hash, the columns of extra and at will mode.

    extra names columns of facts, left out where null. Without interval it is all of 0 to 1. band may read score.
    """
    formula = formula_id if isinstance(formula_id, Column) else F.lit(formula_id)
    ids = atoms.groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct("seq", "atom_id"))).alias("ids"))
    facts = facts.withColumn("formula_id", formula)
    scored = scoring.by_formula(atoms.join(facts.select("eval_id", "formula_id"), "eval_id"), ["eval_id", "formula_id"]).drop("formula_id")
    rows = evals.select("eval_id").join(facts, "eval_id").join(ids, "eval_id", "left").join(scored, "eval_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    low, high = scoring.wilson(F.col("k"), F.col("n")) if interval else (F.lit(0.0), F.lit(1.0))
    free = F.coalesce("free", F.lit(False)) if "free" in facts.columns else F.lit(False)
    values = F.map_filter(F.create_map(*(x for name, column in extra.items() for x in (F.lit(name), F.col(column).cast("double")))), lambda _, v: v.isNotNull())
    return rows.select(
        "eval_id", F.lit(dimension).alias("dimension"), "score", (scoring.band(F.col("score"), settings) if band is None else band).alias("band"),
        F.when(free, 0.0).otherwise(low).alias("ci_low"), F.when(free, 1.0).otherwise(high).alias("ci_high"), F.col("n").cast("long").alias("n"), "inputs_hash",
        F.coalesce(F.transform("ids", lambda x: x["atom_id"]), F.array().cast("array<string>")).alias("atom_ids"), "formula_id", "abstained", values.alias("extra"),
        (F.col("mode") if "mode" in facts.columns else F.lit(None).cast("string")).alias("assurance_mode"),
    )


def _counted(evals: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each evaluation, with zeros where counts has none."""
    return evals.select("eval_id", "question", "answer").join(counts, "eval_id", "left").fillna(0).fillna(False)


def triplet_atoms(labels: DataFrame, trips: DataFrame, settings: Config) -> DataFrame:
    model, version = providers.stamp("entailment", settings.entailment)
    rows = labels.join(trips.select("eval_id", *CLAIM_ORDER, "trip_ord", "triplet_id"), ["eval_id", *CLAIM_ORDER, "trip_ord"]).withColumn("seq", place(*CLAIM_ORDER, "trip_ord"))
    evidence = F.concat(F.lit("label="), "label", F.lit(" score="), F.format_string("%.4f", "confidence"), F.lit(" S="), listed(F.col("chunks")))
    return log.emit(
        rows, "groundedness", "triplet_grounded", F.size("chunks") > 0, F.col("seq"), F.col("triplet_id"), "T2", question="supported by any retrieved chunk?", evidence=evidence,
        grader_id="groundedness.triplet", model=model, model_version=version, seed=settings.judge_seed,
    )


def grounded_atoms(supports: DataFrame, settings: Config) -> DataFrame:
    """One atom a claim id: whether all its triplets are entailed. Other dimensions import these."""
    model, version = providers.stamp("entailment", settings.entailment)
    rows = supports.withColumn("seq", place("claim_id"))
    return log.emit(rows, "groundedness", "grounded", F.col("grounded"), F.col("seq") + (1 << 20), F.col("claim_id"), "T2", question="all triplets entailed?",
                    evidence=F.concat(F.lit("n_triplets="), F.size("confidences")), grader_id="groundedness.claim", model=model, model_version=version, seed=settings.judge_seed)


def groundedness(evals: DataFrame, labels: DataFrame, trips: DataFrame, chunks: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame]:
    """Triplet atoms, and results: the share of triplets that some chunk entails."""
    atoms = graph.shared_checkpoint(triplet_atoms(labels, trips, settings))
    n = labels.groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if(F.size("chunks") > 0).alias("k"))
    facts = _counted(evals, n).join(text_hashes(chunks), "eval_id", "left").select("eval_id", "n", "k", (F.col("n") == 0).alias("abstained"), hashed(F.coalesce("sources", F.lit(""))).alias("inputs_hash"))
    return atoms, result("groundedness", evals, atoms, "mean", facts, settings, {"supported": "k", "total": "n"})


def fabrication_atoms(cited: DataFrame, settings: Config) -> DataFrame:
    rows = cited.withColumn("seq", place("citation"))
    return log.emit(rows, "hallucination", "fabrication", F.col("exists"), F.col("seq"), F.concat(F.lit("citation:"), "citation"), "T1", question="citation exists?",
                    evidence=F.concat(F.lit("citation='"), "citation", F.lit("'")), grader_id="hallucination.fabrication")


def hallucination(evals: DataFrame, labels: DataFrame, triplets: DataFrame, cited: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame]:
    """Citation atoms, and results over the triplet atoms that groundedness logged; a citation that does not exist makes the band R."""
    gate = cited.groupBy("eval_id").agg(F.bool_or(~F.col("exists")).alias("failed"))
    rates = labels.groupBy("eval_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == x).alias(f"n_{x}") for x in "ENC"))
    rows = _counted(evals, rates.join(gate, "eval_id", "full"))
    share = lambda x: F.coalesce(F.col(x) / F.nullif("n", F.lit(0)), F.lit(0.0))
    facts = rows.select("eval_id", "n", F.col("n_E").alias("k"), (F.col("n") == 0).alias("abstained"), hashed(F.col("answer")).alias("inputs_hash"), F.when(F.col("n") == 0, 0.0).otherwise(1 - share("n_E")).alias("rate"),
                        share("n_N").alias("neutral"), share("n_C").alias("contradiction"), F.col("failed").cast("double").alias("gate"))
    band = F.when(F.col("gate") == 1, "R").otherwise(scoring.band(1 - F.col("score"), settings))
    extra = {"unsupported_rate": "rate", "neutral_rate": "neutral", "contradiction_rate": "contradiction", "gate_failed": "gate"}
    return fabrication_atoms(cited, settings), result("hallucination", evals, triplets, "unsupported_rate", facts, settings, extra, interval=False, band=band)


def source_quality(evals: DataFrame, chunks: DataFrame, labels: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame]:
    """One atom a source: whether the mean of its seven properties is enough."""
    rows = dim.scored_sources(chunks, labels, evals, settings).withColumn("seq", place("chunk_ord"))
    atoms = log.emit(rows, "source_quality", "source_adequate", F.col("ok"), F.col("seq"), F.concat(F.lit("source:"), "chunk_id"), "T1", question="source adequate (score >= threshold)?",
                     evidence=F.concat(F.lit("score="), F.format_string("%.4f", "source_score")), grader_id="source_quality.adequate")
    atoms = graph.shared_checkpoint(atoms)
    n = rows.groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    facts = _counted(evals, n).select("eval_id", "n", "k", (F.col("n") == 0).alias("abstained"), hashed(F.col("answer")).alias("inputs_hash"))
    return atoms, result("source_quality", evals, atoms, "mean", facts, settings, {"adequate_sources": "k", "total_sources": "n"}, interval=False)


def source_attribution(evals: DataFrame, sets: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame]:
    """One atom a claim that cites: whether some source it cites supports it."""
    rows = sets.withColumn("both", F.array_intersect("cited", "chunks")).withColumn("tag", F.when((F.size("explicit") > 0) | F.col("own").isNotNull(), "explicit").otherwise("implicit-confirmed"))
    cites = rows.where(F.size("cited") > 0).withColumn("seq", place(*CLAIM_ORDER))
    evidence = F.concat(F.lit("tag="), "tag", F.lit(" C="), listed(F.col("cited")), F.lit(" S∩C="), listed(F.col("both")))
    atoms = log.emit(cites, "source_attribution", "citation_attributable", F.size("both") > 0, F.col("seq"), F.concat(F.lit("cite:"), "claim_id"), "T1",
                     question="cited set intersects support set (C∩S≠∅)?", evidence=evidence, grader_id="source_attribution.cite")
    atoms = graph.shared_checkpoint(atoms)
    n = rows.groupBy("eval_id").agg(
        F.count_if(F.size("cited") > 0).alias("n"), F.count_if(F.size("both") > 0).alias("k"), F.count_if((F.size("cited") > 0) & (F.size("both") == 0)).alias("mis"),
        F.count_if((F.size("cited") == 0) & (F.size("chunks") > 0)).alias("unused"), F.count_if(F.size("cited") == 0).alias("none"),
    )
    rows = _counted(evals, n).withColumn("share", F.coalesce(F.col("k") / F.nullif("n", F.lit(0)), F.lit(0.0)))
    facts = rows.select("eval_id", "n", "k", (F.col("n") == 0).alias("abstained"), hashed(F.col("answer")).alias("inputs_hash"), "share", "mis", "unused", "none")
    extra = {"citation_precision": "share", "citation_recall": "share", "cited_claims": "n", "mis_cited": "mis", "uncited_supported": "unused", "excluded_no_citation": "none"}
    return atoms, result("source_attribution", evals, atoms, "mean", facts, settings, extra)


def accuracy(evals: DataFrame, judged: DataFrame, links: DataFrame | None, settings: Config) -> tuple[DataFrame, DataFrame]:
    """Component and axiom atoms of every claim, derived atoms of rescued ones. judged: dim.axioms(); links: eval_id, src, dst."""
    rows = judged.withColumn("seq", 8 * place(*CLAIM_ORDER))
    shown = lambda c: F.when(F.col(c), "True").otherwise("False")
    part = lambda df, role, verdict, k, tier, question, evidence, grader: log.emit(df, "accuracy", role, verdict, F.col("seq") + k, F.col("claim_id"), tier, question=question, evidence=evidence, grader_id=f"accuracy.{grader}")
    parts = [
        part(rows.where("number is not null and sourced"), "numeric", F.col("numeric_ok"), 0, "T1", "numeric exact-match", f"tol={settings.numeric_tolerance}", "numeric"),
        part(rows, "grounded", F.col("held"), 1, "T2", "all triplets entailed?", "", "grounded"),
        part(rows, "source_adequate", F.col("adequate"), 2, "T1", "source adequate?", F.when(F.col("placed"), "provider").otherwise("default"), "source_quality"),
        part(rows, "attributed", F.col("attributed"), 3, "T2", "attributed?", F.when(F.size("cited") > 0, F.concat(F.lit("C="), listed(F.col("cited")))).otherwise("no citation (excluded)"), "attributed"),
        part(rows, "axiom", F.col("axiom"), 4, "code", "grounded ∧ source-adequate ∧ attributed?", F.concat(F.lit("grounded="), shown("held"), F.lit(" adequate="), shown("adequate"), F.lit(" attributed="), shown("attributed")), "axiom"),
    ]
    last = rows.groupBy("eval_id", F.col("claim_id").alias("node")).agg(F.max_by("axiom", F.struct(*CLAIM_ORDER)).alias("axiom"), F.count("*").alias("times"), F.max("seq").alias("seq"))
    derived = None
    if settings.dag_rescue and links is not None:
        state = graph.rescue(last.select("eval_id", "node", "axiom"), links).where("resolved and not axiom").select("eval_id", "node")
        derived = last.join(state, ["eval_id", "node"]).withColumnRenamed("node", "claim_id")
        above = links.groupBy("eval_id", F.col("dst").alias("claim_id")).agg(F.collect_set("src").alias("parents"))
        derived = derived.join(above, ["eval_id", "claim_id"])
        parts.append(part(derived, "derived", F.lit(True), 5, "code", "sub-DAG resolves to true axioms via valid steps?", F.concat(F.lit("parents="), listed(F.col("parents")), F.lit(" all-true")), "derived"))
    atoms = graph.shared_checkpoint(log.union(*parts))
    n = rows.groupBy("eval_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "claim_id"))), lambda x: x["claim_id"]), "|").alias("ids"))
    k = last.groupBy("eval_id").agg(F.count_if("axiom").alias("axioms"))
    more = derived.groupBy("eval_id").agg(F.sum("times").alias("rescued")) if derived is not None else k.select("eval_id", F.lit(0).alias("rescued"))
    rows = _counted(evals, n.join(k, "eval_id", "left").join(more, "eval_id", "left")).withColumn("k", F.col("axioms") + F.col("rescued"))
    ratio = F.coalesce(F.col("axioms") / F.nullif("k", F.lit(0)), F.lit(0.0))
    facts = rows.select("eval_id", "n", "k", (F.col("n") == 0).alias("abstained"), hashed(F.col("answer"), F.coalesce("ids", F.lit(""))).alias("inputs_hash"), ratio.alias("ratio"))
    return atoms, result("accuracy", evals, atoms, "dag_resolution", facts, settings, {"successful_claims": "k", "axiom_derived_ratio": "ratio"})


def completeness(evals: DataFrame, reqs: DataFrame, gate: DataFrame, frozen: DataFrame, chunks: DataFrame, miss: DataFrame | None, settings: Config) -> tuple[DataFrame, DataFrame]:
    """Gate atoms, one provenance atom an evaluation and one support atom a unit; results over the vital units."""
    model, version = providers.stamp("entailment", settings.entailment)
    gate = gate.withColumn("seq", place(*tasks.UNIT_ORDER))
    admitted = log.emit(gate, "completeness", "admissible", F.col("admitted"), F.col("seq"), F.col("unit_id"), "T2", question="admissibility gate", grader_id="completeness.admissibility")
    units = frozen.withColumn("seq", (1 << 20) + place("ord"))
    weight = F.when(F.col("vital") & F.lit(settings.vital_weighting), 2.0).otherwise(1.0)
    support = log.emit(units.withColumn("w", weight), "completeness", "unit_support", F.col("supported"), F.col("seq"), F.col("unit_id"), "T2", weight=F.col("w"), question="supported by the source?",
                       grader_id="completeness.assign", model=model, model_version=version, seed=settings.judge_seed)
    support = graph.shared_checkpoint(support)
    vital = support.join(units.where("vital").select("eval_id", "seq"), ["eval_id", "seq"], "left_semi")
    n = frozen.groupBy("eval_id").agg(F.count_if("vital").alias("n"), F.count("*").alias("total"), F.count_if(F.col("vital") & F.col("supported")).alias("k"))
    rows = _counted(evals, n).join(tasks.coverage(reqs, frozen, settings), "eval_id", "left").join(text_hashes(chunks), "eval_id", "left").withColumn("corpus", hashed(F.coalesce("sources", F.lit("")), F.lit("")))
    version_ = F.concat(F.lit(f"reference_mode={settings.reference_mode} corpus_hash="), "corpus", F.lit(" n_units="), "total")
    provenance = log.emit(rows, "completeness", "frozen_set", F.lit(True), F.lit(1 << 30), F.lit("frozen_set"), "T1", question="frozen unit set", evidence=version_, grader_id="completeness.frozen_set")
    rows = rows.join(miss, "eval_id", "left") if miss is not None else rows.withColumn("miss_rate", F.lit(None).cast("double"))
    facts = rows.select("eval_id", "n", "k", "total", scoring.should_abstain(F.col("n"), settings).alias("abstained"), hashed(F.coalesce("sources", F.lit("")), F.col("answer")).alias("inputs_hash"),
                        "requirement_coverage", "weighted_recall", "miss_rate", F.lit(settings.reference_mode).alias("mode"))
    extra = {"requirement_coverage": "requirement_coverage", "weighted_recall": "weighted_recall", "vital_units": "n", "total_units": "total", "recall_miss_rate": "miss_rate"}
    return log.union(admitted, provenance, support), result("completeness", evals, vital, "mean", facts, settings, extra)


def relevance(evals: DataFrame, signals: DataFrame, links: DataFrame | None, settings: Config) -> tuple[DataFrame, DataFrame]:
    """The answer's own atom and one a claim: responsive, or with the support tree its grade. A proper decline abstains at 1."""
    model, version = providers.stamp("relevance", settings.relevance)
    rows = signals.withColumn("seq", 4 * place(*CLAIM_ORDER) + 4)
    claim = lambda df, role, verdict, k, **more: log.emit(df, "relevance", role, verdict, F.col("seq") + k, F.col("claim_id"), "T2", grader_id=f"relevance.{role}", model=model, model_version=version, seed=settings.judge_seed, **more)
    responsive = graph.shared_checkpoint(claim(rows, "responsive", F.col("responsive"), 0, question="on_topic AND on_ask"))
    asked = graph.shared_checkpoint(tasks.answer_on_ask(evals, settings))
    ask = log.emit(asked, "relevance", "on_ask_answer", F.col("answer_on_ask"), F.lit(0), F.lit("answer"), "T2", weight=float(settings.off_ask_cap), question="answer addresses the ask?", grader_id="relevance.answer_on_ask")
    declined = asked.where("declined")
    abstain = log.emit(declined, "relevance", "abstain_relevant", F.lit(True), F.lit(0), F.lit("answer"), "T3", question="proper decline to an unanswerable question", grader_id="relevance.abstain", seed=settings.judge_seed)
    tree = settings.tree and links is not None
    n = rows.groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if("responsive").alias("k"))
    kept = lambda df: df.join(declined.select("eval_id"), "eval_id", "left_anti")
    counted, logged, band = [kept(ask), kept(responsive)], [ask, responsive, abstain], None
    if tree:
        graded = graph.shared_checkpoint(graph.graded(rows, links, settings))
        evidence = F.when(F.col("depth").isNotNull(), F.concat(F.lit("in_tree depth="), "depth")).otherwise(F.concat(F.lit("orphan="), "kind"))
        grade = claim(graded, "claim_relevance", F.col("relevant"), 1, weight=F.col("grade"), question="relevance grade (tree depth)", evidence=evidence)
        routed = graded.where("kind = 'stranded_contradiction'")
        route = log.emit(routed, "relevance", "routed_contradiction", F.lit(True), F.col("seq") + 2, F.col("claim_id"), "T1", question="stranded contradiction, for a check of consistency", grader_id="relevance.routed_contradiction")
        n = graded.groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if("relevant").alias("k"))
        counted, logged = [*counted, kept(grade)], [*logged, grade, route]
        band = graph.anchor_band(rows, links, settings).select("eval_id", "anchor_count", F.col("band_low").alias("anchor_low"))
    facts = _counted(evals, n).join(asked.select("eval_id", "declined"), "eval_id")
    facts = facts.join(band, "eval_id", "left") if band is not None else facts.withColumn("anchor_count", F.lit(None)).withColumn("anchor_low", F.lit(None))
    if tree:
        facts = facts.withColumn("anchor_count", F.coalesce("anchor_count", F.lit(0))).withColumn("anchor_low", F.lit(1 - settings.anchor_alpha))
    a = tasks.reverse_relevance(evals, settings).withColumnRenamed("relevance", "method_a") if settings.method in ("A", "both") else None
    facts = facts.join(a, "eval_id") if a is not None else facts.withColumn("method_a", F.lit(None).cast("double"))
    b = providers.provider("relevance", settings.relevance)(F.col("question"), F.col("answer")) if settings.method in ("B", "both") else F.lit(None).cast("double")
    said = lambda c: F.when(~F.col("declined"), F.col(c))
    facts = facts.withColumn("method_b", b).select("eval_id", "n", "k", F.col("declined").alias("abstained"), F.col("declined").alias("free"), hashed(F.col("question"), F.col("answer")).alias("inputs_hash"),
                                                  *(said(c).alias(c) for c in ("method_a", "method_b", "anchor_low", "anchor_count")))
    extra = {"method_a": "method_a", "method_b": "method_b", "anchor_band_low": "anchor_low", "anchor_count": "anchor_count"}
    formula = "relevance_tree_capped_mean" if tree else "relevance_capped_mean"
    return log.union(*logged), result("relevance", evals, log.union(abstain, *counted), formula, facts, settings, extra)


def task_success(evals: DataFrame, known: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame]:
    """One atom an outcome, or one alone where the task is rightly called impossible."""
    rows = graph.shared_checkpoint(tasks.judged_outcomes(evals, known))
    done = evals.select("eval_id", tasks.impossible(F.col("answer")).alias("verdict"))
    whole = log.emit(done, "task_success", "impossible_success", F.col("verdict"), F.lit(0), F.lit("task"), "T1", question="well-scoped impossibility?", evidence="marker+reason", grader_id="task_success.impossible")
    possible = rows.where("not impossible").withColumn("seq", F.col("outcome_ord") + 2)
    each = log.emit(possible, "task_success", "outcome", F.col("ok"), F.col("seq"), F.col("outcome_id"), "T1", weight=F.col("weight"), question=F.col("outcome"), grader_id=F.concat(F.lit("task_success."), "verifier"))
    each = graph.shared_checkpoint(each)
    kinds = possible.groupBy("eval_id", "task_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("k"))
    kind = log.emit(kinds, "task_success", "task_type", F.lit(True), F.lit(1), F.lit("task"), "T1", question="task-type classification", evidence=F.concat(F.lit("type="), "task_type"), grader_id="task_success.classify")
    facts = _counted(evals, kinds.drop("task_type")).join(done, "eval_id").select("eval_id", "n", "k", F.lit(False).alias("abstained"), F.col("verdict").alias("free"), hashed(F.col("question"), F.col("answer")).alias("inputs_hash"),
                                                                                  F.when(F.col("verdict"), 1.0).alias("impossible"))
    extra = {"achieved": "k", "required": "n", "impossible": "impossible"}
    return log.union(whole, kind, each), result("task_success", evals, log.union(whole.where("verdict"), each), "task_success_weighted", facts, settings, extra)


def stamped(results: DataFrame, conformal: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """results with the conformal guarantee in the extra of groundedness and source_attribution.

    conformal: scoring.conformal() rows. strata: eval_id, stratum; an evaluation takes its stratum's row, else that of all.
    """
    name = {"conformal_band_low": "band_low", "conformal_band_high": "band_high", "conformal_threshold": "threshold", "conformal_abstained": "abstained"}
    stamp = conformal.select("stratum", F.create_map(*(x for k, c in name.items() for x in (F.lit(k), F.col(c).cast("double")))).alias("stamp"))
    whole = stamp.where("stratum is null").select(F.col("stamp").alias("of_all"))
    rows = results.crossJoin(F.broadcast(whole))  # one row
    if strata is not None:
        own = strata.join(stamp.where("stratum is not null"), "stratum").select("eval_id", F.col("stamp").alias("of_stratum"))
        rows = rows.join(own, "eval_id", "left").withColumn("of_all", F.coalesce("of_stratum", "of_all")).drop("of_stratum")
    added = F.when(F.col("dimension").isin("groundedness", "source_attribution"), F.map_concat("extra", "of_all")).otherwise(F.col("extra"))
    return rows.withColumn("extra", added).select(*RESULT)


def summary(results: DataFrame, atoms: DataFrame) -> DataFrame:
    """eval_id, summary: a head line and one line a dimension, in order of name."""
    line = F.format_string("%s: %.3f [%s]%s", "dimension", F.round("score", 3), "band", F.when(F.col("abstained"), " (abstained)").otherwise(""))
    n = atoms.groupBy("eval_id").agg(F.count("*").alias("atoms"))
    rows = results.select("eval_id", F.struct("dimension", line.alias("line")).alias("x")).groupBy("eval_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(n, "eval_id", "left")
    head = F.format_string("Summary of %d dimensions over %d atoms:", F.size("xs"), F.coalesce("atoms", F.lit(0)))
    return rows.select("eval_id", F.concat_ws("\n", head, F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("summary"))


def report(results: DataFrame, atoms: DataFrame, claims: DataFrame) -> DataFrame:
    """eval_id, report: claims, one line a dimension in the fixed order with its extra values, atoms by tier."""
    at = F.array_position(F.array(*map(F.lit, ORDER)), F.col("dimension"))
    own = F.format_string("  [%s] %-13s %.3f  CI[%.2f,%.2f] n=%d%s", "band", "dimension", "score", "ci_low", "ci_high", "n", F.when(F.col("abstained"), " ABSTAINED").otherwise(""))
    pairs = F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.format_string("%s=%.3f", e["key"], e["value"]))
    lines = results.select("eval_id", F.struct(at.alias("at"), F.concat(own, F.when(F.size("extra") > 0, F.concat(F.lit("\n        "), F.array_join(pairs, ", "))).otherwise("")).alias("line")).alias("x"))
    lines = lines.groupBy("eval_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    tiers = atoms.groupBy("eval_id", "tier").agg(F.count("*").alias("n")).groupBy("eval_id").agg(F.array_sort(F.collect_list(F.concat("tier", F.lit("="), "n"))).alias("tiers"))
    n = claims.groupBy("eval_id").agg(F.count("*").alias("claims"))
    rows = lines.join(tiers, "eval_id", "left").join(n, "eval_id", "left")
    rule = F.lit("  " + "-" * 58)
    return rows.select("eval_id", F.concat_ws("\n", F.lit("Evaluation"), F.format_string("  claims: %d", F.coalesce("claims", F.lit(0))), rule, F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), rule,
                                              F.concat(F.lit("  atoms by tier: "), F.coalesce(F.nullif(F.array_join("tiers", ", "), F.lit("")), F.lit("none")))).alias("report"))
