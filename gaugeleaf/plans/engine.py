"""One call for many evaluations: claims and triplets, the shared support set, the claim graph, eight dimensions, their log."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeleaf.config import Config
from gaugeleaf.functions import scoring
from gaugeleaf.operators import atoms as log
from gaugeleaf.operators import dimensions as dim
from gaugeleaf.operators import graph, pipeline, records, support, tasks


@dataclass(frozen=True)
class Bundle:
    """The tables of a run. What several dimensions read is checkpointed; results, atoms and texts are computed when asked for."""

    claims: DataFrame
    triplets: DataFrame
    labels: DataFrame
    supports: DataFrame
    links: DataFrame | None
    atoms: DataFrame
    results: DataFrame
    summary: DataFrame
    report: DataFrame

    def graph(self) -> DataFrame:
        """eval_id, graph: the resolved claim graph as JSON; without detected edges, nodes alone."""
        rows = graph.typed(graph.ordered(self.claims), self.supports)
        nodes = rows.groupBy("eval_id", F.col("claim_id").alias("node")).agg(F.min_by("ctype", "ord").alias("ctype"), F.min_by("context_incomplete", "ord").alias("context_incomplete"))
        nodes = nodes.join(graph.status(nodes, self.atoms.where("dimension = 'accuracy'")), ["eval_id", "node"])
        links = self.links if self.links is not None else nodes.select("eval_id", F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
        return graph.node_link(nodes, links.withColumn("etype", F.lit("supports")))


def evaluate(evals: DataFrame, chunks: DataFrame, settings: Config = Config(), calibration: DataFrame | None = None, strata: DataFrame | None = None, recall: DataFrame | None = None, now: str | None = None) -> Bundle:
    """evals: eval_id, question, answer, at will citations (array); chunks: eval_id, chunk_ord, chunk_id, text, url, domain, date, author.

    calibration: confidence, label, stratum. strata: eval_id, stratum. recall: question_match, fact. now: the log's time stamp.
    Claims, the support set, units and signals are checkpointed, as several dimensions read them.
    """
    claims = dim.with_explicit(pipeline.claims(evals, chunks, settings), chunks)
    return dimensions(claims, evals, chunks, settings, calibration, strata, recall, now)


def dimensions(claims: DataFrame, evals: DataFrame, chunks: DataFrame, settings: Config = Config(), calibration: DataFrame | None = None, strata: DataFrame | None = None, recall: DataFrame | None = None, now: str | None = None) -> Bundle:
    """The same from claims that know their citations: citation, explicit and own."""
    keep = graph.shared_checkpoint
    evals, claims = keep(evals), keep(claims)
    trips = keep(pipeline.triplets(claims))
    labels = keep(support.triplet_labels(trips, support.labelled(trips, chunks, settings)))
    supports = keep(support.claim_support(labels))
    conformal = scoring.conformal(calibration, strata is not None, settings.conformal_alpha, settings.conformal_min_n) if calibration is not None else None
    gate = settings.precision_threshold
    if conformal is not None and not (row := conformal.where("stratum is null").first()).abstained:  # one row
        gate = row.threshold
    links = keep(graph.edges(graph.ordered(claims), settings)) if settings.dag_rescue or settings.tree else None
    cites = claims.select("eval_id", "citation")
    if "citations" in evals.columns:
        cites = cites.unionByName(evals.select("eval_id", F.explode("citations").alias("citation")))
    sets = keep(dim.cited_sets(claims, supports))
    cited = keep(dim.fabrication(cites, chunks, settings))
    reqs = tasks.requirements(evals, settings)
    gated = keep(tasks.gated(tasks.draft(reqs, tasks.source_sentences(chunks)), evals, chunks, settings, quoted=True))
    frozen = keep(tasks.dedupe(tasks.frozen(gated), settings))
    miss = keep(tasks.recall_miss(evals, frozen, recall)) if recall is not None else None
    grounded, in_sources = records.groundedness(evals, labels, trips, chunks, settings)
    parts = [
        (log.union(grounded, records.grounded_atoms(supports, settings)), in_sources),
        records.hallucination(evals, labels, grounded, cited, settings),
        records.source_quality(evals, chunks, labels, settings), records.source_attribution(evals, sets, settings),
        records.accuracy(evals, keep(dim.axioms(sets, chunks, gate, settings)), links, settings), records.completeness(evals, reqs, gated, frozen, chunks, miss, settings),
        records.relevance(evals, keep(tasks.claim_signals(claims, evals, settings)), links, settings), records.task_success(evals, tasks.context_tokens(chunks), settings),
    ]
    atoms = log.stamped(reduce(DataFrame.unionByName, (a for a, _ in parts)), now)
    results = reduce(DataFrame.unionByName, (r for _, r in parts))
    if conformal is not None:
        results = records.stamped(results, conformal, strata)
    return Bundle(claims, trips, labels, supports, links, atoms, results, records.summary(results, atoms), records.report(results, atoms, claims))
