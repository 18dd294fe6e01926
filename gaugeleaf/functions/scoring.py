"""Scores over atoms: nine formulas, intervals, bands, conformal thresholds, replay.

An atom table has the grouping columns, subject, role, verdict, weight and seq, which orders the atoms of a group. Every
formula is one or two hash aggregations with partial sums; none gathers the atoms of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeleaf.config import Config

def _mean(of: Column) -> Column:
    return F.coalesce(F.avg(of), F.lit(0.0))


def _ratio(value: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(value, weight).otherwise(0.0)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def _is(role: str, value: Column) -> Column:
    return F.when(F.col("role") == role, value)


def _bit(v: Column) -> Column:
    return v.cast("double")


def mean(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(_mean(_bit(F.col("verdict"))).alias("score"))


def weighted_mean(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(_ratio(F.col("verdict"), F.col("weight")).alias("score"))


def conjunction_weighted_mean(atoms: DataFrame, by: list[str]) -> DataFrame:
    """A subject holds if all its atoms do; it weighs what its first atom weighs."""
    subjects = atoms.groupBy(*by, "subject").agg(F.bool_and(F.col("verdict")).alias("v"), F.min_by(F.col("weight"), F.col("seq")).alias("w"))
    return subjects.groupBy(*by).agg(_ratio(F.col("v"), F.col("w")).alias("score"))


def dag_resolution(atoms: DataFrame, by: list[str]) -> DataFrame:
    """A subject has its first axiom's verdict, made true by any true derivation."""
    subjects = atoms.groupBy(*by, "subject").agg(
        F.min_by(_is("axiom", F.col("verdict")), F.when(F.col("role") == "axiom", F.col("seq"))).alias("axiom"), F.coalesce(F.bool_or(_is("derived", F.col("verdict"))), F.lit(False)).alias("derived")
    )
    value = F.when(F.col("derived"), True).otherwise(F.col("axiom"))
    return subjects.groupBy(*by).agg(_mean(_bit(value)).alias("score"))


def _capped(base: Column) -> Column:
    abstained = F.coalesce(F.bool_or(_is("abstain_relevant", F.col("verdict"))), F.lit(False))
    at = F.when(F.col("role") == "on_ask_answer", F.col("seq"))
    on_ask, cap = F.min_by(F.col("verdict"), at), F.min_by(F.col("weight"), at)
    return F.when(abstained, 1.0).when(~on_ask, F.least(base, cap)).otherwise(base)


def relevance_capped_mean(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(_capped(_mean(_is("responsive", _bit(F.col("verdict"))))).alias("score"))


def relevance_tree_capped_mean(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(_capped(_mean(_is("claim_relevance", F.col("weight")))).alias("score"))


def _impossible() -> Column:
    return F.coalesce(F.bool_or(_is("impossible_success", F.col("verdict"))), F.lit(False))


def achieved_ratio(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(F.when(_impossible(), 1.0).otherwise(_mean(_is("outcome", _bit(F.col("verdict"))))).alias("score"))


def task_success_weighted(atoms: DataFrame, by: list[str]) -> DataFrame:
    share = F.coalesce(F.sum(_is("outcome", F.when(F.col("verdict"), F.col("weight")).otherwise(0.0))) / F.nullif(F.sum(_is("outcome", F.col("weight"))), F.lit(0.0)), F.lit(0.0))
    return atoms.groupBy(*by).agg(F.when(_impossible(), 1.0).otherwise(share).alias("score"))


def unsupported_rate(atoms: DataFrame, by: list[str]) -> DataFrame:
    return atoms.groupBy(*by).agg(F.coalesce(1 - F.avg(_bit(F.col("verdict"))), F.lit(0.0)).alias("score"))


_REGISTRY: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}


def register(formula_id: str, formula: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    if formula_id in _REGISTRY:
        raise ValueError(f"formula {formula_id} is registered")
    _REGISTRY[formula_id] = formula


def formula(formula_id: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    if formula_id not in _REGISTRY:
        raise KeyError(f"unknown formula {formula_id}")
    return _REGISTRY[formula_id]


def formula_ids() -> list[str]:
    return list(_REGISTRY)


for _f in (mean, weighted_mean, conjunction_weighted_mean, dag_resolution, relevance_capped_mean, relevance_tree_capped_mean, achieved_ratio, task_success_weighted, unsupported_rate):
    register(_f.__name__, _f)


_OWN = set(_REGISTRY)


def by_formula(atoms: DataFrame, by: list[str]) -> DataFrame:
    """The score of each group by its own column formula_id, one of `by`: two hash aggregations for all built-in formulas.

    Sums over a subject's atoms and then over subjects serve every formula; formulas registered besides are added by themselves.
    """
    out = from_subjects(subject_sums(atoms.where(F.col("formula_id").isin(*_OWN)), by), by)
    for name in _REGISTRY.keys() - _OWN:
        out = out.unionByName(formula(name)(atoms.where(F.col("formula_id") == name), by).select(*by, "score"))
    return out


_ROLES = ("responsive", "claim_relevance", "outcome")


def subject_sums(atoms: DataFrame, by: list[str]) -> DataFrame:
    """What the built-in formulas need of each subject, in sums and firsts that keep up with new atoms (batch or stream)."""
    v, w, role = F.col("verdict"), F.col("weight"), F.col("role")
    held = F.when(v, w).otherwise(0.0)
    some = lambda of, x: F.coalesce(F.sum(F.when(of, x)), F.lit(0.0))
    first = lambda r: F.min(F.when(role == r, F.struct("seq", "verdict", "weight")))
    every = F.lit(True)
    return atoms.groupBy(*by, "subject").agg(
        F.count("*").alias("n"), some(every, _bit(v)).alias("k"), some(every, w).alias("w"), some(every, held).alias("kw"), F.bool_and(v).alias("all"), F.min_by(w, "seq").alias("w1"),
        first("axiom").alias("axiom"), F.bool_or(_is("derived", v)).alias("derived"), F.bool_or(_is("abstain_relevant", v)).alias("abstain"), F.bool_or(_is("impossible_success", v)).alias("impossible"),
        first("on_ask_answer").alias("ask"), *(part for r in _ROLES for part in (
            F.count_if(role == r).alias(f"n_{r}"), some(role == r, _bit(v)).alias(f"k_{r}"), some(role == r, w).alias(f"w_{r}"), some(role == r, held).alias(f"kw_{r}"))),
    )


def from_subjects(subjects: DataFrame, by: list[str]) -> DataFrame:
    """by, score: each group's score by its column formula_id, from the sums of its subjects."""
    some = lambda of, x: F.coalesce(F.sum(F.when(of, x)), F.lit(0.0))
    node = F.when(F.col("derived"), True).otherwise(F.col("axiom.verdict"))
    total = lambda c: F.sum(c).alias(c)
    groups = subjects.groupBy(*by).agg(
        *map(total, ("n", "k", "w", "kw")), some(F.col("all"), F.col("w1")).alias("kw1"), F.sum("w1").alias("w1"), _mean(_bit(node)).alias("dag"), F.bool_or("abstain").alias("abstain"),
        F.bool_or("impossible").alias("impossible"), F.min("ask").alias("ask"), *(total(f"{x}_{r}") for r in _ROLES for x in ("n", "k", "w", "kw")),
    )
    share = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y).cast("double"), F.lit(0.0)), F.lit(0.0))
    capped = lambda base: F.when(F.col("abstain"), 1.0).when(~F.col("ask.verdict"), F.least(base, F.col("ask.weight"))).otherwise(base)
    done = lambda base: F.when(F.col("impossible"), 1.0).otherwise(base)
    table = {
        "mean": share("k", "n"), "weighted_mean": share("kw", "w"), "conjunction_weighted_mean": share("kw1", "w1"), "dag_resolution": F.col("dag"),
        "relevance_capped_mean": capped(share("k_responsive", "n_responsive")), "relevance_tree_capped_mean": capped(share("w_claim_relevance", "n_claim_relevance")),
        "achieved_ratio": done(share("k_outcome", "n_outcome")), "task_success_weighted": done(share("kw_outcome", "w_outcome")), "unsupported_rate": F.when(F.col("n") > 0, 1 - share("k", "n")).otherwise(0.0),
    }
    score = F.lit(None).cast("double")
    for name, value in table.items():
        score = F.when(F.col("formula_id") == name, value).otherwise(score)
    return groups.select(*by, score.alias("score"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of k of n; all of [0, 1] for none."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p = k / m
    center, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = (center - spread) / (1 + z * z / m), (center + spread) / (1 + z * z / m)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(n <= 0, 0.0).otherwise(clamp(low)), F.when(n <= 0, 1.0).otherwise(clamp(high))


def band(score: Column, settings: Config = Config()) -> Column:
    return F.when(score >= settings.band_green, "G").when(score >= settings.band_amber, "A").otherwise("R")


def off_ask_cap(score: Column, on_ask: Column, settings: Config = Config()) -> Column:
    return F.when(on_ask, score).otherwise(F.least(score, F.lit(settings.off_ask_cap)))


def should_abstain(n: Column, settings: Config = Config()) -> Column:
    return n < settings.min_n


def order_statistic(rows: DataFrame, by: list[str], value: str, rank: Column, levels: int = 2, width: int = 4096) -> DataFrame:
    """by, n, value: the rank-th smallest value of each group, exact; rank may read n. Null values are left out, value is null for rank 0.

    No group is sorted. Values are counted in buckets of 1 / width, a running sum over these few counts finds the bucket of the
    wanted rank, and only its values are counted in finer buckets; what is left after `levels` rounds is summed by distinct value.
    """
    from pyspark.sql import Window

    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    open_ = n.withColumn("left", rank.cast("long"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in by) or "true")
    held = rows
    for level in range(1, levels + 2):
        cell = F.floor(F.col("x") * F.lit(float(width) ** level)) if level <= levels else F.col("x")
        counts = held.withColumn("cell", cell).groupBy(*by, "cell").agg(F.count("*").alias("held"))
        upto = F.sum("held").over(Window.partitionBy(*by).orderBy("cell"))
        found = counts.withColumn("upto", upto).alias("c").join(F.broadcast(open_.select(*by, "left")).alias("o"), same("c", "o")).where("upto >= left and upto - held < left")
        open_ = found.select(*(F.col(f"c.{c}").alias(c) for c in by), "cell", (F.col("left") - (F.col("upto") - F.col("held"))).alias("left"))
        if level <= levels:
            picked = F.broadcast(open_.select(*by, F.col("cell").alias("want")))  # one row a group
            held = held.alias("h").join(picked.alias("p"), same("h", "p") & (cell == F.col("want"))).select("h.*")
    return n.alias("n").join(open_.select(*by, F.col("cell").alias("value")).alias("f"), same("n", "f"), "left").select(*(F.col(f"n.{c}").alias(c) for c in by), "n.n", "f.value")


def conformal(points: DataFrame, strata: bool = False, alpha: float = 0.05, min_n: int = 6) -> DataFrame:
    """stratum (null: all), threshold, tau_hat, band_low, band_high, n, abstained, from confidence and label.

    tau_hat is the ceil((1 - alpha) * (n + 1))-th smallest of 1 - confidence over the true points, an exact order statistic.
    """
    rows = points.select(F.lit(None).cast("string").alias("stratum"), "confidence", "label")
    if strata:
        rows = rows.unionByName(points.select(F.col("stratum").cast("string").alias("stratum"), "confidence", "label"))
    groups = rows.groupBy("stratum").agg(F.count_if("label").alias("n"))
    k = F.least(F.ceil((1 - alpha) * (F.col("n") + 1)), F.col("n"))
    best = order_statistic(rows.where("label").withColumn("lack", -F.col("confidence")), ["stratum"], "lack", k)
    joined = groups.alias("c").join(best.select(F.col("stratum").alias("own"), (-F.col("value")).alias("confidence")), F.expr("c.stratum <=> own"), "left")
    few = (F.col("n") < min_n) | F.col("confidence").isNull()
    tau = F.when(few, 1.0).otherwise(1 - F.col("confidence"))
    high = F.when(few, 1.0).otherwise(F.least(F.lit(1.0), 1 - alpha + 1 / (F.col("n") + 1)))
    return joined.select(
        "stratum", F.when(few, 0.0).otherwise(1 - tau).alias("threshold"), tau.alias("tau_hat"),
        F.lit(1 - alpha).alias("band_low"), high.alias("band_high"), F.col("n").cast("long").alias("n"), few.alias("abstained"),
    )


def reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """stratum (null: all), bin, low, high, n, accuracy, confidence: stated confidences against labels, by bin; empty bins stay, with n 0.

    Both groupings come from one pass over partial sums. A confidence on a border belongs to the bin above it, 1 to the last.
    """
    place = F.least(F.greatest(F.floor(F.col("confidence") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = points.where("confidence is not null and label is not null").select(F.coalesce(F.col("stratum").cast("string"), F.lit("default")).alias("stratum"), "confidence", F.col("label").cast("int").alias("hit"), place.alias("bin"))
    sums = rows.groupingSets([["stratum", "bin"], ["bin"]], "stratum", "bin").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("confidence").alias("stated"))
    every = sums.select("stratum").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).alias("e")
    met = every.join(sums.alias("s"), F.expr("e.stratum <=> s.stratum and e.bin = s.bin"), "left")
    return met.select("e.stratum", "e.bin", (F.col("e.bin") / bins).alias("low"), ((F.col("e.bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), (F.col("hits") / F.col("n")).alias("accuracy"), (F.col("stated") / F.col("n")).alias("confidence"))


def calibration_error(table: DataFrame, min_n: int = 1) -> DataFrame:
    """stratum, n, bins, used, ece, mce, abstained from reliability(): the mean and the largest gap of accuracy and confidence.

    With the number of bins and of those in use, as ece says little without them; fewer points than min_n abstain.
    """
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    rows = table.groupBy("stratum").agg(F.sum("n").alias("n"), F.count("*").alias("bins"), F.count_if(F.col("n") > 0).alias("used"), F.sum(gap * F.col("n")).alias("total"), F.max(gap).alias("mce"))
    few = F.col("n") < min_n
    return rows.select("stratum", "n", "bins", "used", F.when(~few, F.col("total") / F.col("n")).alias("ece"), F.when(~few, F.col("mce")).alias("mce"), few.alias("abstained"))


def retain(confidence: Column, threshold: Column, abstained: Column) -> Column:
    return abstained | (confidence >= threshold)
