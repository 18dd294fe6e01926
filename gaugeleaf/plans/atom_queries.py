"""Formulas, intervals, bands, log state and replay over a log of lineitem size: each line is an atom of its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.functions import scoring
from gaugeleaf.operators import atoms as log

#: Role by formula: the case expression is plain SQL in both engines.
ROLE = {
    "mean": "'unit'", "weighted_mean": "'unit'", "conjunction_weighted_mean": "'unit'", "unsupported_rate": "'unit'",
    "dag_resolution": "CASE WHEN l_linestatus = 'O' THEN 'axiom' WHEN l_linenumber % 3 = 0 THEN 'note' ELSE 'derived' END",
    "relevance_capped_mean": "CASE l_linenumber % 4 WHEN 0 THEN 'on_ask_answer' WHEN 3 THEN CASE WHEN l_tax > 0.07 THEN 'abstain_relevant' ELSE 'responsive' END ELSE 'responsive' END",
    "relevance_tree_capped_mean": "CASE l_linenumber % 4 WHEN 0 THEN 'on_ask_answer' ELSE 'claim_relevance' END",
    "achieved_ratio": "CASE WHEN l_tax > 0.07 THEN 'impossible_success' ELSE 'outcome' END",
    "task_success_weighted": "CASE WHEN l_tax > 0.07 THEN 'impossible_success' ELSE 'outcome' END",
}
WEIGHT = {"relevance_capped_mean": "l_discount", "relevance_tree_capped_mean": "l_discount"}
KEYS = {
    "f_mean": "mean", "f_weighted_mean": "weighted_mean", "f_conjunction": "conjunction_weighted_mean", "f_dag": "dag_resolution", "f_rel_capped": "relevance_capped_mean",
    "f_rel_tree": "relevance_tree_capped_mean", "f_achieved": "achieved_ratio", "f_task_weighted": "task_success_weighted", "f_unsupported": "unsupported_rate",
}
#: A total order of an order's lines.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount", "l_returnflag", "l_linestatus"]


def line_atoms(spark: SparkSession, sf_dir: str, formula: str = "mean") -> DataFrame:
    """eval_id, subject, seq (a struct that orders), role, verdict, weight, tier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        F.col("l_orderkey").alias("eval_id"), F.col("l_partkey").cast("string").alias("subject"), F.struct(*ORDER).alias("seq"), F.expr(ROLE[formula]).alias("role"),
        (F.col("l_returnflag") != "R").alias("verdict"), F.expr(WEIGHT.get(formula, "l_quantity")).cast("double").alias("weight"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' ELSE 'code' END").alias("tier"),
    )


def _formula(key: str):
    name = KEYS[key]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scoring.formula(name)(line_atoms(spark, sf_dir, name), ["eval_id"])
        return rows.select("eval_id", F.round("score", 6).alias("score"))

    return query


def _atoms_sql(formula: str) -> str:
    return (
        f"a AS (SELECT l_orderkey AS eval_id, l_partkey AS subject, {ROLE[formula]} AS role, l_returnflag <> 'R' AS v, CAST({WEIGHT.get(formula, 'l_quantity')} AS DOUBLE) AS w, "
        f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS seq FROM lineitem)"
    )


_RATIO = "coalesce(sum(CASE WHEN {v} THEN {w} ELSE 0 END) / nullif(sum({w}), 0), 0.0)"
_ONE = {
    "mean": "coalesce(avg(CAST(v AS INT)), 0.0)",
    "weighted_mean": _RATIO.format(v="v", w="w"),
    "unsupported_rate": "coalesce(1 - avg(CAST(v AS INT)), 0.0)",
    "achieved_ratio": "CASE WHEN coalesce(bool_or(v) FILTER (role = 'impossible_success'), false) THEN 1.0 ELSE coalesce(avg(CAST(v AS INT)) FILTER (role = 'outcome'), 0.0) END",
    "task_success_weighted": "CASE WHEN coalesce(bool_or(v) FILTER (role = 'impossible_success'), false) THEN 1.0 ELSE "
    "coalesce(sum(CASE WHEN v THEN w ELSE 0 END) FILTER (role = 'outcome') / nullif(sum(w) FILTER (role = 'outcome'), 0), 0.0) END",
}
for _name, _base in (("relevance_capped_mean", "coalesce(avg(CAST(v AS INT)) FILTER (role = 'responsive'), 0.0)"), ("relevance_tree_capped_mean", "coalesce(avg(w) FILTER (role = 'claim_relevance'), 0.0)")):
    _ONE[_name] = (
        "CASE WHEN coalesce(bool_or(v) FILTER (role = 'abstain_relevant'), false) THEN 1.0 "
        f"WHEN NOT (first(v ORDER BY seq) FILTER (role = 'on_ask_answer')) THEN least({_base}, first(w ORDER BY seq) FILTER (role = 'on_ask_answer')) ELSE {_base} END"
    )


def _formula_sql(name: str) -> str:
    if name == "conjunction_weighted_mean":
        return (
            f"WITH {_atoms_sql(name)}, s AS (SELECT eval_id, subject, bool_and(v) AS v, first(w ORDER BY seq) AS w FROM a GROUP BY ALL) "
            f"SELECT eval_id, round(CAST({_RATIO.format(v='v', w='w')} AS DOUBLE), 6) AS score FROM s GROUP BY eval_id"
        )
    if name == "dag_resolution":
        return (
            f"WITH {_atoms_sql(name)}, s AS (SELECT eval_id, subject, first(v ORDER BY seq) FILTER (role = 'axiom') AS x, coalesce(bool_or(v) FILTER (role = 'derived'), false) AS d FROM a GROUP BY ALL) "
            "SELECT eval_id, round(coalesce(avg(CAST(CASE WHEN d THEN true ELSE x END AS INT)), 0.0), 6) AS score FROM s GROUP BY eval_id"
        )
    return f"WITH {_atoms_sql(name)} SELECT eval_id, round(CAST({_ONE[name]} AS DOUBLE), 6) AS score FROM a GROUP BY eval_id"


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_atoms(spark, sf_dir).withColumn("supplier", F.col("seq.l_suppkey")).groupBy("supplier").agg(F.count_if("verdict").alias("k"), F.count("*").alias("n"))
    low, high = scoring.wilson(F.col("k"), F.col("n"))
    return rows.select("supplier", "k", "n", F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


WILSON_SQL = """
WITH g AS (SELECT l_suppkey AS supplier, count(*) FILTER (l_returnflag <> 'R') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey),
p AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.96 * 1.96 AS zz FROM g)
SELECT supplier, k, n, round(greatest(0.0, (p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n)), 6) AS ci_low,
  round(least(1.0, (p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n)), 6) AS ci_high FROM p
"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.weighted_mean(line_atoms(spark, sf_dir), ["eval_id"])
    return rows.groupBy(scoring.band(F.round("score", 6)).alias("band")).agg(F.count("*").alias("n"))


BANDS_SQL = f"""
SELECT CASE WHEN score >= 0.90 THEN 'G' WHEN score >= 0.75 THEN 'A' ELSE 'R' END AS band, count(*) AS n FROM ({_formula_sql('weighted_mean')}) GROUP BY 1
"""


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.tier_counts(line_atoms(spark, sf_dir))


TIERS_SQL = "SELECT CASE l_linenumber % 4 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' ELSE 'code' END AS tier, count(*) AS n FROM lineitem GROUP BY 1"


def atom_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each part that was written last, by order, then line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = li.select(F.col("l_partkey").alias("atom_id"), F.struct("l_orderkey", *ORDER).alias("seq"), "l_returnflag", F.col("l_quantity").alias("weight"))
    return log.latest(rows).select("atom_id", F.col("seq.l_orderkey").alias("eval_id"), "l_returnflag", "weight")


LATEST_SQL = f"""
SELECT l_partkey AS atom_id, l_orderkey AS eval_id, l_returnflag, l_quantity AS weight
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, {', '.join(f'{c} DESC' for c in ORDER)}) = 1
"""


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scores against the log; the score of every 97th order was tampered with."""
    li = line_atoms(spark, sf_dir).withColumn("atom_id", F.sha2(F.concat_ws("|", "eval_id", "subject", F.col("seq").cast("string")).cast("binary"), 256))
    li = li.withColumn("dimension", F.lit("d"))
    name = F.expr("CASE eval_id % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'weighted_mean' ELSE 'unsupported_rate' END")
    k, n, kw, w = F.count_if("verdict"), F.count("*"), F.sum(F.when(F.col("verdict"), F.col("weight")).otherwise(0.0)), F.sum("weight")
    stored = F.when(F.col("eval_id") % 3 == 0, F.col("k") / F.col("n")).when(F.col("eval_id") % 3 == 1, F.col("kw") / F.col("w")).otherwise(1 - F.col("k") / F.col("n"))
    results = li.groupBy("eval_id", "dimension").agg(F.collect_list("atom_id").alias("atom_ids"), k.alias("k"), n.alias("n"), kw.alias("kw"), w.alias("w"))
    results = results.select("eval_id", "dimension", name.alias("formula_id"), "atom_ids", (stored + F.when(F.col("eval_id") % 97 == 0, 0.5).otherwise(0.0)).alias("score"))
    done = log.replay(results, li.drop("eval_id", "dimension"))
    return done.select("eval_id", "formula_id", F.round("recomputed", 6).alias("recomputed"), "ok")


REPLAY_SQL = """
SELECT l_orderkey AS eval_id, CASE l_orderkey % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'weighted_mean' ELSE 'unsupported_rate' END AS formula_id,
  round(CASE l_orderkey % 3 WHEN 0 THEN avg(CAST(l_returnflag <> 'R' AS INT)) WHEN 1 THEN sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity)
  ELSE 1 - avg(CAST(l_returnflag <> 'R' AS INT)) END, 6) AS recomputed, l_orderkey % 97 <> 0 AS ok FROM lineitem GROUP BY l_orderkey
"""

QUERIES = {key: _formula(key) for key in KEYS} | {"wilson": wilson, "bands": bands, "tier_counts": tier_counts, "atom_latest": atom_latest, "replay": replay}
SQL = {key: _formula_sql(name) for key, name in KEYS.items()} | {"wilson": WILSON_SQL, "bands": BANDS_SQL, "tier_counts": TIERS_SQL, "atom_latest": LATEST_SQL, "replay": REPLAY_SQL}
