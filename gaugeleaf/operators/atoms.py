"""The atom log: identity, emission, latest state, replay of scores from the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeleaf.functions import scoring

IDENTITY = ("subject", "role", "question", "tier", "verdict", "weight", "evidence", "grader_id", "model", "model_version", "seed")
ROLES = ("eval_id", "dimension", "seq", "atom_id", *IDENTITY, "ts")


def _shown(name: str) -> Column:
    """Values as the log's identity spells them: True, 1.0, None."""
    x = F.col(name)
    if name == "verdict":
        x = F.when(x, "True").otherwise("False")
    elif name == "weight":
        whole = x == F.floor(x)
        x = F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))
    return F.coalesce(x.cast("string"), F.lit("None"))


def atom_id() -> Column:
    """The first 16 hex digits of SHA-256 of the identity fields; the time stamp is not among them."""
    return F.substring(F.sha2(F.concat_ws("|", *map(_shown, IDENTITY)).cast("binary"), 256), 1, 16)


def emit(df: DataFrame, dimension: str, role: str, verdict: Column, seq: Column, subject: Column, tier: str = "code", weight: Column | float = 1.0, **fields) -> DataFrame:
    """Atoms of one role, one for each row."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    values = {"question": "", "evidence": "", "grader_id": f"{dimension}.{role}", "model": "code", "model_version": "1", "seed": None} | fields
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = df.select(
        "eval_id", F.lit(dimension).alias("dimension"), seq.cast("long").alias("seq"), subject.cast("string").alias("subject"), F.lit(role).alias("role"),
        *(column(values[k]).cast("string").alias(k) for k in ("question",)), F.lit(tier).alias("tier"), verdict.alias("verdict"), weight.cast("double").alias("weight"),
        *(column(values[k]).cast("string").alias(k) for k in ("evidence", "grader_id", "model", "model_version")), column(values["seed"]).cast("long").alias("seed"),
    )
    return out.withColumn("atom_id", atom_id()).withColumn("ts", F.lit("")).select(*ROLES)


def stamped(atoms: DataFrame, now: str | None = None) -> DataFrame:
    """atoms with ts: the given time, else the time of the query. It is no part of an atom's identity."""
    utc = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return atoms.withColumn("ts", utc if now is None else F.lit(now))


def union(*emitted: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, emitted)


def latest(atoms: DataFrame, key: str | list[str] = "atom_id", order: str = "seq") -> DataFrame:
    """One row for each key, of one column or several: the one written last."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in atoms.columns if c not in keys]
    return atoms.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def by_ids(requests: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms in the order of each request's atom_ids, repeats kept, missing ones skipped; pos is the order."""
    asked = requests.select(*(c for c in requests.columns if c != "atom_ids"), F.posexplode("atom_ids").alias("pos", "atom_id"))
    return asked.join(latest(atoms).drop(*(set(atoms.columns) & set(requests.columns) - {"atom_id"})), "atom_id")


def replay(results: DataFrame, atoms: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """eval_id, dimension, formula_id, score, recomputed, ok: scores against those that the logged atoms give."""
    held = by_ids(results.select("eval_id", "dimension", "formula_id", "atom_ids"), atoms).withColumn("seq", F.col("pos").cast("long"))
    again = scoring.by_formula(held, ["eval_id", "dimension", "formula_id"]).withColumnRenamed("score", "recomputed")
    joined = results.select("eval_id", "dimension", "formula_id", "score").join(again, ["eval_id", "dimension", "formula_id"], "left")
    joined = joined.withColumn("recomputed", F.coalesce("recomputed", F.lit(0.0)))
    return joined.withColumn("ok", F.abs(F.col("score") - F.col("recomputed")) <= tolerance)


def tier_counts(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("tier").agg(F.count("*").alias("n"))
