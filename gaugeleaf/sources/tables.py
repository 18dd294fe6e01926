"""Tables that people maintain, from JSON lines on any store that Spark reads: types with keywords, domain lists, prompts.

They are small and enter plans as literals or dictionaries, hence are read on the driver, `most` rows at most; more is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = "type string, keywords array<string>, requirements array<struct<id:string,text:string,vital:boolean>>"
OUTCOMES = (
    "type string, keywords array<string>, outcomes array<struct<id:string,text:string,verifier:string,weight:double,patterns:array<string>,signals:array<string>,run_claims:array<string>,cues:array<string>,"
    "requirement:string,signal:string,max_words:int,min_words:int,includes:array<string>,excludes:array<string>,expected:string,exact:boolean>>"
)
DOMAINS = "kind string, value string"
PROMPTS = "version string, name string, text string"
KINDS = ("allowed", "denied", "coi_domains", "coi_authors")


def _rows(spark: SparkSession, path: str, schema: str, most: int) -> list:
    found: DataFrame = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = found.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} rows")
    return rows


def requirement_types(spark: SparkSession, path: str, most: int = 10_000) -> dict:
    """Question types as tasks.templated() takes them, in the order of the file's lines (one file); one named default has to be there."""
    types = {r.type: (list(r.keywords or []), [(x.id, x.text, bool(x.vital)) for x in r.requirements or []]) for r in _rows(spark, path, TYPES, most)}
    if "default" not in types:
        raise ValueError(f"{path} has no type named default")
    return types


def task_types(spark: SparkSession, path: str, most: int = 10_000) -> dict:
    """Task types as tasks.outcomes() takes them, in the order of the file's lines; each outcome has an id, a text and a verifier, and weighs 1 if not told."""
    types = {}
    for r in _rows(spark, path, OUTCOMES, most):
        found = []
        for x in r.outcomes or []:
            own = x.asDict()
            if not (own["id"] and own["text"] and own["verifier"]):
                raise ValueError(f"task type {r.type} has an outcome without id, text or verifier")
            rest = {k: v for k, v in own.items() if k not in ("id", "text", "verifier", "weight") and v is not None}
            found.append((own["id"], own["text"], own["verifier"], 1.0 if own["weight"] is None else own["weight"], rest))
        types[r.type] = (list(r.keywords or []), found)
    return types


def records(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """Any maintained table, JSON lines under its schema: a malformed line is an error, as is a row beyond `most`."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if most is not None and rows.limit(most + 1).count() > most:
        raise ValueError(f"{path} has more than {most} rows")
    return rows


def source_lists(spark: SparkSession, path: str, most: int = 100_000) -> dict[str, tuple[str, ...]]:
    """Settings from rows of kind (allowed, denied, coi_domains, coi_authors) and value; kinds without a row are left out."""
    out: dict[str, list[str]] = {}
    for r in _rows(spark, path, DOMAINS, most):
        if r.kind not in KINDS:
            raise ValueError(f"unknown kind {r.kind}")
        out.setdefault(r.kind, []).append(r.value)
    return {k: tuple(v) for k, v in out.items()}


def prompts(spark: SparkSession, path: str, version: str, most: int = 10_000) -> dict[str, str]:
    """The prompts of one version by name; a version without any is an error."""
    found = {r.name: r.text for r in _rows(spark, path, PROMPTS, most) if r.version == version}
    if not found:
        raise ValueError(f"{path} has no prompts of version {version}")
    return found


def realized(prompt: str, clause: Column) -> Column:
    """A prompt with its {clause} filled in."""
    return F.replace(F.lit(prompt), F.lit("{clause}"), clause)
