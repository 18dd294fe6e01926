"""Support of claims by documents and the dimensions that read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugeleaf import config as c
from gaugeleaf.functions import scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators import dimensions as dim
from gaugeleaf.operators import graph, pipeline, support
from gaugeleaf.plans import sql as s
from gaugeleaf.plans.text_queries import claims_of
from gaugeleaf.sources import evaluations as src


def r6(x: Column | str) -> Column:
    """To 6 places as the SQL does, by the rounded product: F.round(x, 6) goes by the decimal digits, and a tie such as 0.5203125 by other ways."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 1e6) / 1e6


def triplets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.triplets(claims_of(spark, sf_dir))


def kept_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims for a query that reads them more than once."""
    return graph.shared_checkpoint(claims_of(spark, sf_dir))


def labels_of(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None) -> DataFrame:
    rows = graph.shared_checkpoint(triplets_of(spark, sf_dir) if claims is None else pipeline.triplets(claims))  # read by the ranking and by its result
    return support.triplet_labels(rows, support.labelled(rows, src.chunks(spark, sf_dir)))


def cited_claims(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None) -> DataFrame:
    """Claims with citations dealt out: by sentence, to the chunk of rank sent_ord modulo chunks + 1, to none, or to a made-up id."""
    ranks = src.chunks(spark, sf_dir).select("eval_id", "chunk_id", (F.row_number().over(Window.partitionBy("eval_id").orderBy("chunk_ord")) - 1).alias("place"))
    n = ranks.groupBy("eval_id").agg(F.count("*").alias("n"))
    rows = (claims_of(spark, sf_dir) if claims is None else claims).drop("citation").join(n, "eval_id", "left").withColumn("place", F.col("sent_ord") % (F.coalesce("n", F.lit(0)) + 1))
    rows = rows.join(ranks, ["eval_id", "place"], "left").withColumn("citation", F.when(F.col("sent_ord") % 13 == 5, "fabricated-99").otherwise(F.col("chunk_id")))
    explicit = F.when((F.col("sent_ord") % 2 == 0) & (F.col("citation") == F.col("chunk_id")), F.array("chunk_id")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("explicit", explicit).withColumn("own", F.when(F.col("citation") == F.col("chunk_id"), F.col("chunk_id"))).drop("n", "place", "chunk_id")


CITED = """
cranks AS (SELECT eval_id, chunk_id, row_number() OVER (PARTITION BY eval_id ORDER BY chunk_ord) - 1 AS place FROM chunks),
cn AS (SELECT eval_id, count(*) AS n FROM chunks GROUP BY eval_id),
cited0 AS (SELECT claims.* EXCLUDE (citation), sent_ord % (coalesce(n, 0) + 1) AS place FROM claims LEFT JOIN cn USING (eval_id)),
cited AS (SELECT *, CASE WHEN sent_ord % 13 = 5 THEN 'fabricated-99' ELSE chunk_id END AS citation, CASE WHEN sent_ord % 13 <> 5 THEN chunk_id END AS own,
  CASE WHEN sent_ord % 2 = 0 AND sent_ord % 13 <> 5 AND chunk_id IS NOT NULL THEN [chunk_id] ELSE CAST([] AS VARCHAR[]) END AS explicit FROM cited0 LEFT JOIN cranks USING (eval_id, place))"""
_SLOTS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({s.listed(c.STOP)}, w)), lambda w: CAST('0x' || substr(md5('20250730:' || w), 1, 8) AS BIGINT) % 64)"
SUPPORT = f"""
tslot AS (SELECT eval_id, sent_ord, clause_ord, trip_ord, claim_id, {s.tokens('text')} AS tok, {_SLOTS} AS sl FROM triplets),
tvec AS (SELECT * REPLACE (CASE WHEN len(sl) = 0 THEN [20250730 % 64] ELSE sl END AS sl) FROM tslot),
cslot AS (SELECT eval_id, chunk_ord, chunk_id, coalesce(nullif(domain, ''), nullif(url, ''), chunk_id) AS doc, {s.tokens('text')} AS prem, {_SLOTS} AS sl FROM chunks),
cvec AS (SELECT * EXCLUDE (sl), list_transform(range(0, 64), lambda d: CAST(len(list_filter(CASE WHEN len(sl) = 0 THEN [20250730 % 64] ELSE sl END, lambda x: x = d)) AS DOUBLE)) AS cnt FROM cslot),
pair AS (SELECT tvec.*, chunk_ord, chunk_id, doc, prem, round(list_sum(list_transform(sl, lambda d: cnt[d + 1])) /
  (sqrt(list_sum(list_transform(list_distinct(sl), lambda d: pow(len(list_filter(sl, lambda x: x = d)), 2)))) * sqrt(list_sum(list_transform(cnt, lambda x: x * x)))), 9) AS cosine FROM tvec JOIN cvec USING (eval_id)),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY eval_id, sent_ord, clause_ord, trip_ord ORDER BY cosine DESC, chunk_ord) AS rank FROM pair QUALIFY rank <= 3),
raw AS (SELECT *, {s.coverage('tok', 'prem')} AS raw FROM top),
lab AS (SELECT *, {s.label('raw', 'prem', 'tok')} AS label FROM raw),
up AS (SELECT eval_id, sent_ord, clause_ord, trip_ord, bool_or(label = 'E') AS e, bool_or(label = 'C') AS c, max(raw) AS confidence,
  list(DISTINCT chunk_id) FILTER (label = 'E') AS chunks, list(DISTINCT doc) FILTER (label = 'E') AS docs FROM lab GROUP BY ALL),
labels AS MATERIALIZED (SELECT eval_id, sent_ord, clause_ord, trip_ord, claim_id, CASE WHEN e THEN 'E' WHEN c THEN 'C' ELSE 'N' END AS label, coalesce(confidence, 0.0) AS confidence,
  coalesce(chunks, []) AS chunks, coalesce(docs, []) AS docs FROM triplets LEFT JOIN up USING (eval_id, sent_ord, clause_ord, trip_ord)),
sup AS (SELECT eval_id, claim_id, bool_and(label = 'E') AS grounded, max(confidence) AS confidence, list_sort(list_distinct(flatten(list(chunks)))) AS chunks, list_sort(list_distinct(flatten(list(docs)))) AS docs
  FROM labels GROUP BY ALL)"""
BASE = (s.EV, s.CHUNKS, s.SPANS, s.CLAIMS, s.TRIPLETS, SUPPORT)


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    m = f"greatest(CAST({n} AS DOUBLE), 1.0)"
    p, zz = f"({k} / {m})", "(1.96 * 1.96)"
    side = lambda sign: f"round(CASE WHEN {n} = 0 THEN {'0.0' if sign == '-' else '1.0'} ELSE greatest(0.0, least(1.0, ({p} + {zz} / (2 * {m}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {m} + {zz} / (4 * {m} * {m}))) / (1 + {zz} / {m}))) END, 6)"
    return side("-"), side("+")


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.90 THEN 'G' WHEN {x} >= 0.75 THEN 'A' ELSE 'R' END"


def prefilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = support.prefilter(triplets_of(spark, sf_dir), src.chunks(spark, sf_dir))
    return rows.groupBy("eval_id", "chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("first"), r6(F.max("cosine")).alias("best"))


PREFILTER = s.with_(*BASE) + "SELECT eval_id, chunk_id, count(*) AS n, count(*) FILTER (rank = 1) AS first, round(max(cosine), 6) AS best FROM top GROUP BY ALL"


def support_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = support.claim_support(labels_of(spark, sf_dir))
    return rows.select("eval_id", "claim_id", F.array_join("chunks", ",").alias("chunks"), F.array_join("docs", ",").alias("docs"))


SUPPORT_SET = s.with_(*BASE) + "SELECT eval_id, claim_id, array_to_string(chunks, ',') AS chunks, array_to_string(docs, ',') AS docs FROM sup"


def claim_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.claim_support(labels_of(spark, sf_dir)).select("eval_id", "claim_id", "grounded", r6("confidence").alias("confidence"))


CLAIM_GROUNDED = s.with_(*BASE) + "SELECT eval_id, claim_id, grounded, round(confidence, 6) AS confidence FROM sup"


def nli_label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.label_rates(labels_of(spark, sf_dir)).select("eval_id", "total", *(r6(f"{x}_rate").alias(f"{x}_rate") for x in "enc"))


RATES = s.with_(*BASE) + "SELECT eval_id, count(*) AS total, " + ", ".join(f"round(count(*) FILTER (label = '{x.upper()}') / CAST(count(*) AS DOUBLE), 6) AS {x}_rate" for x in "enc") + " FROM labels GROUP BY eval_id"


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim.groundedness(labels_of(spark, sf_dir)).select("eval_id", "supported", "total", r6("score").alias("score"), "band", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_LOW, _HIGH = wilson_sql("supported", "total")
GROUNDEDNESS = s.with_(*BASE) + f"""SELECT *, round(supported / CAST(total AS DOUBLE), 6) AS score, {band_sql('supported / CAST(total AS DOUBLE)')} AS band, {_LOW} AS ci_low, {_HIGH} AS ci_high
FROM (SELECT eval_id, count(*) FILTER (label = 'E') AS supported, count(*) AS total FROM labels GROUP BY eval_id)"""


def fabrication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived citations, and page links of the same number as the evaluation."""
    links = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("eval_id"), F.col("url").alias("citation"))
    cites = cited_claims(spark, sf_dir).select("eval_id", "citation").unionByName(links)
    return dim.fabrication(cites, src.chunks(spark, sf_dir))


_EXISTS = "CASE WHEN citation LIKE 'http://%' OR citation LIKE 'https://%' OR citation LIKE '10.%' OR citation LIKE 'doi:%' THEN NOT (" + " OR ".join(f"contains(lower(citation), '{m}')" for m in c.MISSING_MARKS) + ") ELSE id IS NOT NULL END"
FABRICATION = s.with_(s.EV, s.CHUNKS, s.SPANS, s.CLAIMS, CITED) + f"""SELECT eval_id, citation, {_EXISTS} AS exists
FROM (SELECT DISTINCT eval_id, citation FROM (SELECT eval_id, citation FROM cited UNION ALL SELECT page_id, url FROM pages) WHERE citation IS NOT NULL) x
LEFT JOIN (SELECT eval_id, chunk_id AS id FROM chunks) k USING (eval_id) WHERE k.id = citation
UNION ALL SELECT eval_id, citation, {_EXISTS.replace('id IS NOT NULL', 'false')} AS exists FROM (SELECT DISTINCT eval_id, citation FROM (SELECT eval_id, citation FROM cited UNION ALL SELECT page_id, url FROM pages)
WHERE citation IS NOT NULL) x ANTI JOIN (SELECT eval_id, chunk_id AS citation FROM chunks) k USING (eval_id, citation)"""


def hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = kept_claims(spark, sf_dir)
    cites = dim.fabrication(cited_claims(spark, sf_dir, claims).select("eval_id", "citation"), src.chunks(spark, sf_dir))
    rows = dim.hallucination(labels_of(spark, sf_dir, claims), cites)
    return rows.select("eval_id", r6("score").alias("score"), "band", r6("neutral_rate").alias("neutral_rate"), r6("contradiction_rate").alias("contradiction_rate"), "gate_failed")


HALLUCINATION = s.with_(*BASE, CITED) + f"""SELECT eval_id, round(1 - e, 6) AS score, CASE WHEN gate THEN 'R' ELSE {band_sql('e')} END AS band, round(n, 6) AS neutral_rate, round(c, 6) AS contradiction_rate, CAST(gate AS DOUBLE) AS gate_failed
FROM (SELECT eval_id, count(*) FILTER (label = 'E') / CAST(count(*) AS DOUBLE) AS e, count(*) FILTER (label = 'N') / CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (label = 'C') / CAST(count(*) AS DOUBLE) AS c FROM labels GROUP BY eval_id)
JOIN (SELECT eval_id, coalesce(bool_or(citation = 'fabricated-99'), false) AS gate FROM cited GROUP BY eval_id) USING (eval_id)"""


def _checks_sql(claim: str, n_docs: str, supported: str) -> str:
    place = "lower(coalesce(domain, '') || ' ' || coalesce(author, ''))"
    names = f"regexp_extract_all({claim}, {s.q(rf'(^|{t.EDGE})([A-Z][a-zA-Z0-9]+)')}, 2)"
    marks = " OR ".join(f"contains(lower(url), '{m}')" for m in c.MISSING_MARKS)
    allowed, denied = ", ".join(map(s.q, c.ALLOWED)), ", ".join(map(s.q, c.DENIED))
    disinterested = (
        f"coalesce(CASE WHEN coalesce(domain IN ({', '.join(map(s.q, c.COI_DOMAINS))}), false) OR coalesce(author IN ({', '.join(map(s.q, c.COI_AUTHORS))}), false) THEN false "
        f"WHEN len(list_filter({names}, lambda x: length(x) > 2 AND contains({place}, lower(x)))) > 0 THEN false WHEN coalesce(domain, '') = '' AND coalesce(author, '') = '' THEN true END, true)"
    )
    checks = [
        f"(url IS NULL AND domain IS NULL) OR coalesce(NOT ({marks}), false)", "(url IS NULL AND domain IS NULL) OR coalesce(date <= '2026-07-31', false)", "(url IS NULL AND domain IS NULL) OR coalesce(author, '') <> ''",
        f"CASE WHEN domain IS NULL THEN true WHEN domain IN ({denied}) THEN false ELSE domain IN ({allowed}) END", f"{n_docs} >= 2", supported, disinterested,
    ]
    return "(" + " + ".join(f"CAST(({x}) AS INT)" for x in checks) + ") / 7.0"


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dim.source_quality(src.chunks(spark, sf_dir), labels_of(spark, sf_dir), src.conversations(spark, sf_dir))
    return rows.select("eval_id", "adequate_sources", "total_sources", r6("score").alias("score"), "band")


SOURCE_QUALITY = s.with_(
    *BASE, "ans AS (SELECT eval_id, count(DISTINCT d) AS n_docs FROM (SELECT eval_id, unnest(docs) AS d FROM labels) GROUP BY eval_id)",
    f"sq AS (SELECT chunks.eval_id, {_checks_sql('answer', 'coalesce(n_docs, 0)', 'coalesce(n_docs, 0) > 0')} >= 0.6 AS ok FROM chunks JOIN ev USING (eval_id) LEFT JOIN ans USING (eval_id))",
    "sg AS (SELECT eval_id, count(*) FILTER (ok) AS adequate_sources, count(*) AS total_sources FROM sq GROUP BY eval_id)",
) + f"SELECT *, round(adequate_sources / CAST(total_sources AS DOUBLE), 6) AS score, {band_sql('adequate_sources / CAST(total_sources AS DOUBLE)')} AS band FROM sg"


def sets_of(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None, supports: DataFrame | None = None) -> DataFrame:
    claims = kept_claims(spark, sf_dir) if claims is None else claims
    supports = support.claim_support(labels_of(spark, sf_dir, claims)) if supports is None else supports
    return dim.cited_sets(cited_claims(spark, sf_dir, claims), supports)


SETS = """
scoped AS (SELECT *, last_value(CASE WHEN len(explicit) > 0 THEN explicit END IGNORE NULLS) OVER (PARTITION BY eval_id ORDER BY sent_ord, clause_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope FROM cited),
sets0 AS (SELECT scoped.*, grounded, confidence, coalesce(chunks, []) AS chunks, coalesce(docs, []) AS docs FROM scoped LEFT JOIN sup USING (eval_id, claim_id)),
sets AS (SELECT *, list_distinct(list_concat(CASE WHEN len(explicit) > 0 THEN explicit ELSE list_intersect(coalesce(scope, []), chunks) END, CASE WHEN own IS NOT NULL THEN [own] ELSE [] END)) AS cited FROM sets0)"""


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dim.attribution(sets_of(spark, sf_dir))
    return rows.select("eval_id", "cited_claims", "mis_cited", "uncited_supported", "excluded_no_citation", r6("score").alias("citation_precision"), "band", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_LOW, _HIGH = wilson_sql("held", "cited_claims")
_PRECISION = "coalesce(held / CAST(nullif(cited_claims, 0) AS DOUBLE), 0.0)"
ATTRIBUTION = s.with_(
    *BASE, CITED, SETS,
    """ag AS (SELECT eval_id, count(*) FILTER (len(cited) > 0) AS cited_claims, count(*) FILTER (list_has_any(cited, chunks)) AS held,
  count(*) FILTER (len(cited) > 0 AND NOT list_has_any(cited, chunks)) AS mis_cited, count(*) FILTER (len(cited) = 0 AND len(chunks) > 0) AS uncited_supported, count(*) FILTER (len(cited) = 0) AS excluded_no_citation FROM sets GROUP BY eval_id)""",
) + f"SELECT * EXCLUDE (held), round({_PRECISION}, 6) AS citation_precision, {band_sql(_PRECISION)} AS band, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM ag"


def alce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation recall and precision over all evaluations."""
    sets = sets_of(spark, sf_dir).where(F.size("cited") > 0)
    held = F.array_intersect("cited", "chunks")
    return sets.agg(F.count("*").alias("claims"), r6(F.avg((F.size(held) > 0).cast("int"))).alias("recall"), r6(F.sum(F.size(held)) / F.sum(F.size("cited"))).alias("precision"))


ALCE = s.with_(*BASE, CITED, SETS) + """SELECT count(*) AS claims, round(avg(CAST(list_has_any(cited, chunks) AS INT)), 6) AS recall, round(sum(len(list_intersect(cited, chunks))) / CAST(sum(len(cited)) AS DOUBLE), 6) AS precision
FROM sets WHERE len(cited) > 0"""


def axioms_of(spark: SparkSession, sf_dir: str, claims: DataFrame | None = None, supports: DataFrame | None = None) -> DataFrame:
    return dim.axioms(graph.shared_checkpoint(sets_of(spark, sf_dir, claims, supports)), src.chunks(spark, sf_dir))  # the sets are read for their numbers, too


def source_adequate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axioms_of(spark, sf_dir).groupBy("eval_id").agg(F.count_if("adequate").alias("adequate"), F.count_if("attributed").alias("attributed"), F.count("*").alias("n"))


#: No claim of the conversations holds a digit, so the numeric check never decides there; tests cover it.
AXIOMS = f"""
ax0 AS (SELECT sets.*, url, domain, date, author, c2.chunk_id IS NOT NULL AS placed FROM sets LEFT JOIN chunks c2 ON c2.eval_id = sets.eval_id AND c2.chunk_id = sets.own),
ax1 AS (SELECT *, CASE WHEN placed THEN {_checks_sql('text', 'len(docs)', 'len(chunks) > 0')} >= 0.6 ELSE true END AS adequate,
  CASE WHEN len(cited) > 0 THEN list_has_any(cited, chunks) AND coalesce(confidence, 0.0) >= 0.5 ELSE true END AS attributed FROM ax0),
ax AS (SELECT *, coalesce(grounded, false) AND adequate AND attributed AS axiom FROM ax1)"""
SOURCE_ADEQUATE = s.with_(*BASE, CITED, SETS, AXIOMS) + "SELECT eval_id, count(*) FILTER (adequate) AS adequate, count(*) FILTER (attributed) AS attributed, count(*) AS n FROM ax GROUP BY eval_id"


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dim.accuracy(axioms_of(spark, sf_dir))
    return rows.select("eval_id", "n", "successful_claims", r6("score").alias("score"), "band", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_LOW, _HIGH = wilson_sql("successful_claims", "n")
ACCURACY = s.with_(
    *BASE, CITED, SETS, AXIOMS, "la AS (SELECT eval_id, claim_id, last(axiom ORDER BY sent_ord, clause_ord) AS axiom, count(*) AS times FROM ax GROUP BY ALL)",
    "an AS (SELECT eval_id, CAST(sum(times) AS BIGINT) AS n, count(*) FILTER (axiom) AS successful_claims FROM la GROUP BY eval_id)",
    "av AS (SELECT eval_id, avg(CAST(v AS INT)) AS x FROM (SELECT eval_id, claim_id, first(axiom ORDER BY sent_ord, clause_ord) AS v FROM ax GROUP BY ALL) GROUP BY eval_id)",
) + f"SELECT eval_id, n, successful_claims, round(x, 6) AS score, {band_sql('x')} AS band, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM an JOIN av USING (eval_id)"


def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: how far the first sentence is covered by the next document; label by quality, stratum by language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = d.select("doc_id", F.col("lang").alias("stratum"), t.tokens(F.coalesce(F.get(t.sentences(F.coalesce("text", F.lit(""))), F.lit(0)), F.lit(""))).alias("a"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), t.tokens(F.coalesce("text", F.lit(""))).alias("b"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("label"))
    return labels.join(own, "doc_id").join(after, "doc_id").select("stratum", F.round(t.coverage(F.col("a"), F.col("b")), 9).alias("confidence"), "label")


POINTS = f"""
pt AS (SELECT d.lang AS stratum, quality = 1 AS label, {s.tokens(f"coalesce({s.sentences('coalesce(d.text, chr(32))')}[1], '')")} AS a, {s.tokens("coalesce(n.text, '')")} AS b
  FROM labels JOIN documents d USING (doc_id) JOIN documents n ON n.doc_id = d.doc_id + 1),
point AS (SELECT stratum, label, round({s.coverage('a', 'b')}, 9) AS confidence FROM pt)"""


def _conformal(strata: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scoring.conformal(calibration_points(spark, sf_dir), strata)
        return rows.select("stratum", *(r6(x).alias(x) for x in ("threshold", "tau_hat", "band_low", "band_high")), "n", "abstained")

    return query


def _conformal_sql(strata: bool) -> str:
    groups = "GROUPING SETS ((), (stratum))" if strata else "GROUPING SETS (())"
    stratum = "stratum" if strata else "CAST(NULL AS VARCHAR) AS stratum"
    return s.with_(POINTS) + f"""SELECT stratum, round(CASE WHEN few THEN 0.0 ELSE 1 - tau END, 6) AS threshold, round(CASE WHEN few THEN 1.0 ELSE tau END, 6) AS tau_hat, 0.95 :: DOUBLE AS band_low,
  round(CASE WHEN few THEN 1.0 ELSE least(1.0, 0.95 + 1.0 / (n + 1)) END, 6) AS band_high, n, few AS abstained
FROM (SELECT stratum, n, n < 6 AS few, v[CAST(least(ceil(0.95 * (n + 1)), n) AS BIGINT)] AS tau FROM
  (SELECT {stratum}, count(*) FILTER (label) AS n, list_sort(list(1 - confidence) FILTER (label)) AS v FROM point GROUP BY {groups}))"""


def conformal_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groundedness with the calibrated threshold stamped onto every row: a join with one row."""
    stamp = scoring.conformal(calibration_points(spark, sf_dir)).select(r6("threshold").alias("conformal_threshold"), r6("band_high").alias("conformal_high"))
    return groundedness(spark, sf_dir).select("eval_id", "score").crossJoin(F.broadcast(stamp))


STAMP = f"SELECT eval_id, score, threshold AS conformal_threshold, band_high AS conformal_high FROM ({GROUNDEDNESS}), ({_conformal_sql(False)})"

QUERIES = {
    "prefilter_topk": prefilter_topk, "support_set": support_set, "claim_grounded": claim_grounded, "nli_label_rates": nli_label_rates, "groundedness": groundedness, "fabrication": fabrication,
    "hallucination": hallucination, "source_quality": source_quality, "attribution": attribution, "alce": alce, "source_adequate": source_adequate, "accuracy": accuracy,
    "conformal_global": _conformal(False), "conformal_strata": _conformal(True), "conformal_stamp": conformal_stamp,
}
SQL = {
    "prefilter_topk": PREFILTER, "support_set": SUPPORT_SET, "claim_grounded": CLAIM_GROUNDED, "nli_label_rates": RATES, "groundedness": GROUNDEDNESS, "fabrication": FABRICATION,
    "hallucination": HALLUCINATION, "source_quality": SOURCE_QUALITY, "attribution": ATTRIBUTION, "alce": ALCE, "source_adequate": SOURCE_ADEQUATE, "accuracy": ACCURACY,
    "conformal_global": _conformal_sql(False), "conformal_strata": _conformal_sql(True), "conformal_stamp": STAMP,
}
