"""Segmentation, routing, claims, triplets, numbers and question forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.functions import text as t
from gaugeleaf.operators import pipeline
from gaugeleaf.plans import sql as s
from gaugeleaf.sources import evaluations as src

#: Short texts for the corners of the text functions.
TEXTS = (
    "Revenue rose 12 percent [chunk-1].", "It may rain and it might snow; or not.", "Credits include a film starring [a celebrity].", "$1.2B and 1,200 units", "12 margins",
    "5 the", "3 books", "40 for", "2010-2015", "no digits here", "They won the champions cup final.", "Which of the options is better???", "what", "Real Madrid won the final in 2024.",
    "It happened here.", "Margins therefore improved.", "The man who left said that rain and snow fell, often", "Costs fell 1.5 million but revenue rose whereas margins held", "", "why",
)


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, x string")


_TEXTS_SQL = "x AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {s.q(x)})" for i, x in enumerate(TEXTS)) + ") AS v(id, x))"


def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", F.posexplode(t.sentences(F.coalesce("text", F.lit("")))).alias("sent_ord", "sentence"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"), F.min_by("sentence", "sent_ord").alias("first"), F.max_by("sentence", "sent_ord").alias("last"))


SEGMENT = f"""WITH d AS (SELECT doc_id, {s.sentences("coalesce(text, '')")} AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars, s[1] AS first, s[-1] AS last FROM d WHERE len(s) > 0"""


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.spans(src.conversations(spark, sf_dir)).select("eval_id", F.col("sent_ord").cast("long").alias("sent_ord"), F.posexplode(t.clauses(F.col("sentence"))).alias("clause_ord", "clause"))
    return rows.withColumn("clause_ord", F.col("clause_ord").cast("long"))


CLAUSES = s.with_(s.EV, s.SPANS) + f"SELECT eval_id, sent_ord, unnest(range(0, len({s.clauses('sentence')}))) AS clause_ord, unnest({s.clauses('sentence')}) AS clause FROM span"


def span_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("verifiable") & ~F.col("abstractive")
    return pipeline.spans(src.conversations(spark, sf_dir)).groupBy("eval_id").agg(F.count_if(kept).alias("kept"), F.count_if(~F.col("verifiable")).alias("routed"), F.count_if("abstractive").alias("flagged"))


SPAN_ROUTE = s.with_(s.EV, s.SPANS) + "SELECT eval_id, count(*) FILTER (verifiable AND NOT abstractive) AS kept, count(*) FILTER (NOT verifiable) AS routed, count(*) FILTER (abstractive) AS flagged FROM span GROUP BY eval_id"


def claims_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.claims(src.conversations(spark, sf_dir), src.chunks(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda n: F.col(n).cast("long").alias(n)
    return claims_of(spark, sf_dir).select("eval_id", long("sent_ord"), long("clause_ord"), "claim_id", "text", "source_sentence", "decontextualized", "citation")


CLAIMS = s.with_(s.EV, s.CHUNKS, s.SPANS, s.CLAIMS) + "SELECT * FROM claims"


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda n: F.col(n).cast("long").alias(n)
    rows = pipeline.triplets(claims_of(spark, sf_dir))
    return rows.select("eval_id", long("sent_ord"), long("clause_ord"), long("trip_ord"), "claim_id", "subject", "predicate", "obj", "text", "triplet_id")


TRIPLETS = s.with_(s.EV, s.CHUNKS, s.SPANS, s.CLAIMS, s.TRIPLETS) + "SELECT eval_id, sent_ord, clause_ord, trip_ord, claim_id, subject, predicate, obj, text, 'triplet:' || substr(sha256(claim_id || '|' || text), 1, 12) AS triplet_id FROM triplets"


def coref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims_of(spark, sf_dir)
    return rows.where(F.col("text") != F.col("source_sentence")).select("eval_id", "source_sentence", "text", "decontextualized")


COREF = s.with_(s.EV, s.CHUNKS, s.SPANS, s.CLAIMS) + "SELECT eval_id, source_sentence, text, decontextualized FROM claims WHERE text <> source_sentence"


def ask_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.conversations(spark, sf_dir).select("eval_id", F.col("question").alias("x")).unionByName(_texts(spark).select((F.col("id") - 1000).cast("long").alias("eval_id"), "x"))
    return rows.select("eval_id", t.ask_hypothesis(F.col("x")).alias("hypothesis"))


_BARE = s.strip(rf"regexp_replace({s.strip('x')}, '\?+$', '')")
_PARTS = rf"string_split_regex({_BARE}, '\s+')"
ASK_HYP = s.with_(
    s.EV, _TEXTS_SQL, "a AS (SELECT eval_id, question AS x FROM ev UNION ALL SELECT id - 1000, x FROM x)", f"b AS (SELECT eval_id, x, {_PARTS} AS p FROM a)",
    f"r AS (SELECT eval_id, x, CASE WHEN list_contains({s.listed(c.LEADING_ASK)}, lower(p[1])) THEN array_to_string(p[2:], ' ') ELSE array_to_string(p, ' ') END AS h FROM b)",
) + "SELECT CAST(eval_id AS BIGINT) AS eval_id, CASE WHEN h = '' THEN x ELSE h END AS hypothesis FROM r"


def sentences_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (doc_id * 100,000 + place) and x: every sentence of every document, and the cases."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(t.sentences(F.coalesce("text", F.lit("")))).alias("place", "x"))
    return d.select((F.col("doc_id") * 100_000 + F.col("place")).alias("id"), "x").unionByName(_texts(spark).select((F.col("id") - 1000).cast("long").alias("id"), "x"))


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say of each sentence of the documents."""
    x = F.col("x")
    return sentences_of(spark, sf_dir).select(
        "id", t.is_verifiable(x).alias("verifiable"), t.is_abstractive(x).alias("abstractive"), t.has_leading_pronoun(x).alias("pronoun"), t.is_indexical(x).alias("indexical"),
        t.has_discourse_marker(x).alias("marker"), t.is_atomic(x).alias("atomic"), F.round(t.first_number(x), 3).alias("number"), t.citation(x).alias("citation"),
        t.word_count(x).cast("long").alias("words"),
    )


_NUM = s.q(rf"(?s)^(.*?)({t.NUMBER})(.*)$")
_TAIL = f"lower({s.strip(f'regexp_extract(x, {_NUM}, 3)')})"
PREDICATES = s.with_(
    _TEXTS_SQL.replace("x AS (", "cases AS (", 1), f"sd AS (SELECT doc_id, {s.sentences('coalesce(text, chr(32))')} AS z FROM documents)",
    "x AS (SELECT doc_id * 100000 + unnest(range(len(z))) AS id, unnest(z) AS x FROM sd UNION ALL SELECT id - 1000, x FROM cases)",
) + rf"""
SELECT id, NOT {s.rlike('x', t.HEDGE)} AS verifiable, {s.rlike('x', r'\[[^\]]*\s[^\]]*\]')} AS abstractive, {s.rlike('x', t.LEADING)} AS pronoun,
  {s.rlike('x', t.LEADING)} OR {s.rlike('x', t.DEICTIC)} AS indexical, {s.rlike('x', t.MARKER)} AS marker, NOT ({s.rlike('x', t.SPLIT_WORDS)} OR contains(x, ';')) AS atomic,
  round(TRY_CAST(replace(regexp_extract(x, {_NUM}, 2), ',', '') AS DOUBLE) * CASE WHEN {_TAIL} LIKE 'k%' OR {_TAIL} LIKE 'thousand%' THEN 1e3 WHEN {_TAIL} LIKE 'm%' THEN 1e6
    WHEN {_TAIL} LIKE 'b%' THEN 1e9 WHEN {_TAIL} LIKE 't%' THEN 1e12 ELSE 1.0 END, 3) AS number,
  nullif(regexp_extract(x, '\[([^\]]+)\]', 1), '') AS citation, CAST(CASE WHEN {s.strip('x')} = '' THEN 0 ELSE len(string_split_regex({s.strip('x')}, '\s+')) END AS BIGINT) AS words FROM x"""


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each answer in three runs; the runs after the first lose every sentence whose place is divisible by run + 1."""
    rows = claims_of(spark, sf_dir).select("eval_id", "sent_ord", F.col("claim_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run"))
    rows = rows.where((F.col("run") == 0) | (F.col("sent_ord") % (F.col("run") + 1) != 0))
    return pipeline.stability(rows).select("eval_id", F.round("stability", 6).alias("stability"))


STABILITY = s.with_(s.EV, s.CHUNKS, s.SPANS, s.CLAIMS) + """, r AS (SELECT eval_id, claim_id AS id, run FROM claims, (VALUES (0), (1), (2)) v(run) WHERE run = 0 OR sent_ord % (run + 1) <> 0),
i AS (SELECT eval_id, id, count(DISTINCT run) AS held FROM r GROUP BY ALL), n AS (SELECT eval_id, count(DISTINCT run) AS runs FROM r GROUP BY eval_id)
SELECT eval_id, round(count(*) FILTER (held = runs) / CAST(count(*) AS DOUBLE), 6) AS stability FROM i JOIN n USING (eval_id) GROUP BY eval_id"""

QUERIES = {
    "segment": segment, "clauses": clauses, "span_route": span_route, "claims": claims, "triplets": triplets, "coref": coref, "ask_hyp": ask_hyp, "predicates": predicates, "stability": stability,
}
SQL = {
    "segment": SEGMENT, "clauses": CLAUSES, "span_route": SPAN_ROUTE, "claims": CLAIMS, "triplets": TRIPLETS, "coref": COREF, "ask_hyp": ASK_HYP, "predicates": PREDICATES, "stability": STABILITY,
}
