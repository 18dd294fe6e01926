"""What holds claims up and what errors they carry, cycles, contradictions, calibration, spans, and the keyed log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeleaf.config import NEGATION
from gaugeleaf.functions import scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators import graph, reasoning
from gaugeleaf.operators import spans as wide
from gaugeleaf.plans import sql as s
from gaugeleaf.plans.atom_queries import KEYS, ORDER, ROLE, WEIGHT
from gaugeleaf.plans.atom_queries import SQL as ATOM_SQL
from gaugeleaf.plans.graph_queries import EVENTS, LINKS, event_graph
from gaugeleaf.plans.support_queries import POINTS, calibration_points, r6, wilson_sql
from gaugeleaf.plans.text_queries import claims_of
from gaugeleaf.sources import atom_log as log
from gaugeleaf.streaming import atom_stream


# ---- cycles


def edge_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of users' event graphs after each tenth event has linked back to the third before it, and cycles were cut."""
    nodes, links = event_graph(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("eval_id"), F.col("event_id").alias("node"), "ts")
    w = Window.partitionBy("eval_id").orderBy("ts", "node")
    e = e.withColumn("ord", F.row_number().over(w)).withColumn("dst", F.lag("node", 3).over(w))
    back = e.where("node % 10 = 3 and dst is not null").select("eval_id", F.col("node").alias("src"), "dst")
    return graph.cut_cycles(links.unionByName(back), e.select("eval_id", "node", "ord"))


EDGE_CYCLES = s.with_(EVENTS) + """, b AS (SELECT * FROM (SELECT user_id AS eval_id, event_id AS src, lag(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE src % 10 = 3 AND dst IS NOT NULL)
SELECT * FROM b UNION ALL SELECT * FROM l WHERE (eval_id, src) NOT IN (SELECT (eval_id, dst) FROM b)"""


# ---- sufficiency


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the premises of each answer's claims hold them up."""
    return reasoning.sufficiency(graph.premise_sets(graph.ordered(claims_of(spark, sf_dir))))


_NEG = s.listed(NEGATION)
_TEST = lambda covered, against: f"(CASE WHEN len(tk) = 0 THEN 0.0 ELSE ({covered}) / CAST(len(tk) AS DOUBLE) END >= 0.5 AND ({against}) = list_has_any(tk, {_NEG}))"
SUFFICIENCY = s.with_(s.EV, s.CHUNKS, s.SPANS, s.CLAIMS, *LINKS[:2]) + f""",
su AS (SELECT eval_id, ord, claim_id, tk, ps, len(ps) AS n, list_transform(tk, lambda x: list_filter(range(len(ps)), lambda i: list_contains(ps[i + 1].tk, x))) AS held, list_transform(ps, lambda p: list_has_any(p.tk, {_NEG})) AS ag FROM em),
sv AS (SELECT *, len(list_filter(held, lambda h: len(h) > 0)) AS cov, len(list_filter(ag, lambda x: x)) AS n_ag FROM su WHERE {_TEST("len(list_filter(held, lambda h: len(h) > 0))", "list_contains(ag, true)")}),
sw AS (SELECT *, len(list_filter(range(n), lambda i: {_TEST("len(list_filter(held, lambda h: list_contains(h, i)))", "ag[i + 1]")})) AS alone,
  CASE WHEN n = 1 THEN 1 ELSE len(list_filter(range(n), lambda i: NOT {_TEST("cov - len(list_filter(held, lambda h: len(h) = 1 AND h[1] = i))", "n_ag - CAST(ag[i + 1] AS INT) > 0")})) END AS load_bearing,
  CASE WHEN n BETWEEN 2 AND 6 THEN list_transform(range(1, CAST(pow(2, n) AS BIGINT)), lambda z: {{'k': bit_count(z), 'ok': {_TEST("len(list_filter(held, lambda h: len(list_filter(h, lambda i: (z >> CAST(i AS INT)) % 2 = 1)) > 0))", "len(list_filter(range(n), lambda i: ag[i + 1] AND (z >> CAST(i AS INT)) % 2 = 1)) > 0")}}}) END AS tried FROM sv),
sx AS (SELECT *, list_filter(range(2, n + 1), lambda k: len(list_filter(tried, lambda x: (x.k = k AND NOT x.ok) OR (x.k = k - 1 AND x.ok))) = 0)[1] AS least FROM sw),
sy AS (SELECT *, CASE WHEN load_bearing = n AND (alone = 0 OR n = 1) THEN 'AND' WHEN alone > 1 THEN 'OR' WHEN least < n THEN 'k-of-n' ELSE 'uncertain' END AS condition FROM sx)
SELECT eval_id, ord, claim_id, CAST(n AS INT) AS premises, CAST(alone AS INT) AS alone, CAST(load_bearing AS INT) AS load_bearing, condition, CAST(CASE condition WHEN 'OR' THEN 1 WHEN 'k-of-n' THEN least ELSE n END AS INT) AS k FROM sy"""


# ---- values and errors


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event graphs whose every fourth event or so is derived. How often a kind of event is wrong is measured, of errors never."""
    _, links = event_graph(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rates = reasoning.error_rates(e.where("event_type <> 'error'").select(F.col("event_type").alias("kind"), (F.col("value") > 2).alias("right")))
    nodes = e.join(F.broadcast(rates), e["event_type"] == rates["kind"], "left").select(  # a row for each event type
        F.col("user_id").alias("eval_id"), F.col("event_id").alias("node"), F.expr("CASE WHEN event_id * 7 % 4 <> 0 THEN (event_id * 37 % 100) / 100.0D END").alias("truth"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 0.5D ELSE 1.0D END").alias("ratio"), F.expr("CASE WHEN event_id % 5 < 3 THEN 1 END").alias("k"), "error",
    )
    return reasoning.node_values(nodes, links)


def node_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir)
    return rows.select("eval_id", "node", *(r6(x).alias(x) for x in ("value", "ratio", "factor", "error")), "limiting", "dominant", "covered", "committed", F.col("layer").cast("long").alias("layer"))


_, _HIGH = wilson_sql("wrong", "n")
#: One event after the other: a derived event's premises are the one before it and, if its number is divisible by 3, the second before.
_VALUES = s.with_(EVENTS.strip()).replace("WITH", "WITH RECURSIVE", 1).rstrip() + f""",
rates AS (SELECT kind, {_HIGH} AS error FROM (SELECT event_type AS kind, count(*) AS n, count(*) FILTER (NOT value > 2) AS wrong FROM events WHERE event_type <> 'error' GROUP BY 1) WHERE n >= 30),
nd AS MATERIALIZED (SELECT user_id AS eval_id, event_id AS node, CASE WHEN event_id * 7 % 4 <> 0 THEN (event_id * 37 % 100) / 100.0 :: DOUBLE END AS truth, CASE event_id % 3 WHEN 0 THEN 0.5 :: DOUBLE ELSE 1.0 :: DOUBLE END AS ratio,
  CASE WHEN event_id % 5 < 3 THEN 1 END AS k, error AS own, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events LEFT JOIN rates ON kind = event_type),
rc(eval_id, i, x, y) AS (
  SELECT DISTINCT eval_id, CAST(0 AS BIGINT), CAST(NULL AS STRUCT(node BIGINT, value DOUBLE, ratio DOUBLE, factor DOUBLE, limiting BIGINT, error DOUBLE, dominant BIGINT, covered BOOLEAN, layer BIGINT)), CAST(NULL AS STRUCT(node BIGINT, value DOUBLE, ratio DOUBLE, factor DOUBLE, limiting BIGINT, error DOUBLE, dominant BIGINT, covered BOOLEAN, layer BIGINT)) FROM nd
  UNION ALL
  SELECT eval_id, i, {{'node': node, 'value': CASE WHEN len(ps) = 0 THEN coalesce(truth, 0) ELSE ratio * m.value END, 'ratio': CASE WHEN truth IS NULL THEN ratio ELSE 1.0 END, 'factor': CASE WHEN len(ps) = 0 THEN coalesce(truth, 0) ELSE m.value END,
    'limiting': m.node, 'error': greatest(coalesce(own, 0), coalesce(w.error, 0)), 'dominant': CASE WHEN own IS NOT NULL AND (w IS NULL OR own >= w.error) THEN node ELSE w.dominant END,
    'covered': own IS NOT NULL AND len(list_filter(used, lambda p: NOT p.covered)) = 0, 'layer': coalesce(list_max(list_transform(ps, lambda p: p.layer)) + 1, 0)}}, x
  FROM (SELECT *, list_sort(list_transform(used, lambda p: {{'value': p.value, 'node': p.node}}))[1] AS m, list_sort(list_transform(list_filter(used, lambda p: p.dominant IS NOT NULL), lambda p: {{'error': p.error, 'dominant': p.dominant}}), 'DESC')[1] AS w
    FROM (SELECT *, CASE WHEN k < len(ps) AND len(list_filter(ps, lambda p: p.value >= 0.5)) >= k THEN list_filter(ps, lambda p: p.value >= 0.5) ELSE ps END AS used
      FROM (SELECT nd.*, rc.x, list_filter(CASE WHEN nd.truth IS NULL THEN [rc.x, CASE WHEN rc.y.node % 3 = 0 THEN rc.y END] ELSE [] END, lambda p: p IS NOT NULL) AS ps FROM rc JOIN nd ON nd.eval_id = rc.eval_id AND nd.i = rc.i + 1)))),
vs AS (SELECT eval_id, x.*, x.value >= 0.5 AS committed FROM rc WHERE i > 0)"""
NODE_VALUE = _VALUES + " SELECT eval_id, node, round(value, 6) AS value, ratio, round(factor, 6) AS factor, round(error, 6) AS error, limiting, dominant, covered, committed, layer FROM vs"


def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that each user's committed events carry, and what may have been missed, apart: errors, and low values after views."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("eval_id"), F.col("event_id").alias("node"), "event_type", "value")
    flag = F.when(F.col("event_type") == "error", "missing_edge").when((F.col("event_type") == "view") & (F.col("value") < 1), "uncertain_frame")
    rows = reasoning.error_profile(_valued(spark, sf_dir), e.select("eval_id", "node", flag.alias("flag")).where("flag is not null"))
    count = lambda f: F.coalesce(F.try_element_at("flags", F.lit(f)), F.lit(0)).alias(f)
    return rows.select("eval_id", "nodes", r6("error").alias("error"), "dominant", "uncovered", count("missing_edge"), count("uncertain_frame"))


ERROR_PROFILE = _VALUES + """, fg AS (SELECT user_id AS eval_id, count(*) FILTER (event_type = 'error') AS missing_edge, count(*) FILTER (event_type = 'view' AND value < 1) AS uncertain_frame FROM events GROUP BY 1),
wo AS (SELECT eval_id, count(*) AS nodes, max({'error': error, 'dominant': dominant}) FILTER (committed AND dominant IS NOT NULL) AS w, count(*) FILTER (NOT coalesce(covered, false)) AS uncovered FROM vs GROUP BY 1)
SELECT eval_id, nodes, round(w.error, 6) AS error, w.dominant AS dominant, uncovered, missing_edge, uncertain_frame FROM wo JOIN fg USING (eval_id)"""


# ---- contradictions


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every conversation; those of one language are told by a negation now and then, as the texts have none."""
    rows = graph.ordered(claims_of(spark, sf_dir))
    return rows.withColumn("text", F.when(F.col("ord") % 5 == 3, F.concat(F.lit("not "), "text")).otherwise(F.col("text")))


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each conversation's claims agree, after some are repeated with a "not"."""
    once, again = F.struct("ord", "text"), F.struct((F.col("ord") + 100_000).alias("ord"), F.concat(F.lit("not "), "text").alias("text"))
    rows = _claims(spark, sf_dir).select("eval_id", F.inline(F.when(F.col("ord") % 7 == 2, F.array(once, again)).otherwise(F.array(once))))
    rows = graph.shared_checkpoint(rows)
    return reasoning.consistency(rows, reasoning.contradictions(rows))


CONTRADICTIONS = s.with_(
    s.EV, s.CHUNKS, s.SPANS, s.CLAIMS, "co AS (SELECT eval_id, row_number() OVER (PARTITION BY eval_id ORDER BY sent_ord, clause_ord) - 1 AS ord, text FROM claims)",
    "cp AS (SELECT eval_id, ord, CASE WHEN ord % 5 = 3 THEN 'not ' || text ELSE text END AS text FROM co)",
    f"cq AS MATERIALIZED (SELECT eval_id, ord, {s.tokens('text')} AS tk FROM (SELECT * FROM cp UNION ALL SELECT eval_id, ord + 100000, 'not ' || text FROM cp WHERE ord % 7 = 2))",
    f"cr AS (SELECT a.eval_id, least(a.ord, b.ord) AS x, greatest(a.ord, b.ord) AS y FROM cq a JOIN cq b ON a.eval_id = b.eval_id AND a.ord <> b.ord WHERE {s.label(s.coverage('a.tk', 'b.tk'), 'b.tk', 'a.tk')} = 'C' GROUP BY ALL)",
) + """SELECT eval_id, claims, coalesce(contradictions, 0) AS contradictions, coalesce(contradicting, 0) AS contradicting, CASE WHEN contradictions > 0 THEN 0.0 ELSE 1.0 END :: DOUBLE AS score, contradictions IS NULL AS passed
FROM (SELECT eval_id, count(*) AS claims FROM cq GROUP BY 1) LEFT JOIN (SELECT eval_id, count(*) AS contradictions FROM cr GROUP BY 1) USING (eval_id)
LEFT JOIN (SELECT eval_id, count(DISTINCT ord) AS contradicting FROM (SELECT eval_id, unnest([x, y]) AS ord FROM cr) GROUP BY 1) USING (eval_id)"""  # fmt: skip


# ---- calibration


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the confidences of labelled documents are calibrated, by language and over all."""
    rows = scoring.calibration_error(scoring.reliability(calibration_points(spark, sf_dir)))
    return rows.select("stratum", "n", "bins", "used", r6("ece").alias("ece"), r6("mce").alias("mce"), "abstained")


_BINS = "rb AS (SELECT stratum, bin, count(*) AS n, avg(CAST(label AS INT)) AS acc, avg(confidence) AS conf FROM (SELECT *, CAST(least(floor(confidence * 10), 9) AS INT) AS bin FROM point WHERE label IS NOT NULL) GROUP BY GROUPING SETS ((stratum, bin), (bin)))"
ECE = s.with_(POINTS, _BINS) + "SELECT stratum, CAST(sum(n) AS BIGINT) AS n, 10 :: BIGINT AS bins, count(*) AS used, round(sum(abs(acc - conf) * n) / sum(n), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce, false AS abstained FROM rb GROUP BY stratum"


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.reliability(calibration_points(spark, sf_dir))
    return rows.select("stratum", "bin", "n", r6("accuracy").alias("accuracy"), r6("confidence").alias("confidence"))


RELIABILITY = s.with_(POINTS, _BINS) + """SELECT e.stratum, e.bin, coalesce(n, 0) AS n, round(acc, 6) AS accuracy, round(conf, 6) AS confidence
FROM (SELECT stratum, CAST(unnest(range(10)) AS INT) AS bin FROM (SELECT DISTINCT stratum FROM rb)) e LEFT JOIN rb ON rb.stratum IS NOT DISTINCT FROM e.stratum AND rb.bin = e.bin"""


# ---- spans


def clause_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words, from and to, that no other contains: sentences, clauses, and bridges from one sentence's last clause to the next one's first."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(t.sentences(F.coalesce("text", F.lit("")))).alias("sent", "sentence"))
    sizes = F.transform(t.clauses(F.col("sentence")), lambda x: F.greatest(F.size(F.split(x, r"\s+")), F.lit(1)).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = d.select("doc_id", "sent", sizes.alias("sizes")).withColumn("words", total(F.col("sizes")))
    # Sizes are a twentieth of the spans that they become, which Spark can't see when it puts small partitions together.
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * d.rdd.getNumPartitions()), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("sent")
    rows = rows.withColumn("a", F.sum("words").over(w) - F.col("words")).withColumn("after", F.lead(F.get("sizes", F.lit(0))).over(w))
    end = F.col("a") + F.col("words")
    clause = F.transform("sizes", lambda n, i: F.struct((F.col("a") + total(F.slice("sizes", F.lit(1), i))).alias("start"), (F.col("a") + total(F.slice("sizes", F.lit(1), i + 1)) - 1).alias("end"), F.lit("clause").alias("kind")))
    one = lambda start, end, kind: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
    bridge = F.when(F.col("after").isNotNull(), F.array(one(end - F.element_at("sizes", -1), end + F.col("after") - 1, "bridge"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"))
    found = rows.select("doc_id", F.explode(F.concat(F.array(one(F.col("a"), end - 1, "sentence")), clause, bridge)).alias("s")).select("doc_id", "s.*")
    return wide.widest(found, ["doc_id"])


CLAUSE_SPANS = s.with_(
    f"se0 AS (SELECT row_number() OVER () AS k, doc_id, {s.sentences('coalesce(text, chr(32))')} AS x FROM documents), se AS (SELECT k, doc_id, unnest(range(len(x))) AS sent, unnest(x) AS sentence FROM se0)",
    rf"sz AS (SELECT k, doc_id, sent, list_transform({s.clauses('sentence')}, lambda c: greatest(len(string_split_regex(c, '\s+')), 1)) AS sizes FROM se)",
    "sa AS (SELECT *, list_sum(sizes) :: BIGINT AS words, lead(sizes[1]) OVER (PARTITION BY doc_id ORDER BY sent) AS after, (sum(list_sum(sizes)) OVER (PARTITION BY doc_id ORDER BY sent) - list_sum(sizes)) :: BIGINT AS a FROM sz)",
    "sp AS MATERIALIZED (SELECT doc_id, a AS s, a + words - 1 AS e, 'sentence' AS kind FROM sa UNION ALL SELECT doc_id, a + words - sizes[-1], a + words + after - 1, 'bridge' FROM sa WHERE after IS NOT NULL"
    " UNION ALL SELECT doc_id, a + coalesce(list_sum(sizes[1:i]), 0) :: BIGINT, a + list_sum(sizes[1:i + 1]) :: BIGINT - 1, 'clause' FROM (SELECT doc_id, a, sizes, unnest(range(len(sizes))) AS i FROM sa))",
    "one AS (SELECT doc_id, s, e, any_value(kind) AS kind, count(*) AS n FROM sp GROUP BY doc_id, s, e)",
) + """SELECT doc_id, s AS "start", e AS "end", kind FROM one WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM one o WHERE o.doc_id = one.doc_id AND o.s <= one.s AND o.e >= one.e AND (o.s <> one.s OR o.e <> one.e))"""


# ---- the keyed log

_ATOM = "eval_id long, dimension string, seq long, atom_id string, verdict boolean, weight double"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long")
    return li.select(F.col("l_orderkey").alias("eval_id"), F.concat(F.lit("line-"), "l_linestatus").alias("dimension"), at.alias("seq"), F.concat("l_orderkey", F.lit("-"), at).alias("atom_id"), (F.col("l_returnflag") != "R").alias("verdict"), F.col("l_quantity").alias("weight"))


def atom_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as atoms, every third one again with the other verdict, folded, some written once more, read in order of key."""
    path = f"{graph.shared_folder(spark)}/atom-log-{uuid.uuid4().hex}"
    rows = _lines(spark, sf_dir)
    log.write(rows, path)
    log.write(rows.where("seq % 3 = 0").withColumn("verdict", ~F.col("verdict")), path)
    log.fold(spark, path, _ATOM)
    log.vacuum(spark, path)
    log.write(rows.where("seq % 6 = 0").withColumn("weight", F.col("weight") + 0.5), path)
    return log.read(spark, path, _ATOM).select("eval_id", "dimension", "seq", "atom_id", "verdict", "weight")


ATOM_LOG = f"""SELECT eval_id, dimension, seq, atom_id, CASE WHEN seq % 6 = 0 THEN verdict WHEN seq % 3 = 0 THEN NOT verdict ELSE verdict END AS verdict, CASE WHEN seq % 6 = 0 THEN weight + 0.5 ELSE weight END :: DOUBLE AS weight
FROM (SELECT l_orderkey AS eval_id, 'line-' || l_linestatus AS dimension, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS seq, l_orderkey || '-' || seq AS atom_id, l_returnflag <> 'R' AS verdict, l_quantity AS weight FROM lineitem)"""


def stream_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine formulas over lines that arrive as a stream, in an order of chance and a fifth of them twice."""
    path = f"{graph.shared_folder(spark)}/atom-stream-{uuid.uuid4().hex}"
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long"))
    one = lambda name: F.struct(F.lit(name).alias("formula_id"), F.expr(ROLE[name]).alias("role"), F.expr(WEIGHT.get(name, "l_quantity")).cast("double").alias("weight"))
    rows = li.select(  # the lines are put in order once for all formulas; each is one atom that counts for all of them
        F.col("l_orderkey").alias("eval_id"), F.lit("line").alias("dimension"), F.col("seq").cast("string").alias("atom_id"), "seq", F.col("l_partkey").cast("string").alias("subject"),
        (F.col("l_returnflag") != "R").alias("verdict"), F.array(*map(one, KEYS.values())).alias("parts"),
    )
    chance = F.pmod(F.xxhash64("eval_id", "seq"), F.lit(15))
    for batch in range(3):
        rows.where((chance % 3 == batch) | ((chance < 3) & (chance == (batch + 2) % 3))).write.parquet(f"{path}/in/batch={batch}")
    files = len(spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/in").inputFiles())
    stream = spark.readStream.schema(atom_stream.KEPT).option("maxFilesPerTrigger", -(-files // 3)).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    atom_stream.keep_scores(stream, f"{path}/states", f"{path}/checkpoint").awaitTermination()
    return atom_stream.kept_scores(spark, f"{path}/states").select("eval_id", "formula_id", F.round("score", 6).alias("score"))


STREAM_FORMULAS = s.union(*(f"SELECT eval_id, '{name}' AS formula_id, score FROM ({ATOM_SQL[key]})" for key, name in KEYS.items()))

QUERIES = {
    "edge_cycles": edge_cycles, "sufficiency": sufficiency, "node_value": node_value, "error_profile": error_profile, "contradictions": contradictions, "ece": ece, "reliability": reliability,
    "clause_spans": clause_spans, "atom_log": atom_log, "stream_formulas": stream_formulas,
}
SQL = {
    "edge_cycles": EDGE_CYCLES, "sufficiency": SUFFICIENCY, "node_value": NODE_VALUE, "error_profile": ERROR_PROFILE, "contradictions": CONTRADICTIONS, "ece": ECE, "reliability": RELIABILITY,
    "clause_spans": CLAUSE_SPANS, "atom_log": ATOM_LOG, "stream_formulas": STREAM_FORMULAS,
}
