"""Question types, requirements, units, completeness, task outcomes and relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.functions import text as t
from gaugeleaf.operators import graph, tasks
from gaugeleaf.plans import sql as s
from gaugeleaf.plans.support_queries import band_sql, r6, wilson_sql
from gaugeleaf.plans.text_queries import claims_of
from gaugeleaf.sources import evaluations as src

#: Questions that fall into each type, with the answers of some cases.
QUESTIONS = (
    ("What were the key drivers of the revenue decline?", "Cost drivers behind the change were freight and wages."), ("Fix this broken function.", "def f(): return 1 # this runs because the root cause is gone"),
    ("Compare bonds versus stocks.", "Overall I prefer bonds."), ("Write a draft memo.", "- point one"), ("Summarize the report.", "Revenue rose."),
    ("Which option is the best option, should I switch?", "I would recommend option A; however there is an alternative."), ("Extract all dates.", "- 2024-01-01"),
    ("How do I bake bread?", "This cannot be done because dividing by zero is impossible."), ("Name the members for me", "A and B"), ("Explain why the sky is blue.", "The mechanism and why it happens: scattering."), ("", ""),
)


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, *x) for i, x in enumerate(QUESTIONS)], "eval_id long, question string, answer string")


def evals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and the fixed questions under negative numbers."""
    return src.conversations(spark, sf_dir).unionByName(_questions(spark))


_VALUES = ", ".join(f"(CAST({-1 - i} AS BIGINT), {s.q(a)}, {s.q(b)})" for i, (a, b) in enumerate(QUESTIONS))
EVALS = f"evals AS (SELECT eval_id, question, answer FROM ev UNION ALL SELECT * FROM (VALUES {_VALUES}) AS v(eval_id, question, answer))"


def _classify_sql(types: dict, default: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower(question), {s.q(w.lower())})" for w in words) + f" THEN {s.q(k)}" for k, (words, *_) in types.items() if words)
    return f"CASE {arms} ELSE {s.q(default)} END"


def _classify(types: dict, default: str):
    return lambda spark, sf_dir: evals_of(spark, sf_dir).select("eval_id", t.classify(F.col("question"), types, default).alias("qtype"))


def _types(types: dict):
    """The requirements of each type, with how many questions fall into it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = tasks.classified(evals_of(spark, sf_dir).select("eval_id", "question"), types, "default").groupBy("qtype").agg(F.count("*").alias("asked"))
        return tasks.requirement_table(spark, types).join(asked, "qtype", "left").fillna(0, ["asked"])

    return query


def _types_sql(types: dict) -> str:
    rows = ", ".join(f"({s.q(k)}, CAST({i} AS INT), {s.q(a)}, {s.q(b)}, {str(v).lower()})" for k, (_, reqs) in types.items() for i, (a, b, v) in enumerate(reqs))
    return f"SELECT * FROM (VALUES {rows}) AS v(qtype, req_ord, req_id, req, vital)"


def _asked_sql(types: dict) -> str:
    return s.with_(s.EV, EVALS, f"qt AS (SELECT {_classify_sql(types, 'default')} AS qtype, count(*) AS n FROM evals GROUP BY 1)") + f"SELECT x.*, coalesce(n, 0) AS asked FROM ({_types_sql(types)}) x LEFT JOIN qt USING (qtype)"


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evals_of(spark, sf_dir)
    rows = tasks.generated(ev).unionByName(tasks.templated(ev, c.REQUIREMENTS)).unionByName(tasks.templated(ev, c.ARCHETYPES))
    return rows.withColumn("req_ord", F.col("req_ord").cast("long"))


_FACETS = s.sentences("'requirement facets a complete answer must cover: ' || question")
GENERATED = f"gen AS (SELECT eval_id, unnest(range(0, len(f))) AS req_ord, unnest(f) AS req FROM (SELECT eval_id, {_FACETS} AS f FROM evals)), reqs AS (SELECT eval_id, req_ord, 'gen-' || req_ord AS req_id, req, true AS vital FROM gen)"
REQUIREMENTS = s.with_(s.EV, EVALS, GENERATED) + f"""SELECT * FROM reqs
UNION ALL SELECT eval_id, req_ord, req_id, req, vital FROM evals JOIN ({_types_sql(c.REQUIREMENTS)}) x ON x.qtype = {_classify_sql(c.REQUIREMENTS, 'default')}
UNION ALL SELECT eval_id, req_ord, req_id, req, vital FROM evals JOIN ({_types_sql(c.ARCHETYPES)}) x ON x.qtype = {_classify_sql(c.ARCHETYPES, 'default')}"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.outcomes(evals_of(spark, sf_dir))
    return rows.select("eval_id", "task_type", "outcome_ord", "outcome_id", "verifier", "weight")


_OUT = ", ".join(
    "(" + ", ".join([s.q(k), str(i), s.q(o[0]), s.q(o[1]), s.q(o[2]), f"CAST({o[3]} AS DOUBLE)"] + [s.listed(o[4].get(p, [])) if o[4].get(p) else "CAST([] AS VARCHAR[])" for p in ("patterns", "signals", "run_claims", "cues")]
    + [s.q(o[4].get("requirement", "")), s.q(o[4].get("signal", "")), str(o[4].get("max_words", 1 << 30))]) + ")" for k, (_, outs) in c.TASKS.items() for i, o in enumerate(outs)
)
OUT = f"outt AS (SELECT * FROM (VALUES {_OUT}) AS v(task_type, outcome_ord, outcome_id, outcome, verifier, weight, patterns, signals, run_claims, cues, requirement, signal, max_words)), oc AS (SELECT * FROM evals JOIN outt ON task_type = {_classify_sql(c.TASKS, c.TASK_DEFAULT)})"
OUTCOMES = s.with_(s.EV, EVALS, OUT) + "SELECT eval_id, task_type, CAST(outcome_ord AS INT) AS outcome_ord, outcome_id, verifier, weight FROM oc"


def task_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.task_success(evals_of(spark, sf_dir), tasks.context_tokens(src.chunks(spark, sf_dir)))
    return rows.select("eval_id", "task_type", "impossible", "achieved", "required", r6("score").alias("score"), "band")


KNOWN = f"known AS (SELECT eval_id, list_distinct(flatten(list({s.tokens('text')}))) AS known FROM chunks GROUP BY eval_id)"
_SOME = "len(list_filter({0}, lambda p: contains(lower(answer), lower(p)))) > 0"
_WORDS = rf"CASE WHEN {s.strip('answer')} = '' THEN 0 ELSE len(string_split_regex({s.strip('answer')}, '\s+')) END"
TASK = s.with_(
    s.EV, s.CHUNKS, EVALS, OUT, KNOWN,
    f"tk AS (SELECT oc.*, known, {s.tokens('answer')} AS said, {s.tokens('question')} AS qt, {s.tokens('requirement')} AS rt, {s.tokens('array_to_string(cues, chr(32))')} AS ct, list_concat({s.tokens('outcome')}, ['reference']) AS ot FROM oc LEFT JOIN known USING (eval_id))",
    f"rawt AS (SELECT *, {s.coverage('rt', 'said')} AS rc, CASE WHEN known IS NULL THEN 0.0 ELSE {s.coverage('said', 'known')} END AS gc FROM tk)",
    f"""okt AS (SELECT *, CASE verifier WHEN 'artifact_presence' THEN {_SOME.format('patterns')} WHEN 'executable' THEN {_SOME.format('signals')} AND {_SOME.format('run_claims')}
  WHEN 'adequacy' THEN {s.coverage('ct', 'list_concat(said, ot)')} >= 0.34 WHEN 'coverage' THEN {s.label('rc', 'said', 'rt')} = 'E' WHEN 'constraint' THEN {_WORDS} <= max_words
  ELSE CASE WHEN signal = 'responsive' THEN {s.jaccard('qt', 'said')} >= 0.5 WHEN known IS NULL THEN true ELSE {s.label('gc', 'known', 'said')} = 'E' END END AS ok,
  ({' OR '.join(f'contains(lower(answer), {s.q(x)})' for x in c.IMPOSSIBLE)}) AND ({' OR '.join(f'contains(lower(answer), {s.q(x)})' for x in c.REASONS)}) AS imp FROM rawt)""",
    "tg AS (SELECT eval_id, task_type, bool_or(imp) AS impossible, CASE WHEN bool_or(imp) THEN 0 ELSE count(*) FILTER (ok) END AS achieved, CASE WHEN bool_or(imp) THEN 0 ELSE count(*) END AS required, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS share FROM okt GROUP BY ALL)",
    "ts AS (SELECT * EXCLUDE (share), CASE WHEN impossible THEN 1.0 ELSE share END AS score FROM tg)",
) + f"SELECT eval_id, task_type, impossible, achieved, required, round(CAST(score AS DOUBLE), 6) AS score, {band_sql('score')} AS band FROM ts"


def admitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requirements, and the units that pass the gate, near-duplicates among them."""
    ev, ch = evals_of(spark, sf_dir), src.chunks(spark, sf_dir)
    reqs = tasks.generated(ev)
    return reqs, tasks.admit(tasks.draft(reqs, tasks.source_sentences(ch)), ev, ch, quoted=True)


def frozen_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reqs, units = admitted(spark, sf_dir)
    return reqs, tasks.dedupe(graph.shared_checkpoint(units))  # read by the fold and by its result


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir)[1].select("eval_id", "unit_id", "req_id", "origin", "supported")


_ORDER = "req_ord, bottom, chunk_ord, sent_ord, part"
UNIT = (
    s.EV, s.CHUNKS, EVALS, GENERATED, s.CSUB, KNOWN,
    f"ss AS (SELECT eval_id, chunk_ord, unnest(range(0, len(z))) AS sent_ord, unnest(z) AS text FROM (SELECT eval_id, chunk_ord, {s.sentences('text')} AS z FROM chunks))",
    f"sst AS MATERIALIZED (SELECT *, {s.tokens('text')} AS tk FROM ss), rqt AS MATERIALIZED (SELECT *, {s.tokens('req')} AS tk FROM reqs)",
    f"""dr AS (SELECT eval_id, req_id, vital, req_ord, 'top_down' AS origin, 0 AS bottom, CAST(0 AS BIGINT) AS chunk_ord, unnest(range(0, len(z))) AS sent_ord, unnest(z) AS text FROM (SELECT *, {s.sentences('req')} AS z FROM reqs)
  UNION ALL SELECT r.eval_id, req_id, vital, req_ord, 'bottom_up', 1, x.chunk_ord, x.sent_ord, x.text FROM rqt r JOIN sst x ON x.eval_id = r.eval_id AND list_has_any(r.tk, x.tk))""",
    f"pt0 AS (SELECT * EXCLUDE (text, z), unnest(range(0, len(z))) AS part, unnest(z) AS raw FROM (SELECT *, {s.clauses('text')} AS z FROM dr))",
    f"pt AS (SELECT pt0.* EXCLUDE (raw), {s.resolve('raw', 'subject')} AS text FROM pt0 LEFT JOIN csub USING (eval_id))",
    f"""ut AS MATERIALIZED (SELECT pt.*, {s.tokens('pt.text')} AS tk FROM pt WHERE NOT {s.rlike('text', t.LEADING_SHORT)}), uj AS (SELECT ut.*, {s.tokens('answer')} AS said, coalesce(known, []) AS known
  FROM ut JOIN evals USING (eval_id) LEFT JOIN known USING (eval_id)), uk AS (SELECT *, list_concat(said, known) AS al FROM uj), ul AS (SELECT *, {s.coverage('tk', 'said')} AS c1, {s.coverage('tk', 'al')} AS c2 FROM uk),
um AS (SELECT *, {s.label('c1', 'said', 'tk')} AS l1, {s.label('c2', 'al', 'tk')} AS l2 FROM ul),
units AS MATERIALIZED (SELECT eval_id, 'unit:' || substr(sha256(req_id || '|' || text), 1, 12) AS unit_id, req_id, vital, origin, text, l1 = 'E' AS supported, {_ORDER} FROM um WHERE l1 = l2
  QUALIFY row_number() OVER (PARTITION BY eval_id, unit_id ORDER BY {_ORDER}) = 1)""",
)
UNITS = s.with_(*UNIT) + "SELECT eval_id, unit_id, req_id, origin, supported FROM units"
#: Units left by the greedy fold, in order.
FROZEN = (
    *UNIT,
    f"dv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY {_ORDER}) AS k, {s.vector('text')} AS v FROM units)",
    """dl AS (SELECT eval_id, list_transform(list({'k': k, 'v': v} ORDER BY k), lambda x: [x]) AS us FROM dv GROUP BY eval_id),
kept AS (SELECT eval_id, unnest(list_reduce(us, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: round(list_cosine_similarity(y.v, x[1].v), 9) >= 0.85)) > 0 THEN acc ELSE list_concat(acc, x) END)).k AS k FROM dl),
frozen AS MATERIALIZED (SELECT dv.* FROM dv JOIN kept USING (eval_id, k))""",
)


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.completeness(*frozen_of(spark, sf_dir))
    return rows.select("eval_id", "vital_units", "total_units", r6("requirement_coverage").alias("requirement_coverage"), r6("weighted_recall").alias("weighted_recall"), r6("score").alias("score"), "band", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "abstained")


_LOW, _HIGH = wilson_sql("held", "vital_units")
_SCORE = "coalesce(held / CAST(nullif(vital_units, 0) AS DOUBLE), 0.0)"
COMPLETENESS = s.with_(
    *FROZEN, "pr AS (SELECT eval_id, req_id, avg(CAST(supported AS INT)) AS recall, bool_or(supported) AS hit FROM frozen GROUP BY ALL)",
    "cv AS (SELECT eval_id, avg(CAST(coalesce(hit, false) AS INT)) AS rc, sum(CASE WHEN vital THEN 2.0 ELSE 1.0 END * coalesce(recall, 0.0)) / sum(CASE WHEN vital THEN 2.0 ELSE 1.0 END) AS wr FROM reqs LEFT JOIN pr USING (eval_id, req_id) GROUP BY eval_id)",
    """nu AS (SELECT eval_id, coalesce(v, 0) AS vital_units, coalesce(a, 0) AS total_units, coalesce(h, 0) AS held, rc, wr FROM cv
  LEFT JOIN (SELECT eval_id, count(*) FILTER (vital) AS v, count(*) AS a, count(*) FILTER (vital AND supported) AS h FROM frozen GROUP BY eval_id) USING (eval_id))""",
) + f"SELECT eval_id, vital_units, total_units, round(rc, 6) AS requirement_coverage, round(wr, 6) AS weighted_recall, round({_SCORE}, 6) AS score, {band_sql(_SCORE)} AS band, {_LOW} AS ci_low, {_HIGH} AS ci_high, vital_units < 10 AS abstained FROM nu"


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frozen_of(spark, sf_dir)[1].select("eval_id", "unit_id", "req_id", "origin")


DEDUPE = s.with_(*FROZEN) + "SELECT eval_id, unit_id, req_id, origin FROM frozen"


def recall_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = spark.createDataFrame(list(c.RECALL_SAMPLE), src.RECALL)
    return tasks.recall_miss(evals_of(spark, sf_dir), frozen_of(spark, sf_dir)[1], sample).select("eval_id", r6("miss_rate").alias("miss_rate"))


RECALL_MISS = s.with_(
    *FROZEN, "sm AS (SELECT * FROM (VALUES " + ", ".join(f"({s.q(a)}, {s.q(b)})" for a, b in c.RECALL_SAMPLE) + ") AS v(m, fact))",
    f"fx AS (SELECT eval_id, fact, {s.tokens('fact', c.TERM_STOP)} AS need FROM evals JOIN sm ON contains(lower(question), lower(m)))",
    f"ht AS (SELECT fx.eval_id, fact, bool_or(coalesce({s.coverage('need', 'have')} >= 0.5, false)) AS hit FROM fx LEFT JOIN (SELECT eval_id, {s.tokens('text', c.TERM_STOP)} AS have FROM frozen) u USING (eval_id) GROUP BY ALL)",
) + "SELECT eval_id, round(avg(CAST(NOT hit AS INT)), 6) AS miss_rate FROM ht GROUP BY eval_id"


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.claim_signals(claims_of(spark, sf_dir), src.conversations(spark, sf_dir))


def on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(spark, sf_dir).groupBy("eval_id").agg(F.count_if("on_topic").alias("on_topic"), F.count_if("on_ask").alias("on_ask"), F.count_if("responsive").alias("responsive"), F.count("*").alias("n"))


_HYP_BARE = s.strip(rf"regexp_replace({s.strip('question')}, '\?+$', '')")
_HYP_PARTS = rf"string_split_regex({_HYP_BARE}, '\s+')"
ASK = f"""ask0 AS (SELECT eval_id, question, answer, {_HYP_PARTS} AS p FROM ev), ask1 AS (SELECT *, CASE WHEN list_contains({s.listed(c.LEADING_ASK)}, lower(p[1])) THEN array_to_string(p[2:], ' ') ELSE array_to_string(p, ' ') END AS h FROM ask0),
ask AS (SELECT eval_id, question, answer, {s.tokens('question')} AS qt, {s.tokens('question', c.TERM_STOP)} AS qk, {s.tokens("(CASE WHEN h = '' THEN question ELSE h END)")} AS ak FROM ask1)"""
SIGNALS = f"""sg0 AS (SELECT c.eval_id, c.claim_id, qt, qk, ak, {s.tokens('c.text')} AS tk, {s.tokens('c.text', c.TERM_STOP)} AS kk FROM claims c JOIN ask USING (eval_id)),
sg1 AS (SELECT *, {s.jaccard('qt', 'tk')} >= 0.5 AS on_topic, {s.coverage('ak', 'tk')} AS r, {s.coverage('qk', 'kk')} >= 0.5 AS lex FROM sg0), sg AS (SELECT *, {s.label('r', 'tk', 'ak')} = 'E' OR lex AS on_ask FROM sg1)"""
_SIG = (s.EV, s.CHUNKS, s.SPANS, s.CLAIMS, ASK, SIGNALS)
ON_TOPIC = s.with_(*_SIG) + "SELECT eval_id, count(*) FILTER (on_topic) AS on_topic, count(*) FILTER (on_ask) AS on_ask, count(*) FILTER (on_topic AND on_ask) AS responsive, count(*) AS n FROM sg GROUP BY eval_id"


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.relevance(signals_of(spark, sf_dir), src.conversations(spark, sf_dir))
    return rows.select("eval_id", "n", r6("score").alias("score"), "band", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "abstained")


_LOW, _HIGH = wilson_sql("resp", "n")
ANSWER_ASK = f"""aw AS (SELECT eval_id, ak, qk, {s.tokens('answer')} AS said, {s.tokens('answer', c.TERM_STOP)} AS sk FROM ask), aw1 AS (SELECT *, {s.coverage('ak', 'said')} AS r FROM aw),
aw2 AS (SELECT eval_id, {s.label('r', 'said', 'ak')} = 'E' OR {s.coverage('qk', 'sk')} >= 0.5 AS ok FROM aw1)"""
RELEVANCE = s.with_(
    *_SIG, ANSWER_ASK, "rg AS (SELECT eval_id, count(*) AS n, count(*) FILTER (on_topic AND on_ask) AS resp FROM sg GROUP BY eval_id)",
    "rh AS (SELECT eval_id, ok, coalesce(n, 0) AS n, coalesce(resp, 0) AS resp FROM aw2 LEFT JOIN rg USING (eval_id)), ri AS (SELECT *, coalesce(resp / CAST(nullif(n, 0) AS DOUBLE), 0.0) AS base FROM rh)",
    "rs AS (SELECT *, CASE WHEN ok THEN base ELSE least(base, 0.5) END AS score FROM ri)",
) + f"SELECT eval_id, n, round(score, 6) AS score, {band_sql('score')} AS band, {_LOW} AS ci_low, {_HIGH} AS ci_high, false AS abstained FROM rs"


def method_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.reverse_relevance(src.conversations(spark, sf_dir)).select("eval_id", r6("relevance").alias("relevance"))


METHOD_A = s.with_(s.EV, f"v1 AS (SELECT eval_id, {s.vector('question')} AS a, {s.vector('answer')} AS b FROM ev)") + "SELECT eval_id, round(least(1.0, list_cosine_similarity(a, b)), 6) AS relevance FROM v1"


QUERIES = {
    "classify_task": _classify(c.TASKS, c.TASK_DEFAULT), "classify_req": _classify(c.REQUIREMENTS, "default"), "classify_archetype": _classify(c.ARCHETYPES, "default"),
    "req_templates": _types(c.REQUIREMENTS), "archetypes": _types(c.ARCHETYPES), "requirements": requirements, "outcomes": outcomes, "task_success": task_success, "units": units,
    "completeness": completeness, "dedupe": dedupe, "recall_miss": recall_miss, "on_topic": on_topic, "relevance": relevance, "method_a": method_a,
}
SQL = {
    "classify_task": s.with_(s.EV, EVALS) + f"SELECT eval_id, {_classify_sql(c.TASKS, c.TASK_DEFAULT)} AS qtype FROM evals",
    "classify_req": s.with_(s.EV, EVALS) + f"SELECT eval_id, {_classify_sql(c.REQUIREMENTS, 'default')} AS qtype FROM evals",
    "classify_archetype": s.with_(s.EV, EVALS) + f"SELECT eval_id, {_classify_sql(c.ARCHETYPES, 'default')} AS qtype FROM evals",
    "req_templates": _asked_sql(c.REQUIREMENTS), "archetypes": _asked_sql(c.ARCHETYPES), "requirements": REQUIREMENTS, "outcomes": OUTCOMES, "task_success": TASK, "units": UNITS,
    "completeness": COMPLETENESS, "dedupe": DEDUPE, "recall_miss": RECALL_MISS, "on_topic": ON_TOPIC, "relevance": RELEVANCE, "method_a": METHOD_A,
}
