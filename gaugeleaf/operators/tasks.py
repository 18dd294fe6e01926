"""Requirements, units, completeness, task outcomes, relevance. Type tables are fixed and small; they enter as literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.config import Config
from gaugeleaf.functions import providers, scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators import graph, pipeline

OUTCOME = (
    "task_type string, outcome_ord int, outcome_id string, outcome string, verifier string, weight double, patterns array<string>, signals array<string>, run_claims array<string>, "
    "cues array<string>, requirement string, signal string, max_words int, min_words int, includes array<string>, excludes array<string>, expected string, exact boolean"
)
_PARAMS = ("patterns", "signals", "run_claims", "cues", "requirement", "signal", "max_words", "min_words", "includes", "excludes", "expected", "exact")


def requirement_table(spark: SparkSession, types: dict) -> DataFrame:
    rows = [(k, i, *r) for k, (_, reqs) in types.items() for i, r in enumerate(reqs)]
    return spark.createDataFrame(rows, "qtype string, req_ord int, req_id string, req string, vital boolean")


def outcome_table(spark: SparkSession, tasks: dict = c.TASKS) -> DataFrame:
    rows = [(k, i, *o[:4], *(o[4].get(p) for p in _PARAMS)) for k, (_, outs) in tasks.items() for i, o in enumerate(outs)]
    return spark.createDataFrame(rows, OUTCOME)


def generated(evals: DataFrame) -> DataFrame:
    facets = F.concat(F.lit("requirement facets a complete answer must cover: "), "question")
    rows = evals.select("eval_id", F.posexplode(t.sentences(facets)).alias("req_ord", "req"))
    return rows.select("eval_id", "req_ord", F.concat(F.lit("gen-"), "req_ord").alias("req_id"), "req", F.lit(True).alias("vital"))


def templated(evals: DataFrame, types: dict) -> DataFrame:
    """The requirements of the type that the question falls into; the type table is fixed, hence the broadcast."""
    rows = classified(evals.select("eval_id", "question"), types, "default")
    return rows.join(F.broadcast(requirement_table(evals.sparkSession, types)), "qtype").select("eval_id", "req_ord", "req_id", "req", "vital")


def requirements(evals: DataFrame, settings: Config = Config()) -> DataFrame:
    if settings.reference_mode == "generated":
        return generated(evals)
    return templated(evals, c.ARCHETYPES if settings.reference_mode == "archetype" else c.REQUIREMENTS)


def source_sentences(chunks: DataFrame) -> DataFrame:
    """eval_id, chunk_ord, sent_ord, text."""
    return chunks.select("eval_id", "chunk_ord", F.posexplode(t.sentences(F.col("text"))).alias("sent_ord", "text"))


#: The order of an evaluation's units: by requirement, its own sentences before those of the sources, each in its order.
UNIT_ORDER = ("req_ord", "bottom", "chunk_ord", "sent_ord", "part")


def draft(reqs: DataFrame, sentences: DataFrame) -> DataFrame:
    """eval_id, req_id, vital, text, origin and all of UNIT_ORDER but part.

    A requirement's own sentences, and source sentences that share a token with it. An evaluation's requirements are few, so they lie
    in one row, which sentences meet by eval_id: their tokens are made there, once a sentence, and not shuffled.
    """
    head = ["eval_id", "req_id", "vital", "req_ord"]
    own = reqs.select(*head, F.posexplode(t.sentences(F.col("req"))).alias("sent_ord", "text"))
    top = own.select(*head, "text", F.lit("top_down").alias("origin"), F.lit(0).alias("bottom"), F.lit(0).cast("long").alias("chunk_ord"), "sent_ord")
    asked = reqs.select("eval_id", F.struct(*head[1:], t.tokens(F.col("req")).alias("asked")).alias("r")).groupBy("eval_id").agg(F.collect_list("r").alias("rs"))
    met = sentences.join(asked, "eval_id").withColumn("said", t.tokens(F.col("text")))
    low = met.select("eval_id", "chunk_ord", "sent_ord", "text", F.inline(F.filter("rs", lambda r: F.arrays_overlap(r["asked"], F.col("said")))))
    return top.unionByName(low.select(*head, "text", F.lit("bottom_up").alias("origin"), F.lit(1).alias("bottom"), F.col("chunk_ord").cast("long").alias("chunk_ord"), "sent_ord"))


def vocabulary(chunks: DataFrame) -> DataFrame:
    """eval_id, token: what the sources say, a row each; Spark drops repeats of a chunk before the shuffle."""
    return chunks.select("eval_id", F.explode(t.tokens(F.col("text"))).alias("token")).distinct()


def _said_of(need: DataFrame, chunks: DataFrame) -> DataFrame:
    """vocabulary(), of the tokens in need (eval_id, token) alone: those of an evaluation's requirements, few enough for a row."""
    asked = need.groupBy("eval_id").agg(F.collect_set("token").alias("asked"))
    met = chunks.select("eval_id", t.tokens(F.col("text")).alias("said")).join(asked, "eval_id")
    return met.select("eval_id", F.explode(F.array_intersect("asked", "said")).alias("token")).distinct()


def context_tokens(chunks: DataFrame) -> DataFrame:
    """eval_id, known: the token set of all chunks, put together token by token."""
    return vocabulary(chunks).groupBy("eval_id").agg(F.collect_set("token").alias("known"))


def gated(units: DataFrame, evals: DataFrame, chunks: DataFrame, settings: Config = Config(), quoted: bool = False) -> DataFrame:
    """Atomic parts of units, with admitted and supported: the gate's verdict on each, before it acts.

    A leading pronoun is resolved against the sources first. A part passes if it stands alone and its label is the same with and
    without the sources (or, without double_nli, if the answer entails it). The sources enter as counts: how many of a part's
    tokens they have beyond the answer's, and whether they negate. Parts are told apart by 128 bits of their text and checkpointed, as
    the tokens they lack are looked up apart from them. quoted says that bottom-up units are sentences of these chunks: cut and
    resolved by the rules here, whose subjects are of the chunks too, they have no token that the sources lack, so only the others look.
    """
    quoted = quoted and (settings.clause_parser, settings.coreference) == (Config().clause_parser, Config().coreference)
    parts = units.withColumn("parts", providers.provider("clauses", settings.clause_parser)(F.col("text"))).select("*", F.posexplode("parts").alias("part", "raw")).drop("parts", "text")
    parts = parts.join(pipeline.context_subject(chunks), "eval_id", "left").withColumn("text", providers.provider("coreference", settings.coreference)(F.col("raw"), F.col("subject"))).drop("raw", "subject")
    negation = F.array(*map(F.lit, c.NEGATION))
    said = evals.select("eval_id", t.tokens(F.col("answer")).alias("said")).withColumn("answer_negates", F.arrays_overlap("said", negation))
    rows = parts.join(said, "eval_id").withColumn("tokens", t.tokens(F.col("text")))
    rows = rows.withColumn("n", F.size("tokens")).withColumn("held", F.size(F.array_intersect("tokens", "said"))).withColumn("need", F.array_except("tokens", "said"))
    rows = rows.withColumn("unit_negates", F.arrays_overlap("tokens", negation)).withColumn("mark", F.md5(F.col("text").cast("binary"))).drop("said", "tokens")
    low = rows.where("origin = 'bottom_up'").withColumn("more", F.size("need").cast("long")).drop("need") if quoted else None
    rows = graph.shared_checkpoint(rows.where("origin <> 'bottom_up'") if quoted else rows)
    need = rows.select("eval_id", "mark", F.explode("need").alias("token")).distinct()
    more = need.join(_said_of(need, chunks) if quoted else vocabulary(chunks), ["eval_id", "token"], "left_semi").groupBy("eval_id", "mark").agg(F.count("*").alias("more"))
    some = "(^|[^a-z0-9])(" + "|".join(c.NEGATION) + ")([^a-z0-9]|$)"
    negates = chunks.where(F.lower("text").rlike(some)).select("eval_id", F.lit(True).alias("negates")).distinct()
    rows = rows.drop("need").join(more, ["eval_id", "mark"], "left").fillna(0, ["more"])
    rows = (rows if low is None else rows.unionByName(low)).join(negates, "eval_id", "left").fillna(False, ["negates"])

    def label(held: Column, negates: Column) -> Column:
        raw = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(held / F.col("n"))
        return F.when((raw >= settings.contra_tau) & (negates != F.col("unit_negates")), "C").when(raw >= settings.entail_tau, "E").otherwise("N")

    rows = rows.withColumn("own", label(F.col("held"), F.col("answer_negates"))).withColumn("with_sources", label(F.col("held") + F.col("more"), F.col("answer_negates") | F.col("negates")))
    alone = ~F.col("text").rlike(t.LEADING_SHORT)
    fine = F.col("own") == (F.col("with_sources") if settings.double_nli else F.lit("E"))
    unit = t.short_hash("unit:", F.concat_ws("|", "req_id", "text"))
    return rows.select("eval_id", unit.alias("unit_id"), "req_id", "vital", "origin", "text", *UNIT_ORDER, (alone & fine).alias("admitted"), (F.col("own") == "E").alias("supported"))


def admit(units: DataFrame, evals: DataFrame, chunks: DataFrame, settings: Config = Config(), quoted: bool = False) -> DataFrame:
    """The parts that pass the gate, as frozen() has them."""
    return frozen(gated(units, evals, chunks, settings, quoted))


def frozen(parts: DataFrame) -> DataFrame:
    """Admitted parts, equal ones of a requirement once, with ord: a struct that orders them."""
    rows = parts.where("admitted").drop("admitted").withColumn("ord", F.struct(*UNIT_ORDER)).drop(*UNIT_ORDER)
    first = rows.groupBy("eval_id", "unit_id").agg(F.min_by(F.struct("req_id", "vital", "origin", "text", "supported"), "ord").alias("u"), F.min("ord").alias("ord"))
    return first.select("eval_id", "unit_id", "u.*", "ord")


def dedupe(units: DataFrame, settings: Config = Config()) -> DataFrame:
    """Units kept by a greedy fold: in order, one goes if its cosine with some unit kept before reaches dedupe_tau.

    Order matters, so an evaluation's units are folded in one row; they are the few units of one answer. The row has a unit's slots, a
    number a token; only units that are kept get a vector. Rows are dealt by number, as Spark would else put together partitions that
    are small for being compressed. Columns stay.
    """
    rest = [x for x in units.columns if x != "eval_id"]
    slots = t.slots(F.col("text"), settings.embedding_seed, settings.embedding_dim)
    rows = units.select("eval_id", "ord", "unit_id", slots.alias("slots")).select("eval_id", F.struct("ord", "unit_id", "slots", t.slots_norm(F.col("slots")).alias("length")).alias("u"))
    rows = rows.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "eval_id")
    lists = rows.groupBy("eval_id").agg(F.array_sort(F.collect_list("u")).alias("us"))
    held = lambda u: F.struct(u["ord"].alias("ord"), u["unit_id"].alias("unit_id"), t.slot_counts(u["slots"], settings.embedding_dim).alias("counts"), u["length"].alias("length"))
    near = lambda u, k: F.exists(k, lambda x: t.slots_cosine(u["slots"], u["length"], x["counts"], x["length"]) >= settings.dedupe_tau)
    kept = F.aggregate("us", F.transform(F.slice("us", 1, 0), held), lambda k, u: F.when(near(u, k), k).otherwise(F.concat(k, F.array(held(u)))))
    ids = lists.select("eval_id", F.explode(F.transform(kept, lambda u: F.struct(u["ord"].alias("ord"), u["unit_id"].alias("unit_id")))).alias("u")).select("eval_id", "u.*")
    return units.join(ids, ["eval_id", "ord", "unit_id"], "left_semi").select("eval_id", *rest)


def coverage(reqs: DataFrame, units: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, requirement_coverage, weighted_recall: requirements with a supported unit, and recall weighted by vital."""
    per = units.groupBy("eval_id", "req_id").agg(F.avg(F.col("supported").cast("int")).alias("recall"), F.bool_or("supported").alias("any"))
    weight = F.when(F.col("vital") & F.lit(settings.vital_weighting), 2.0).otherwise(1.0)
    rows = reqs.join(per, ["eval_id", "req_id"], "left").withColumn("recall", F.coalesce("recall", F.lit(0.0))).withColumn("w", weight)
    return rows.groupBy("eval_id").agg(
        F.avg(F.coalesce("any", F.lit(False)).cast("int")).alias("requirement_coverage"), (F.sum(F.col("w") * F.col("recall")) / F.sum("w")).alias("weighted_recall")
    )


def _grams(text: Column) -> Column:
    """All runs of up to three characters, the empty one too."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), *map(runs, (1, 2, 3))))


def recall_miss(evals: DataFrame, units: DataFrame, sample: DataFrame) -> DataFrame:
    """eval_id, miss_rate: facts of the sample for questions that contain its phrase, in any case, that no unit covers to a half.

    Phrases meet questions by their first three characters, so a sample of any size is joined by equal keys.
    """
    phrases = sample.select(F.lower("question_match").alias("phrase"), "fact").withColumn("gram", F.substring("phrase", 1, 3))
    asked = evals.select("eval_id", F.lower("question").alias("asked")).select("eval_id", "asked", F.explode(_grams(F.col("asked"))).alias("gram"))
    facts = asked.join(phrases, "gram").where(F.contains("asked", "phrase")).select("eval_id", "phrase", "fact", t.tokens(F.col("fact"), c.TERM_STOP).alias("need"))
    met = facts.join(units.select("eval_id", t.tokens(F.col("text"), c.TERM_STOP).alias("have")), "eval_id", "left")
    hit = met.groupBy("eval_id", "phrase", "fact").agg(F.bool_or(F.coalesce(t.coverage(F.col("need"), F.col("have")) >= 0.5, F.lit(False))).alias("hit"))
    return hit.groupBy("eval_id").agg(F.avg((~F.col("hit")).cast("int")).alias("miss_rate"))


def completeness(reqs: DataFrame, units: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, vital_units, total_units, score, band, ci, abstained and the two-level figures."""
    n = units.groupBy("eval_id").agg(F.count_if("vital").alias("vital_units"), F.count("*").alias("total_units"), F.count_if(F.col("vital") & F.col("supported")).alias("held"))
    rows = coverage(reqs, units, settings).join(n, "eval_id", "left").fillna(0, ["vital_units", "total_units", "held"])
    rows = rows.withColumn("score", F.coalesce(F.col("held") / F.nullif("vital_units", F.lit(0)), F.lit(0.0)))
    low, high = scoring.wilson(F.col("held"), F.col("vital_units"))
    return rows.withColumn("band", scoring.band(F.col("score"), settings)).withColumn("ci_low", low).withColumn("ci_high", high).withColumn("abstained", scoring.should_abstain(F.col("vital_units"), settings))


def classified(evals: DataFrame, types: dict, default: str, arms: int = 64) -> DataFrame:
    """evals with qtype: the first type one of whose keywords the question contains, in any case, else the default.

    A short table is one expression. Of a longer one, keywords meet questions by their first three characters, as no plan holds
    thousands of conditions; both say the same.
    """
    if len(types) <= arms:
        return evals.withColumn("qtype", t.classify(F.col("question"), types, default))
    rows = [(i, k, w.lower(), w.lower()[:3]) for i, (k, (words, *_)) in enumerate(types.items()) for w in words]
    words = evals.sparkSession.createDataFrame(rows, "at int, kind string, word string, gram string")
    asked = evals.select("eval_id", F.lower("question").alias("asked")).select("eval_id", "asked", F.explode(_grams(F.col("asked"))).alias("gram"))
    found = asked.join(words, "gram").where(F.contains("asked", "word")).groupBy("eval_id").agg(F.min(F.struct("at", "kind")).alias("first"))
    return evals.join(found, "eval_id", "left").withColumn("qtype", F.coalesce("first.kind", F.lit(default))).drop("first")


def outcomes(evals: DataFrame, types: dict | None = None, default: str = c.TASK_DEFAULT) -> DataFrame:
    """The outcomes of each question's task type, of the fixed types or of a table's (sources.tables.task_types())."""
    types = c.TASKS if types is None else types
    rows = classified(evals, types, default).withColumnRenamed("qtype", "task_type")
    return rows.join(F.broadcast(outcome_table(evals.sparkSession, types)), "task_type")  # read from a table of bounded length


def _some(needles: Column) -> Column:
    return F.coalesce(F.exists(needles, lambda p: F.contains(F.lower("answer"), F.lower(p))), F.lit(False))


def _entails(premise: Column, hypothesis: Column) -> Column:
    return t.entailment(premise, hypothesis)["label"] == "E"


def _limits(known: Column) -> Column:
    n, none = t.word_count(F.col("answer")), F.array().cast("array<string>")
    fits = (n <= F.coalesce("max_words", n)) & (n >= F.coalesce("min_words", n)) & ~_some(F.coalesce("excludes", none))
    return fits & F.forall(F.coalesce("includes", none), lambda p: F.contains(F.lower("answer"), F.lower(p)))


def _state(known: Column) -> Column:
    same = t.strip(F.col("answer")) == t.strip(F.col("expected"))
    return F.when(F.col("expected").isNull(), True).when(F.coalesce("exact", F.lit(False)), same).otherwise(F.contains(F.lower("answer"), F.lower("expected")))


def _imported(known: Column) -> Column:
    asked = t.jaccard(t.tokens(F.col("question")), F.col("said")) >= 0.5
    return F.when(F.col("signal") == "responsive", asked).otherwise(F.when(known.isNull(), True).otherwise(_entails(known, F.col("said"))))


def _adequate(known: Column) -> Column:
    heard = F.array_union("said", F.array_union(F.array(F.lit("reference")), t.tokens(F.col("outcome"))))
    return t.coverage(t.tokens(F.array_join("cues", " ")), heard) >= 0.34


#: What each verifier tag of an outcome asks of a row: question, answer, said (its tokens) and the outcome's columns; known: the context's tokens.
_VERIFIERS = {
    "artifact_presence": lambda known: _some(F.col("patterns")), "executable": lambda known: _some(F.col("signals")) & _some(F.col("run_claims")), "adequacy": _adequate,
    "coverage": lambda known: _entails(F.col("said"), t.tokens(F.coalesce("requirement", F.lit("")))), "constraint": _limits, "state": _state, "import": _imported,
}


def register_verifier(tag: str, make: Callable[[Column], Column]) -> None:
    """Let outcomes name a further verifier: a function from the context's token column to a condition on an outcome row."""
    if tag in _VERIFIERS:
        raise ValueError(f"verifier {tag} is registered")
    _VERIFIERS[tag] = make


def verdict(known: Column) -> Column:
    """Whether an outcome row (with question, answer, and the context's token set) is achieved, by its verifier; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown verifier "), "verifier")).cast("boolean")
    for tag, make in _VERIFIERS.items():
        out = F.when(F.col("verifier") == tag, make(known)).otherwise(out)
    return out


def impossible(answer: Column) -> Column:
    return t.contains_any(answer, c.IMPOSSIBLE) & t.contains_any(answer, c.REASONS)


def judged_outcomes(evals: DataFrame, known: DataFrame, types: dict | None = None, default: str = c.TASK_DEFAULT) -> DataFrame:
    """The outcomes of each evaluation with ok, and impossible: whether the answer says why the task can't be done."""
    rows = outcomes(evals, types, default).join(known, "eval_id", "left").withColumn("said", t.tokens(F.col("answer")))
    return rows.withColumn("ok", verdict(F.col("known"))).withColumn("impossible", impossible(F.col("answer")))


def task_success(evals: DataFrame, known: DataFrame, settings: Config = Config(), types: dict | None = None, default: str = c.TASK_DEFAULT) -> DataFrame:
    """eval_id, task_type, impossible, achieved, required, score, band: outcomes weighed; a well-founded "impossible" counts as
    done, with no outcome achieved or required.
    """
    share = F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)) / F.sum("weight")
    done = judged_outcomes(evals, known, types, default).groupBy("eval_id", "task_type").agg(F.bool_or("impossible").alias("impossible"), F.count_if("ok").alias("achieved"), F.count("*").alias("required"), share.alias("share"))
    none = lambda n: F.when(F.col("impossible"), 0).otherwise(F.col(n)).cast("long")
    done = done.withColumn("score", F.when(F.col("impossible"), 1.0).otherwise(F.col("share"))).withColumn("achieved", none("achieved")).withColumn("required", none("required")).drop("share")
    return done.withColumn("band", scoring.band(F.col("score"), settings))


def claim_signals(claims: DataFrame, evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """claims with tokens, on_topic, on_ask and responsive."""
    asks = evals.select("eval_id", "question", t.tokens(F.col("question")).alias("q"), t.tokens(F.col("question"), c.TERM_STOP).alias("q_terms"), t.tokens(t.ask_hypothesis(F.col("question"))).alias("ask"))
    rows = claims.join(asks, "eval_id").withColumn("tokens", t.tokens(F.col("text")))
    nli = t.entailment(F.col("tokens"), F.col("ask"), settings.entail_tau, settings.contra_tau)["label"] == "E"
    lex = t.coverage(F.col("q_terms"), t.tokens(F.col("text"), c.TERM_STOP)) >= settings.lexical_min_overlap
    if settings.relevance == "lexical":
        near = t.jaccard(F.col("q"), F.col("tokens"))  # of the tokens that are there already
    else:
        near = providers.provider("relevance", settings.relevance)(F.col("question"), F.col("text"))
    rows = rows.withColumn("on_topic", near >= settings.relevance_tau).withColumn("on_ask", nli | lex)
    return rows.withColumn("responsive", F.col("on_topic") & F.col("on_ask")).drop("question", "q", "q_terms", "ask")


def answer_on_ask(evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, answer_on_ask, declined: whether the answer addresses the ask; whether it properly declines what nobody could answer."""
    said, ask = t.tokens(F.col("answer")), t.tokens(t.ask_hypothesis(F.col("question")))
    lex = t.coverage(t.tokens(F.col("question"), c.TERM_STOP), t.tokens(F.col("answer"), c.TERM_STOP)) >= settings.lexical_min_overlap
    on_ask = (t.entailment(said, ask, settings.entail_tau, settings.contra_tau)["label"] == "E") | lex
    heard = F.concat("answer", F.lit("\n[reference] "), "question")
    decline = providers.overlap(0.4)(F.lit(c.DECLINE), heard)
    unanswerable = providers.provider("judge", settings.unanswerable)(F.lit("Is this question impossible to answer from any available source?"), F.col("question"))
    return evals.select("eval_id", on_ask.alias("answer_on_ask"), (decline & unanswerable).alias("declined"))


def relevance(signals: DataFrame, evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, n, score, band, ci, abstained: the share of responsive claims, capped where the answer misses the ask.

    An answer without claims has 0 of 0; a proper decline scores 1 and abstains.
    """
    n = signals.groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if("responsive").alias("responsive"))
    rows = answer_on_ask(evals, settings).join(n, "eval_id", "left").fillna(0, ["n", "responsive"])
    base = F.coalesce(F.col("responsive") / F.nullif("n", F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("score", F.when(F.col("declined"), 1.0).when(F.col("answer_on_ask"), base).otherwise(F.least(base, F.lit(settings.off_ask_cap))))
    low, high = scoring.wilson(F.col("responsive"), F.col("n"))
    rows = rows.withColumn("band", scoring.band(F.col("score"), settings)).withColumn("ci_low", F.when(F.col("declined"), 0.0).otherwise(low)).withColumn("ci_high", F.when(F.col("declined"), 1.0).otherwise(high))
    return rows.withColumnRenamed("declined", "abstained")


def relevance_tree(signals: DataFrame, links: DataFrame, evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, n, relevant, score, band: the mean grade of claims on the support tree and beside it, capped like relevance."""
    rows = graph.graded(signals, links, settings).groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if("relevant").alias("relevant"), F.avg("grade").alias("base"))
    rows = answer_on_ask(evals, settings).join(rows, "eval_id", "left").fillna(0, ["n", "relevant", "base"])
    rows = rows.withColumn("score", F.when(F.col("declined"), 1.0).when(F.col("answer_on_ask"), F.col("base")).otherwise(F.least("base", F.lit(settings.off_ask_cap))))
    return rows.withColumn("band", scoring.band(F.col("score"), settings))


def reverse_relevance(evals: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, relevance: the mean cosine of the question and the N questions that a generator derives from the answer."""
    v = lambda x: t.embedding(x, settings.embedding_seed, settings.embedding_dim)
    asked = providers.provider("generator", settings.generator)(F.col("answer"), settings.reverse_questions_n)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    rows = evals.select("eval_id", v(F.col("question")).alias("own"), F.array_distinct(asked).alias("kinds"), asked.alias("asked"))
    rows = rows.withColumn("cosines", F.transform("kinds", lambda x: F.struct(x.alias("text"), dot(v(x), F.col("own")).alias("cosine"))))
    total = F.aggregate("cosines", F.lit(0.0), lambda s, x: s + x["cosine"] * F.size(F.filter("asked", lambda y: y == x["text"])))
    return rows.select("eval_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.size("asked"))).alias("relevance"))
