"""Known values of the text and score functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.functions import providers, scoring
from gaugeleaf.functions import text as t


def values(spark, texts, *columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["$1.2B", "12 percent", "1,200 units", "no digits here", "12 margins", "5 the", "3 books", "40 for", "2010-2015"]
    got = [x for (x,) in values(spark, texts, t.first_number(F.col("x")))]
    assert got == [1.2e9, 12.0, 1200.0, None, 1.2e7, 5e12, 3e9, 40.0, 2010.0]
    assert values(spark, ["2010-2015 and 3k"], t.all_numbers(F.col("x")))[0][0] == [2010.0, -2015.0, 3000.0]


@pytest.mark.parametrize("a,b,tol,want", [("$1.2B", "1.2 billion", 0.0, True), ("$1.2B", "$1.3B", 0.0, False), ("$1.2B", "$1.3B", 0.1, True), ("no num", "5", 0.5, False)])
def test_numeric_match(spark, a, b, tol, want):
    assert spark.range(1).select(t.numeric_match(F.lit(a), F.lit(b), tol)).first()[0] is want


def test_clauses_sentences_and_triplets(spark):
    assert values(spark, ["Revenue rose and costs fell"], t.clauses(F.col("x")))[0][0] == ["Revenue rose", "costs fell"]
    assert values(spark, [" A b.  C d! e"], t.sentences(F.col("x")))[0][0] == ["A b.", "C d!", "e"]
    assert values(spark, ["Team won final in May"], t.triplets(F.col("x")))[0][0][0].asDict() == {"subject": "Team", "predicate": "won", "obj": "final in May"}
    assert len(values(spark, ["the man that ran, fell"], t.triplets(F.col("x")))[0][0]) == 2
    assert [r.asDict() for r in values(spark, [""], t.triplets(F.col("x")))[0][0]] == [{"subject": "", "predicate": "", "obj": ""}]


def test_predicates(spark):
    x = F.col("x")
    assert values(spark, ["Maybe they win.", "They won."], t.is_verifiable(x)) == [(False,), (True,)]
    assert values(spark, ["[a celebrity]", "[chunk-1]"], t.is_abstractive(x), t.citation(x)) == [(True, "a celebrity"), (False, "chunk-1")]
    assert values(spark, ["It is dark.", "Italy won."], t.has_leading_pronoun(x)) == [(True,), (False,)]
    assert values(spark, ["Margins therefore rose"], t.has_discourse_marker(x)) == [(True,)]
    assert values(spark, ["The match was in London."], t.filler(x)) == [("London",)]
    assert values(spark, ["They won."], t.resolve(x, F.lit("Real Madrid"))) == [("Real Madrid won.",)]
    assert values(spark, ["what is up?", "why"], t.ask_hypothesis(x)) == [("is up",), ("why",)]


def test_entailment_order(spark):
    e = lambda p, h: spark.range(1).select(t.entailment(t.tokens(F.lit(p)), t.tokens(F.lit(h)))).first()[0].label
    assert (e("the sky is blue today", "sky blue"), e("the sky is blue today", "sky is not blue today"), e("rain", "sky blue")) == ("E", "C", "N")


def test_embedding_is_unit_and_cosine_agrees(spark):
    v, s, n = t.embedding(F.lit("red red blue")), t.slots(F.lit("red red blue")), t.slot_counts(t.slots(F.lit("red green")))
    row = spark.range(1).select(v, t.slots_cosine(s, t.slots_norm(s), n, t.norm(n)), t.cosine(v, t.embedding(F.lit("red green")))).first()
    assert math.isclose(sum(x * x for x in row[0]), 1.0) and math.isclose(row[1], row[2], abs_tol=1e-8)


def test_hash_bucket(spark):
    import hashlib

    assert values(spark, ["chunk-1"], t.hash_bucket(F.col("x")))[0][0] == int(hashlib.sha256(b"chunk-1").hexdigest(), 16) % 100


ATOMS = "eval_id int, subject string, role string, verdict boolean, weight double, seq long"


def score(spark, name, rows):
    df = spark.createDataFrame([(1, *r, i) for i, r in enumerate(rows)], ATOMS)
    return scoring.formula(name)(df, ["eval_id"]).first().score


def test_formulas(spark):
    four = [("c1", "grounded", True, 1.0), ("c1", "responsive", True, 1.0), ("c2", "grounded", True, 1.0), ("c2", "responsive", False, 1.0)]
    assert score(spark, "conjunction_weighted_mean", four) == 0.5
    two = [("v1", "unit", True, 3.0), ("v2", "unit", False, 1.0)]
    assert (score(spark, "mean", two), score(spark, "weighted_mean", two), score(spark, "unsupported_rate", two)) == (0.5, 0.75, 0.5)
    dag = [("a", "axiom", True, 1.0), ("b", "axiom", False, 1.0), ("b", "derived", True, 1.0), ("c", "axiom", False, 1.0), ("d", "derived", False, 1.0)]
    assert math.isclose(score(spark, "dag_resolution", dag), 2 / 3)
    capped = [("x", "responsive", True, 1.0), ("x", "on_ask_answer", False, 0.5)]
    assert score(spark, "relevance_capped_mean", capped) == 0.5
    assert score(spark, "task_success_weighted", [("i", "impossible_success", True, 1.0), ("o", "outcome", False, 1.0)]) == 1.0
    with pytest.raises(KeyError):
        scoring.formula("none")
    with pytest.raises(ValueError):
        scoring.register("mean", scoring.mean)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60))
def test_wilson_holds_the_share(spark, k, extra):
    n = k + extra
    low, high = scoring.wilson(F.lit(k), F.lit(n))
    a, b = spark.range(1).select(low, high).first()
    assert 0 <= a <= b <= 1 and (n == 0 or a - 1e-9 <= k / n <= b + 1e-9)


def test_conformal(spark):
    rows = [("f", 1.0, True)] * 7 + [("f", 0.0, False)] * 5 + [("g", 0.3, False)]
    got = {r.stratum: r for r in scoring.conformal(spark.createDataFrame(rows, "stratum string, confidence double, label boolean"), True).collect()}
    assert (got[None].threshold, got[None].band_high, got[None].n) == (1.0, 1.0, 7)
    assert got["g"].abstained and got["g"].n == 0
    ten = scoring.conformal(spark.createDataFrame([("s", x / 10, True) for x in range(1, 11)], "stratum string, confidence double, label boolean")).first()
    assert math.isclose(ten.band_high, min(1, 0.95 + 1 / 11)) and math.isclose(ten.tau_hat, 0.9)


def test_settings_are_strict():
    assert c.load({"groundedness_k": 5}).groundedness_k == 5
    with pytest.raises(ValueError):
        c.load({"unknown": 1})
    with pytest.raises(ValueError):
        c.load({"entail_tau": 2.0})


def test_providers(spark):
    assert spark.range(1).select(providers.provider("relevance")(F.lit("a red fox"), F.lit("red fox"))).first()[0] == 1.0
    score_of = providers.external_score(lambda: lambda a, b: [float(len(x) + len(y)) for x, y in zip(a, b)])
    providers.register("relevance", "length", score_of)
    assert spark.range(1).select(providers.provider("relevance", "length")(F.lit("ab"), F.lit("c"))).first()[0] == 3.0
    with pytest.raises(ValueError):
        providers.register("relevance", "length", score_of)
    with pytest.raises(KeyError):
        providers.provider("relevance", "none")
    assert spark.range(1).select(providers.clean_prompt(F.lit("[[deny]] Split {{this}}"))).first()[0] == "Split this"
