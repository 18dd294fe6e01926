"""Steps that once grew too fast or ran more than once, held against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeleaf.functions import scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators import dimensions as dim
from gaugeleaf.operators import support, tasks
from gaugeleaf.plans import graph_queries as gq
from gaugeleaf.plans import support_queries as sq
from gaugeleaf.streaming import atom_stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_a_text_with_thousands_of_them(spark):
    r = random.Random(3)
    tails = ["k", " thousand", " Million", "  b", " tons", ", ", ".5", "\n\nm", "-", " K", " of"]
    text = "".join(f"{r.randint(1, 9999)}{r.choice(tails)} " for _ in range(4000))
    scale = {"m": 1e6, "b": 1e9, "t": 1e12, "k": 1e3}
    want = []
    for m in re.finditer(r"[-+]?[0-9][0-9,]*\.?[0-9]*", text):
        tail = text[m.end():].strip().lower()
        want.append(float(m.group().replace(",", "")) * (1e3 if tail.startswith("thousand") else scale.get(tail[:1], 1.0)))
    got = spark.createDataFrame([(text,)], "x string").select(t.all_numbers(F.col("x"))).first()[0]
    assert got == want and len(got) == 4000
    assert "split" not in str(t.all_numbers(F.col("x")))  # no list of all that follows, made anew for each number


def test_last_subject_of_long_texts(spark):
    r = random.Random(5)
    parts = ["Foo", "Bar", "Baz9", "a", "of", "X", "the", "Ünder", "éa", "Foo_Bar", "9Up", "_q", "Élan"]
    texts = ["".join(r.choice(parts) + r.choice([" ", ", ", ".", "  ", "\n", "-", ""]) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["Only One " + "small words " * 90]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.last_subject(F.col("x"), 20).alias("short"), t.last_subject(F.col("x"), 10**6).alias("whole")).collect()
    assert all(x.short == x.whole for x in rows) and rows[-1].short == "Only One" and sum(x.whole is None for x in rows) < 100


def test_claims_without_numbers_leave_the_sources_unread(spark):
    claims = spark.createDataFrame([(1, 0, 0, "c", "Revenue rose.", True, 0.9, ["a"], ["d"], ["a"], "a")], "eval_id long, sent_ord int, clause_ord int, claim_id string, text string, grounded boolean, confidence double, chunks array<string>, docs array<string>, cited array<string>, own string")
    chunks = spark.createDataFrame([(1, 0, "a", "Revenue rose 12 percent.", "http://x.example", "reuters.com", "2026-01-01", "Jane Roe")], "eval_id long, chunk_ord long, chunk_id string, text string, url string, domain string, date string, author string")
    assert "Generate" not in plan(dim.axioms(claims, chunks)) and dim.axioms(claims, chunks).first().axiom
    with_number = claims.withColumn("text", F.lit("Revenue rose 13 percent."))
    assert "Generate" in plan(dim.axioms(with_number, chunks)) and not dim.axioms(with_number, chunks).first().axiom


def test_support_reads_the_words_of_a_chunk_once(spark):
    trips = spark.createDataFrame([(1, 0, 0, 0, "c1", "ice is not cold"), (1, 1, 0, 0, "c2", "the of"), (2, 0, 0, 0, "c3", "ice is cold")], "eval_id long, sent_ord int, clause_ord int, trip_ord int, claim_id string, text string")
    chunks = spark.createDataFrame([(1, i, f"k{i}", x, None, None) for i, x in enumerate(["Ice is cold and hard.", "Not here.", "Ice. Ice, not cold", "Snow"])], "eval_id long, chunk_ord long, chunk_id string, text string, url string, domain string")
    rows = support.labelled(trips, chunks)
    got = {(x.claim_id, x.chunk_id): (x.label, round(x.raw, 6)) for x in rows.collect()}
    assert got[("c1", "k0")] == ("C", round(2 / 3, 6)) and got[("c1", "k2")] == ("E", 1.0) and {v for k, v in got.items() if k[0] == "c2"} == {("N", 0.0)} and len(got) == 6
    found = {x.claim_id: x.label for x in support.triplet_labels(trips, rows).collect()}
    assert found == {"c1": "E", "c2": "N", "c3": "N"}
    assert sum(line.count("regexp_extract_all(lower(text") for line in plan(support.labelled(trips, chunks)).splitlines() if "chunk_id" in line) == 1


@pytest.mark.parametrize("query", [sq.sets_of, sq.hallucination, sq.source_adequate])
def test_claims_of_a_query_are_made_once(spark, query):
    assert "(?i)" not in plan(query(spark, SF))  # claims come from a checkpoint, where their patterns have been met


def test_graph_of_claims_labels_them_once(spark, monkeypatch):
    called = {"claims": 0, "labels": 0}

    def counted(name, f):
        def again(*args):
            called[name] += 1
            return f(*args)

        return again

    for module in (gq, sq):
        monkeypatch.setattr(module, "claims_of", counted("claims", gq.claims_of))
    monkeypatch.setattr(support, "labelled", counted("labels", support.labelled))
    assert gq.graph_json(spark, SF).count() > 0 and called == {"claims": 1, "labels": 1}


def test_an_atom_of_several_formulas_is_kept_and_shuffled_once(spark, tmp_path):
    r, formulas = random.Random(9), ["mean", "weighted_mean", "dag_resolution", "achieved_ratio"]
    rows = [(e, "d", f"a{i}", i, f"s{i % 3}", r.random() < 0.6, [(f, r.choice(["axiom", "derived", "outcome"]), float(r.randint(1, 4))) for f in formulas]) for e in range(5) for i in range(r.randint(1, 12))]
    frame = spark.createDataFrame(rows, atom_stream.KEPT)
    for part in (frame.where("seq % 2 = 0"), frame.where("seq % 2 = 1 or seq % 4 = 0")):  # some come twice
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(atom_stream.KEPT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    atom_stream.keep_scores(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    scores = atom_stream.kept_scores(spark, str(tmp_path / "log"))
    assert plan(scores).count("Exchange hashpartitioning") == 1
    flat = frame.select("eval_id", "dimension", "atom_id", "seq", "subject", "verdict", F.inline("parts"))
    shown = lambda df: {(x.eval_id, x.formula_id): x.score for x in df.collect()}
    assert shown(scores) == pytest.approx(shown(scoring.by_formula(flat, atom_stream.GROUP)))
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(rows) + sum(x[3] % 4 == 0 for x in rows)  # no row for each formula


def test_units_are_folded_by_slots_in_rows_dealt_by_number(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("ice snow rain wind fog hail sun the".split()) for _ in range(r.randint(0, 5))) for _ in range(80)]
    units = spark.createDataFrame([(i % 3, f"u{i}", x, i) for i, x in enumerate(texts)], "eval_id int, unit_id string, text string, ord int")
    vectors = {x.unit_id: x.v for x in units.select("unit_id", t.embedding(F.col("text")).alias("v")).collect()}
    want = set()
    for e in range(3):
        kept = []
        for i in range(e, len(texts), 3):
            if all(round(sum(a * b for a, b in zip(vectors[f"u{i}"], vectors[u])), 9) < 0.85 for u in kept):
                kept.append(f"u{i}")
        want |= {(e, u) for u in kept}
    out = tasks.dedupe(units)
    assert {(x.eval_id, x.unit_id) for x in out.collect()} == want and len(want) < 80
    assert "REPARTITION_BY_NUM" in plan(tasks.dedupe(units))


def test_tokens_of_sentences_stay_out_of_the_shuffle(spark):
    reqs = spark.createDataFrame([(1, "g0", True, 0, "Ice and snow"), (1, "g1", True, 1, "Rain"), (2, "g0", True, 0, "Fog")], "eval_id long, req_id string, vital boolean, req_ord int, req string")
    said = spark.createDataFrame([(1, 0, 0, "Snow, rain."), (1, 0, 1, "Sun."), (1, 1, 0, "Rain here."), (2, 2, 0, "No ice."), (3, 3, 0, "Fog.")], "eval_id long, chunk_ord long, sent_ord int, text string")
    got = {(x.eval_id, x.req_id, x.chunk_ord, x.sent_ord) for x in tasks.draft(reqs, said).where("origin = 'bottom_up'").collect()}
    assert got == {(1, "g0", 0, 0), (1, "g1", 0, 0), (1, "g1", 1, 0)}
    made = [line for line in plan(tasks.draft(reqs, said)).splitlines() if "regexp_extract_all(lower(text#" in line]
    assert made and all("rs#" in line for line in made)  # where the requirements are, above the shuffle
