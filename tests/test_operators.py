"""Pipeline, support, graph, log, streaming and the engine on small cases."""

import pytest
from pyspark.sql import functions as F

from gaugeleaf.config import Config, load
from gaugeleaf.functions import providers
from gaugeleaf.operators import atoms, graph, pipeline, records, support, tasks
from gaugeleaf.operators import dimensions as dim
from gaugeleaf.plans import engine
from gaugeleaf.sources import evaluations as src
from gaugeleaf.sources import tables
from gaugeleaf.streaming import atom_stream


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Wide plans over a few rows: compiling them takes longer than running them."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "true")


def bundle(spark, settings=Config(), **more):
    cases = src.fixtures(spark)
    b = engine.evaluate(cases.select("eval_id", "question", "answer", "citations"), src.fixture_chunks(cases), settings, now="1970-01-01", **more)
    names = {r.eval_id: r.name for r in cases.collect()}
    return {(names[r.eval_id], r.dimension): r for r in b.results.collect()}, b


def test_engine_on_fixtures(spark):
    points = spark.createDataFrame([(k / 10, True, "s") for k in range(10)], "confidence double, label boolean, stratum string")
    got, b = bundle(spark, load({"reference_mode": "templated", "method": "both"}), calibration=points, recall=spark.createDataFrame([("Ferry Traffic", "diesel and crews")], src.RECALL))
    assert len(got) == 8 * len(src.CASES)
    assert got["well_sourced", "groundedness"].score == 1.0
    assert got["beside_the_point", "relevance"].score <= 0.5 and {"method_a", "method_b"} <= set(got["well_sourced", "relevance"].extra)
    assert 0 < got["one_part_of_four", "completeness"].extra["requirement_coverage"] < 1.0 and got["one_part_of_four", "completeness"].extra["recall_miss_rate"] == 0.0
    assert "recall_miss_rate" not in got["well_sourced", "completeness"].extra and got["well_sourced", "completeness"].assurance_mode == "templated"
    assert got["words_for_a_patch", "task_success"].score < 1.0
    assert got["denies_its_source", "hallucination"].score == 1.0 and got["denies_its_source", "hallucination"].extra["contradiction_rate"] > 0
    assert got["made_up_reference", "hallucination"].band == "R" and got["made_up_reference", "hallucination"].extra["gate_failed"] == 1.0
    assert got["reference_elsewhere", "source_attribution"].score == 0.0 and got["reference_elsewhere", "groundedness"].score > 0
    assert got["denied_publisher", "source_quality"].score < 0.6 and got["denied_publisher", "groundedness"].score > 0
    stamp = got["well_sourced", "groundedness"].extra
    assert stamp["conformal_band_low"] == 0.95 and stamp["conformal_abstained"] == 0.0 and "conformal_band_low" not in got["well_sourced", "accuracy"].extra
    assert b.summary.where("summary like '%groundedness: 1.000 [G]%' and summary like 'Summary of 8 dimensions over % atoms:%'").count() >= 1
    lines = b.report.where("eval_id = 0").first().report.split("\n")
    shown = [x.split("] ")[1].split()[0] for x in lines if x.startswith("  [")]
    assert shown == list(records.ORDER) and any(x.startswith("  atoms by tier: ") for x in lines)
    log = b.atoms.cache()
    assert {r.ts for r in log.select("ts").distinct().collect()} == {"1970-01-01"}
    done = atoms.replay(b.results, log).collect()
    assert len(done) == 8 * len(src.CASES) and all(r.ok for r in done)
    assert log.where("role = 'frozen_set'").count() == len(src.CASES)
    assert not all(r.ok for r in atoms.replay(b.results, log.withColumn("verdict", ~F.col("verdict"))).collect())


def test_no_claims_no_sources(spark):
    """Every evaluation has a row in all dimensions."""
    ev = spark.createDataFrame([(1, "What is it?", "Maybe it rains."), (2, "Why?", "")], "eval_id long, question string, answer string")
    chunks = src.fixture_chunks(src.fixtures(spark)).where("false")
    got = {(r.eval_id, r.dimension): r for r in engine.evaluate(ev, chunks).results.collect()}
    assert len(got) == 16
    for d in ("groundedness", "accuracy", "source_attribution", "source_quality", "hallucination"):
        assert (got[1, d].n, got[1, d].abstained, got[1, d].score, got[1, d].atom_ids) == (0, True, 0.0, [])
    assert got[1, "hallucination"].band == "G" and got[1, "relevance"].n == 0 and not got[1, "relevance"].abstained


def test_rescue_and_tree_change_results(spark):
    text = "Revenue was 100 dollars. Costs were 40 dollars. Profit was 60 dollars."
    ev = spark.createDataFrame([(1, "What was revenue?", text)], "eval_id long, question string, answer string")
    chunks = spark.createDataFrame([(1, 0, "c0", "Revenue was 100 dollars. Costs were 40 dollars.", None, None, None, None)], "eval_id long, chunk_ord int, chunk_id string, text string, url string, domain string, date string, author string")
    score = lambda settings: {r.dimension: r for r in engine.evaluate(ev, chunks, load(settings)).results.collect()}
    plain, rescued = score({})["accuracy"], score({"dag_rescue": True, "tree": True})
    assert plain.score == 2 / 3 and rescued["accuracy"].score == 1.0 and rescued["accuracy"].extra == {"successful_claims": 3.0, "axiom_derived_ratio": 2 / 3}
    tree = rescued["relevance"]
    assert tree.formula_id == "relevance_tree_capped_mean" and tree.extra["anchor_count"] >= 1 and tree.extra["anchor_band_low"] == 0.9


def test_a_proper_decline_abstains(spark):
    ev = spark.createDataFrame([(1, "What is the number nobody knows?", "I cannot answer: insufficient information, so I decline.")], "eval_id long, question string, answer string")
    chunks = src.fixture_chunks(src.fixtures(spark)).where("false")
    settings = load({"unanswerable": "affirm"})
    row = engine.evaluate(ev, chunks, settings).results.where("dimension = 'relevance'").first()
    assert (row.score, row.abstained, row.ci_low, row.ci_high, len(row.atom_ids)) == (1.0, True, 0.0, 1.0, 1)


def test_orphans_are_off_topic_first(spark):
    out = spark.createDataFrame([(1, "a", ["sky", "not", "blue"], True), (1, "b", ["sky", "blue", "today"], True), (1, "c", ["sky", "blue"], False), (1, "d", ["other"], True)], "eval_id int, claim_id string, tokens array<string>, on_topic boolean")
    anchor = spark.createDataFrame([(1, ["sky", "blue"])], "eval_id int, tokens array<string>")
    assert {r.claim_id: r.kind for r in graph.orphans(out, anchor).collect()} == {"a": "stranded_contradiction", "b": "stranded_support", "c": "off_topic", "d": "background"}


def test_numeric_edges_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(e, k, f"c{k}", f"It was {rng.choice([rng.randint(1, 30), round(rng.uniform(1, 9), 1), rng.randint(1, 9) * 10**9])} units.") for e in range(12) for k in range(10)]
    got = {(r.eval_id, r.src, r.dst) for r in graph.numeric_edges(spark.createDataFrame(rows, "eval_id int, ord int, claim_id string, text string")).collect()}
    want = set()
    for e in range(12):
        xs = [float(t.split()[2]) for i, _, _, t in rows if i == e]
        for n in range(10):
            two = next(((a, b) for a in range(n) for b in range(a + 1, n) if xs[n] in (xs[a] + xs[b], xs[a] - xs[b], xs[b] - xs[a])), None)
            want |= {(e, f"c{x}", f"c{n}") for x in two or ()}
    assert got == want and want


def test_numeric_edges_are_the_same_in_a_row_and_by_stretches(spark):
    import random

    rng = random.Random(9)
    rows = [(e, k, f"c{k}", rng.choice([f"It was {rng.randint(1, 20)} units.", f"It was {rng.randint(1, 9)}k.", "It was none."])) for e in range(12) for k in range(1 + e)]
    claims = spark.createDataFrame(rows, "eval_id int, ord int, claim_id string, text string")
    short, long, mixed = (sorted(tuple(r) for r in graph.numeric_edges(claims, few=few).collect()) for few in (64, 0, 7))
    assert short == long == mixed and short


def test_slot_counts_are_counted_as_letters_and_entailment_reads_a_known_negation(spark):
    from gaugeleaf.functions import text

    rows = spark.createDataFrame([([0, 63, 63, 5],), ([20250730 % 64],)], "v array<int>").withColumn("n", text.slot_counts(F.col("v")))
    assert [r.n for r in rows.collect()] == [[float(r.v.count(d)) for d in range(64)] for r in rows.collect()]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "array_remove" not in plan and "octet_length" in plan
    e = spark.createDataFrame([(["not", "open"], ["open"]), (["open"], ["open"]), (["shut"], ["open"])], "p array<string>, h array<string>")
    both = e.select(text.entailment(F.col("p"), F.col("h")).alias("x"), text.entailment(F.col("p"), F.col("h"), denies=text.negates(F.col("p"))).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both] and [r.x.label for r in both] == ["C", "E", "N"]


def test_quoted_units_need_no_look_at_the_sources(spark):
    evals = spark.createDataFrame([(1, "Was the catch large?", "The catch was not large and ice held."), (2, "Who kept it?", "")], "eval_id long, question string, answer string")
    said = ["A large catch came; ice_floe and Ida Lewis left. It was large, but they kept it.", "Catch of the day whereas ice melts! Who kept the ice?"]
    chunks = spark.createDataFrame([(e, i, x) for e in (1, 2) for i, x in enumerate(said)], "eval_id long, chunk_ord long, text string")
    drafted = tasks.draft(tasks.generated(evals), tasks.source_sentences(chunks))
    plain, quoted = (sorted(map(tuple, tasks.gated(drafted, evals, chunks, quoted=q).collect())) for q in (False, True))
    assert plain == quoted and any("bottom_up" in r for r in plain)


def test_tables_that_people_maintain(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"type": "x", "keywords": ["foo"], "requirements": [{"id": "r", "text": "the foo", "vital": true}]}\n{"type": "default", "requirements": []}\n')
    types = tables.requirement_types(spark, str(tmp_path / "t.jsonl"))
    ev = spark.createDataFrame([(1, "what foo?"), (2, "bar")], "eval_id int, question string")
    assert [(r.eval_id, r.req_id) for r in tasks.templated(ev, types).collect()] == [(1, "r")]
    (tmp_path / "d.jsonl").write_text('{"kind": "denied", "value": "bad.example"}\n')
    settings = load(tables.source_lists(spark, str(tmp_path / "d.jsonl")))
    row = spark.createDataFrame([("bad.example",)], "d string").select(dim.reliable(F.col("d"), settings).alias("ok")).first()
    assert settings.denied == ("bad.example",) and not row.ok
    (tmp_path / "p.jsonl").write_text('{"version": "1", "name": "realize", "text": "Say: {clause}"}\n')
    prompt = tables.prompts(spark, str(tmp_path / "p.jsonl"), "1")["realize"]
    assert spark.range(1).select(tables.realized(prompt, F.lit("a b")).alias("p")).first().p == "Say: a b"


def test_providers_plug_in(spark):
    providers.register("entailment", "never", lambda premise, hypothesis: F.struct(F.lit("N").alias("label"), F.lit(0.0).alias("raw")), "7")
    assert providers.stamp("entailment", "never") == ("never-entailment", "7")
    got, b = bundle(spark, load({"entailment": "never"}))
    assert got["well_sourced", "groundedness"].score == 0.0 and b.atoms.where("role = 'triplet_grounded' and model = 'never-entailment' and model_version = '7'").count() > 0
    text = spark.createDataFrame([("a red fox jumped over",), ("maybe a red fox jumped",), ("is it a red fox jumping?",)], "x string")
    assert [r.v for r in text.select(providers.verifiable(F.col("x")).alias("v")).collect()] == [True, False, False]
    made = text.limit(1).select(providers.generated("triplets", F.lit("Ann saw Bob and Bob ran")).alias("t"), providers.generated("repeat", F.lit("x"), 2).alias("r"), providers.generated("sentences", F.lit("A b. C d.")).alias("s")).first()
    assert (list(made.t), list(made.r), list(made.s)) == (["Ann | saw | Bob", "Bob | ran | "], ["x", "x"], ["A b.", "C d."])


def test_claims_and_coref(spark):
    ev = spark.createDataFrame([(1, "q", "Real Madrid won the final in 2024. Maybe they will win again. They sang loudly.")], "eval_id int, question string, answer string")
    assert pipeline.spans(ev).where("verifiable").count() == 2
    got = [r.text for r in pipeline.claims(ev).orderBy("sent_ord").collect()]
    assert got[0].startswith("Real Madrid won") and got[1] == "Maybe sang loudly."
    ev = spark.createDataFrame([(1, "q", "They won the champions cup final.")], "eval_id int, question string, answer string")
    ch = spark.createDataFrame([(1, 0, "Lionel Messi played for Argentina.")], "eval_id int, chunk_ord int, text string")
    assert "Argentina" in pipeline.claims(ev, ch).first().text


def test_triplet_without_chunks_is_neutral(spark):
    trip = spark.createDataFrame([(1, 0, 0, 0, "c", "red fox")], "eval_id int, sent_ord int, clause_ord int, trip_ord int, claim_id string, text string")
    ch = spark.createDataFrame([], "eval_id int, chunk_ord int, chunk_id string, text string, url string, domain string")
    row = support.triplet_labels(trip, support.labelled(trip, ch)).first()
    assert (row.label, row.confidence, row.chunks) == ("N", 0.0, [])


def test_top_k_keeps_order_on_ties(spark):
    trip = spark.createDataFrame([(1, 0, 0, 0, "c", "red fox")], "eval_id int, sent_ord int, clause_ord int, trip_ord int, claim_id string, text string")
    ch = spark.createDataFrame([(1, i, f"chunk-{i}", "red fox", None, None) for i in range(6)], "eval_id int, chunk_ord int, chunk_id string, text string, url string, domain string")
    got = support.prefilter(trip, ch, load({"groundedness_k": 2})).orderBy("rank").collect()
    assert [r.chunk_ord for r in got] == [0, 1]


def test_graph_operators(spark):
    links = spark.createDataFrame([(1, "B", "anchor"), (1, "A", "B"), (1, "x", "x")], "eval_id int, src string, dst string")
    anchor = spark.createDataFrame([(1, "anchor")], "eval_id int, node string")
    tree = {r.node: (r.depth, r.weight) for r in graph.support_tree(anchor, links).collect()}
    assert tree == {"anchor": (0, 1.0), "B": (1, 0.5), "A": (2, 0.25)}
    assert "A" not in {r.node for r in graph.support_tree(anchor, links, load({"max_hops": 1})).collect()}
    hub = spark.createDataFrame([(1, p, "hub") for p in ("p1", "p2", "p3", "p3")], "eval_id int, src string, dst string")
    nodes = spark.createDataFrame([(1, n) for n in ("hub", "p1")], "eval_id int, node string")
    assert {r.node: r.centrality for r in graph.centrality(nodes, hub).collect()} == {"hub": 3, "p1": 0}
    state = spark.createDataFrame([(1, "c1", True), (1, "c2", True), (1, "c3", False), (1, "c4", False)], "eval_id int, node string, axiom boolean")
    premises = spark.createDataFrame([(1, "c1", "c3"), (1, "c2", "c3")], "eval_id int, src string, dst string")
    assert {r.node: r.resolved for r in graph.rescue(state, premises).collect()} == {"c1": True, "c2": True, "c3": True, "c4": False}


def test_premises_are_reduced(spark):
    rows = [(1, 0, "a", "red fox"), (1, 1, "b", "red fox jumps"), (1, 2, "t", "red fox jumps")]
    got = {(r.src, r.dst) for r in graph.topical_edges(spark.createDataFrame(rows, "eval_id int, ord int, claim_id string, text string")).collect()}
    assert got == {("a", "b"), ("b", "t")}


def test_dedupe_is_a_greedy_fold(spark):
    rows = [(1, 0, "u0", "red fox jumps"), (1, 1, "u1", "red fox jumps"), (1, 2, "u2", "blue whale")]
    kept = tasks.dedupe(spark.createDataFrame(rows, "eval_id int, ord int, unit_id string, text string")).collect()
    assert {r.unit_id for r in kept} == {"u0", "u2"}


def test_atom_identity_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(1, "c1", True, 0), (1, "c2", False, 1)], "eval_id long, s string, v boolean, seq long")
    rows = atoms.emit(df, "groundedness", "grounded", F.col("v"), F.col("seq"), F.col("s"))
    import hashlib

    first = rows.where("subject = 'c1'").first()
    identity = "|".join(["c1", "grounded", "", "code", "True", "1.0", "", "groundedness.grounded", "code", "1", "None"])
    assert first.atom_id == hashlib.sha256(identity.encode()).hexdigest()[:16]
    src.append_atoms(rows, str(tmp_path / "log"), "json")
    back = src.read_atoms(spark, str(tmp_path / "log"), rows.schema, "json")
    assert back.count() == 2 and back.where("dimension = 'groundedness'").count() == 2
    results = rows.groupBy("eval_id", "dimension").agg(F.collect_list("atom_id").alias("atom_ids")).withColumn("formula_id", F.lit("mean")).withColumn("score", F.lit(0.5))
    assert atoms.replay(results, back).first().ok
    flipped = back.withColumn("verdict", F.lit(True))
    assert not atoms.replay(results, flipped).first().ok


def test_latest_is_the_last_written(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 2, "z"), ("a", 1, "y")], "atom_id string, seq long, v string")
    assert atoms.latest(df).first().v == "z"


def test_stream_counts_each_atom_once(spark, tmp_path):
    rows = [(1, "d", "a", True, 1.0), (1, "d", "a", True, 1.0), (1, "d", "b", False, 3.0)]
    df = spark.createDataFrame(rows, "eval_id long, dimension string, atom_id string, verdict boolean, weight double").withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = atom_stream.running_scores(atom_stream.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("running").first()
    assert (row.n, row.score, row.weighted) == (2, 0.5, 0.25)


def test_calibration_reader(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"id": "a", "claim": "x", "context": "y", "label": true}\n\n')
    row = src.calibration(spark, str(p)).first()
    assert row.stratum == "default" and src.recall_sample(spark, "").count() == 0


def test_rescue_follows_chains_of_any_length(spark):
    nodes = spark.createDataFrame([(1, k, k == 0) for k in range(68)], "eval_id int, node int, axiom boolean").coalesce(1)
    links = spark.createDataFrame([(1, k, k + 1) for k in range(67)], "eval_id int, src int, dst int").coalesce(1)
    assert graph.rescue(nodes, links).where("not resolved").count() == 0


def test_verifiers_and_task_types_of_a_table(spark, tmp_path):
    path = str(tmp_path / "types.json")
    spark.createDataFrame([(
        '{"type":"sum","keywords":["add up"],"outcomes":[{"id":"right","text":"the sum is right","verifier":"state","expected":"42","exact":true},{"id":"near","text":"names it","verifier":"state","expected":"42"},'
        '{"id":"long","text":"is short","verifier":"at_most","weight":2.0,"max_words":3}]}',
    ), ('{"type":"other","keywords":[],"outcomes":[{"id":"any","text":"says so","verifier":"constraint","min_words":1,"excludes":["sorry"],"includes":["so"]}]}',)], "value string").coalesce(1).write.text(path)
    types = tables.task_types(spark, path)
    assert [o[:4] for o in types["sum"][1]] == [("right", "the sum is right", "state", 1.0), ("near", "names it", "state", 1.0), ("long", "is short", "at_most", 2.0)]
    ev = spark.createDataFrame([(1, "Please add up 40 and 2", " 42 "), (2, "Add up all", "it is 42 in the end"), (3, "Hm", "so it is"), (4, "Hm", "so sorry")], "eval_id long, question string, answer string")
    known = spark.createDataFrame([], "eval_id long, known array<string>")
    with pytest.raises(Exception, match="unknown verifier at_most"):
        tasks.task_success(ev, known, types=types, default="other").collect()
    tasks.register_verifier("at_most", lambda _: F.size(F.split(F.trim("answer"), " ")) <= F.col("max_words"))
    try:
        with pytest.raises(ValueError):
            tasks.register_verifier("state", lambda _: F.lit(True))
        got = {r.eval_id: (r.task_type, r.achieved, r.required, r.score) for r in tasks.task_success(ev, known, types=types, default="other").collect()}
        assert got == {1: ("sum", 3, 3, 1.0), 2: ("sum", 1, 3, 0.25), 3: ("other", 1, 1, 1.0), 4: ("other", 0, 1, 0.0)}
    finally:
        del tasks._VERIFIERS["at_most"]
    bad = str(tmp_path / "bad.json")
    spark.createDataFrame([('{"type":"x","outcomes":[{"id":"a","verifier":"state"}]}',)], "value string").write.text(bad)
    with pytest.raises(ValueError):
        tables.task_types(spark, bad)
    assert tables.records(spark, path, "type string").count() == 2
    with pytest.raises(ValueError):
        tables.records(spark, path, "type string", most=1)


def test_long_type_tables_say_what_short_ones_do(spark):
    types = {f"t{i}": ([f"word{i}", f"w{i} x"], []) for i in range(300)} | {"tiny": (["qz"], []), "late": (["word7"], [])}
    asked = ["About word7 and word3", "WORD299!", "a w12 x here", "qz", "nothing", "", "word300 (has word30)"]
    ev = spark.createDataFrame(list(enumerate(asked)), "eval_id int, question string")
    long_ = {r.eval_id: r.qtype for r in tasks.classified(ev, types, "none", arms=1).collect()}
    short = {r.eval_id: r.qtype for r in tasks.classified(ev, types, "none", arms=1000).collect()}
    assert long_ == short == {0: "t3", 1: "t2", 2: "t12", 3: "tiny", 4: "none", 5: "none", 6: "t3"}


def test_clause_parser_and_coreference_plug_in(spark):
    providers.register("clauses", "commas", lambda x: F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != ""))
    providers.register("coreference", "never", lambda x, _: F.trim(x))
    ev = spark.createDataFrame([(1, "Why?", "Vienna grew fast, it was rich and big.")], "eval_id long, question string, answer string")
    texts = lambda settings: [r.text for r in pipeline.claims(ev, None, settings).orderBy("sent_ord", "clause_ord").collect()]
    assert texts(load({"clause_parser": "commas", "coreference": "never"})) == ["Vienna grew fast", "it was rich and big."]
    assert texts(Config()) == ["Vienna grew fast, it was rich", "big."]
    found = {r.kind: (r.ok, r.error) for r in providers.probe(spark, load({"clause_parser": "commas"})).collect()}
    assert set(found) == set(providers._PROVIDERS) and all(ok for ok, _ in found.values())
    providers.register("entailment", "broken", lambda a, b: F.raise_error(F.lit("model is gone")).cast("string"))
    found = {r.kind: (r.ok, r.error) for r in providers.probe(spark, load({"entailment": "broken", "resolver": "absent"})).collect()}
    assert not found["entailment"][0] and "gone" in found["entailment"][1] and found["resolver"] == (False, "KeyError: 'unknown resolver provider absent'") and found["judge"][0]


def test_settings_file_names_every_setting(spark, tmp_path):
    import json
    from dataclasses import asdict

    from gaugeleaf.config import load_file

    values = {k: v for k, v in asdict(Config()).items() if v is not None} | {"min_n": 4, "edge_tau": 1}
    write = lambda name, v: (tmp_path / name).write_text(json.dumps(v)) and str(tmp_path / name)
    assert load_file(spark, write("whole.json", values)) == load({"min_n": 4, "edge_tau": 1.0})
    for broken in ({k: v for k, v in values.items() if k != "min_n"}, values | {"more": 1}, values | {"min_n": "four"}, values | {"tree": 1}):
        with pytest.raises(ValueError):
            load_file(spark, write("broken.json", broken))


def test_claims_without_exported_labels(spark):
    sets = spark.createDataFrame([(1, "a", "The bridge is open tonight", None), (1, "b", "The dam burst at noon", None), (1, "c", "The bridge is not open", None), (2, "d", "Nobody knows it", None), (1, "e", "kept", True)],
                                 "eval_id long, claim_id string, text string, grounded boolean")
    chunks = spark.createDataFrame([(1, "A bridge is open"), (1, "until tonight"), (3, "x")], "eval_id long, text string")
    held = lambda settings: {r.claim_id: r.entailed for r in dim.local_support(sets, chunks, settings).collect()}
    assert held(Config()) == {"a": True, "b": False, "c": False, "d": True} and held(load({"residual": "deny"}))["d"] is False
