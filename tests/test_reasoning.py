"""Conditions, values, errors, cycles, contradictions, order statistics, spans and the keyed log against plain Python."""

import itertools
import math
import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.functions import scoring
from gaugeleaf.operators import graph, reasoning, spans
from gaugeleaf.plans import reasoning_queries as rq
from gaugeleaf.sources import atom_log
from gaugeleaf.streaming import atom_stream

CLAIM = "eval_id int, ord int, claim_id string, text string"


# ---- cycles


def plain_cut(links, order):
    links, back = set(links), None
    while True:
        out = defaultdict(set)
        for a, b in links:
            out[b].add(a)

        def leads_to(node):
            seen, todo = {node}, [node]
            while todo:
                for x in out[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            return seen

        for node in sorted(order, key=order.get):
            gone = {(a, b) for a, b in links if a == node and b in leads_to(node)}
            if gone:
                links -= gone
                break
        else:
            return links


def test_cuts_equal_brute_force(spark):
    r, links, want = random.Random(1), [], set()
    for e in range(25):
        n = r.randint(2, 14)
        own = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 2 * n))}
        own |= {(i, i + 1) for i in range(n - 1) if r.random() < 0.7}
        links += [(e, a, b) for a, b in own]
        want |= {(e, a, b) for a, b in plain_cut(own, {i: i for i in range(n)})}
    order = spark.createDataFrame([(e, i, i) for e in range(25) for i in range(14)], "eval_id int, node int, ord int")
    got = graph.cut_cycles(spark.createDataFrame(links, "eval_id int, src int, dst int"), order).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) < len(set(links))


def test_repeated_claims_have_no_cycles(spark):
    rows = [(1, 0, "x", "Revenue rose strongly"), (1, 1, "y", "Revenue rose strongly today"), (1, 2, "x", "Revenue rose strongly"), (2, 0, "p", "Sales fell"), (2, 1, "q", "Sales fell again")]
    got = {tuple(x) for x in graph.edges(spark.createDataFrame(rows, CLAIM)).collect()}
    assert (1, "y", "x") in got and (1, "x", "y") not in got  # the first claim of the cycle loses its link into it
    assert {x for x in got if x[0] == 2} == {tuple(x) for x in graph.edges(spark.createDataFrame(rows[3:], CLAIM)).collect()}
    three = [(3, i, x, f"Costs of steel {w}") for i, (x, w) in enumerate([("a", ""), ("b", "rose"), ("c", "rose fast"), ("a", "")])]
    kept = {(a, b) for _, a, b in graph.edges(spark.createDataFrame(three, CLAIM)).collect()}
    assert kept == plain_cut(kept, {"a": 0, "b": 1, "c": 2}) and all(a != "a" for a, _ in kept)


def test_rescue_of_random_graphs(spark):
    r, nodes, links, want = random.Random(2), [], [], {}
    for e in range(20):
        n = r.randint(1, 15)
        axiom = {i: r.random() < 0.4 for i in range(n)}
        own = {(r.randrange(n + 2), r.randrange(n)) for _ in range(r.randint(0, 2 * n))}  # some from nodes that are not there
        ok = {i for i in axiom if axiom[i]}
        while new := {i for i in axiom if i not in ok and (ps := [a for a, b in own if b == i]) and all(p in ok for p in ps)}:
            ok |= new
        nodes += [(e, i, axiom[i]) for i in axiom]
        links += [(e, a, b) for a, b in own] * 2
        want |= {(e, i): i in ok for i in axiom}
    got = graph.rescue(spark.createDataFrame(nodes, "eval_id int, node int, axiom boolean"), spark.createDataFrame(links, "eval_id int, src int, dst int")).collect()
    assert {(x.eval_id, x.node): x.resolved for x in got} == want and len(got) == len(want)


# ---- sufficiency


def plain_condition(premises, target, budget):
    neg = lambda x: any(w in c.NEGATION for w in x)

    def holds(some):
        union = set().union(*some) if some else set()
        raw = len(target & union) / len(target) if target else 0.0
        return raw >= 0.5 and not (raw >= 0.5 and neg(union) != neg(target))

    n = len(premises)
    alone = sum(holds([p]) for p in premises)
    needed = 1 if n == 1 else sum(not holds(premises[:i] + premises[i + 1 :]) for i in range(n))
    if needed == n and (alone == 0 or n == 1):
        return alone, needed, "AND", n
    if alone > 1:
        return alone, needed, "OR", 1
    for k in range(2, n) if n <= budget else []:
        if all(holds(s) for s in itertools.combinations(premises, k)) and not any(holds(s) for s in itertools.combinations(premises, k - 1)):
            return alone, needed, "k-of-n", k
    return alone, needed, "uncertain", n


def test_conditions_equal_all_subsets(spark):
    r, rows = random.Random(3), []
    words = ["w%d" % i for i in range(8)]
    for i in range(400):
        target = sorted(r.sample(words, r.randint(2, 6)) + (["not"] if r.random() < 0.2 else []))
        ps = [sorted(set(r.sample(words, r.randint(1, 3)) + (["not"] if r.random() < 0.15 else []))) for _ in range(r.randint(1, 7))]
        if plain_condition(ps, set(target), 6) and len(set(target) & set().union(*ps)) * 2 >= len(target) and ("not" in target) == any("not" in p for p in ps):
            rows.append((i, 9, "t", target, [(k, f"p{k}", p) for k, p in enumerate(ps)]))
    rows.append((1000, 9, "t", ["a", "b", "c", "d"], [(0, "p0", ["a"]), (1, "p1", ["b"]), (2, "p2", ["c"])]))  # any two of three
    frame = spark.createDataFrame(rows, "eval_id int, ord int, claim_id string, tokens array<string>, ps array<struct<ord:int,id:string,tokens:array<string>>>")
    got = {x.eval_id: (x.alone, x.load_bearing, x.condition, x.k) for x in reasoning.sufficiency(frame).collect()}
    want = {i: plain_condition([set(p[2]) for p in ps], set(target), 6) for i, _, _, target, ps in rows}
    assert got == want and got[1000] == (0, 0, "k-of-n", 2) and {x[2] for x in got.values()} == {"AND", "OR", "k-of-n", "uncertain"}


# ---- values


def test_values_of_random_graphs(spark):
    r, nodes, links, want = random.Random(4), [], [], {}
    for e in range(15):
        n = r.randint(1, 14)
        parents = {i: sorted(r.sample(range(i), min(i, r.choice([0, 1, 2, 3])))) for i in range(n)}
        found = {}
        for i in range(n):
            truth = round(r.random(), 3) if not parents[i] or r.random() < 0.2 else None
            truth = None if not parents[i] and r.random() < 0.1 else truth
            ratio, k, own = r.choice([0.5, 1.0]), r.choice([None, 1, 2]), r.choice([None, 0.1, 0.2, 0.3])
            nodes.append((e, i, truth, ratio, k, own))
            links += [(e, p, i) for p in parents[i]]
            ps = [found[p] for p in parents[i]] if truth is None else []
            if not ps:
                found[i] = dict(node=i, value=truth or 0.0, factor=truth or 0.0, limiting=None, error=own or 0.0, dominant=i if own is not None else None, covered=own is not None, layer=0)
                continue
            good = [p for p in ps if p["value"] >= 0.5]
            used = good if k is not None and k < len(ps) and len(good) >= k else ps
            least = min(used, key=lambda p: (p["value"], p["node"]))
            worst = max((p for p in used if p["dominant"] is not None), key=lambda p: (p["error"], p["dominant"]), default=None)
            mine = own is not None and (worst is None or own >= worst["error"])
            found[i] = dict(node=i, value=ratio * least["value"], factor=least["value"], limiting=least["node"], error=max(own or 0.0, worst["error"] if worst else 0.0),
                            dominant=i if mine else worst and worst["dominant"], covered=own is not None and all(p["covered"] for p in used), layer=1 + max(p["layer"] for p in ps))
        want |= {(e, i): found[i] for i in found}
    nodes += [(99, 0, None, 1.0, None, None), (99, 1, None, 1.0, None, None)]
    links += [(99, 0, 1), (99, 1, 0)]
    got = reasoning.node_values(spark.createDataFrame(nodes, "eval_id int, node int, truth double, ratio double, k int, error double"), spark.createDataFrame(links, "eval_id int, src int, dst int")).collect()
    for x in got:
        if x.eval_id == 99:
            assert x.value is None and x.layer is None
        else:
            assert {f: x[f] for f in want[x.eval_id, x.node]} == want[x.eval_id, x.node] and x.committed == (x.value >= 0.5)
    assert len(got) == len(nodes)


def test_error_rates_and_profile(spark):
    rows = [("edge", i % 10 != 0) for i in range(100)] + [("axiom", True)] * 50 + [("frame", False)] * 5
    got = {x.kind: (x.n, x.wrong, x.error) for x in reasoning.error_rates(spark.createDataFrame(rows, "kind string, right boolean")).collect()}
    assert got["frame"] == (5, 5, None) and got["axiom"][1] == 0 and 0.1 < got["edge"][2] < 0.2 and 0 < got["axiom"][2] < 0.1
    values = spark.createDataFrame([(1, 1, True, 0.1, 7, True), (1, 2, True, 0.3, 8, False), (1, 3, False, 0.9, 9, True), (2, 1, False, 0.0, None, None)], "eval_id int, node int, committed boolean, error double, dominant int, covered boolean")
    flags = spark.createDataFrame([(1, 1, "missing_edge"), (1, 1, "missing_edge"), (1, 2, "missing_edge"), (1, 2, "frame_uncertain")], "eval_id int, node int, flag string")
    one, two = reasoning.error_profile(values, flags).orderBy("eval_id").collect()
    assert (one.nodes, one.error, one.dominant, one.uncovered, one.flags) == (3, 0.3, 8, 1, {"missing_edge": 2, "frame_uncertain": 1}) and (two.error, two.uncovered, two.flags) == (None, 1, {})


# ---- contradictions


def plain_contradictions(rows):
    out, neg = {}, lambda x: any(w in c.NEGATION for w in x)
    for (e, a, x), (f, b, y) in itertools.permutations(rows, 2):
        if e == f and x and len(x & y) / len(x) >= 0.5 and neg(x) != neg(y):  # y contradicts x
            key = (e, min(a, b), max(a, b))
            out[key] = min(out.get(key, 1 << 60), b)
    return out


def test_contradictions_equal_all_pairs(spark):
    r, rows = random.Random(5), []
    words = ["alpha", "beta", "gamma", "delta", "costs", "sales", "never", "not"]
    for e in range(6):
        rows += [(e, i, " ".join(r.sample(words, r.randint(1, 6)))) for i in range(r.randint(1, 25))]
    tokens = [(x.eval_id, x.ord, set(x.tk)) for x in spark.createDataFrame(rows, "eval_id int, ord int, text string").select("eval_id", "ord", rq.t.tokens(F.col("text")).alias("tk")).collect()]
    for block in (2, 256):
        got = reasoning.contradictions(spark.createDataFrame(rows, "eval_id int, ord int, text string"), block=block).collect()
        assert {(x.eval_id, x.first, x.second): x.by for x in got} == plain_contradictions(tokens) and len(got) == len({tuple(x)[:3] for x in got})
    one, two = reasoning.consistency(spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "eval_id int, ord int"), spark.createDataFrame([(1, 0, 1, 1)], "eval_id int, first int, second int, by int")).orderBy("eval_id").collect()
    assert tuple(one) == (1, 2, 1, 2, 0.0, False) and tuple(two) == (2, 1, 0, 0, 1.0, True)


def test_a_crowded_term_is_split(spark):
    rows = [(1, i, f"report {i} says {'not ' if i % 2 else ''}thing{i // 2}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "eval_id int, ord int, text string")
    got = reasoning.contradictions(frame).collect()
    want = plain_contradictions([(1, i, {"report", str(i), "says", f"thing{i // 2}"} | ({"not"} if i % 2 else set())) for i in range(40)])
    assert {(x.eval_id, x.first, x.second) for x in got if x.second < 40} == set(want) and len(got) >= 3000


def shuffled(spark, run):
    """Bytes that run() shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_contradictions_leave_claims_at_home(spark):
    r, rows = random.Random(7), []
    for e in range(60):
        rows += [(e, i, " ".join(["not"] * (i % 5 == 3) + [f"w{r.randrange(10**7)}" for _ in range(12)])) for i in range(40)]
        rows += [(e, 100 + i, f"not {rows[-1 - i][2]}") for i in range(3, 6)]
    frame = spark.createDataFrame(rows, "eval_id int, ord int, text string").localCheckpoint()
    text = sum(len(x[2]) for x in rows)
    for block, most in (256, 5), (16, 10):  # 34 times with each claim under all of its tokens
        assert shuffled(spark, lambda b=block: reasoning.contradictions(frame, block=b).collect()) < most * text


def test_a_share_that_rounds_up_loses_no_contradiction(spark):
    words = [f"word{i}" for i in range(100)]
    rows = [(1, 0, " ".join(words)), (1, 1, " ".join(["not", *words[:55], *(f"else{i}" for i in range(100))]))]  # 0.55 * 100 is 55.00000000000001
    rows.append((1, 2, "else"))  # two claims of a kind, so a block of one is too small
    for block in (1, 256):
        got = reasoning.contradictions(spark.createDataFrame(rows, "eval_id int, ord int, text string"), replace(c.Config(), contra_tau=0.55), block).collect()
        assert [tuple(x) for x in got] == [(1, 0, 1, 1)]


# ---- order statistics, calibration


def test_order_statistics(spark):
    r, rows = random.Random(6), []
    for g in range(5):
        rows += [(f"g{g}" if g else None, r.choice([r.uniform(-1, 1), round(r.random(), 1), 0.25])) for _ in range(r.randint(1, 400))]
    rows += [("nulls", None)]
    by = defaultdict(list)
    for g, x in rows:
        by[g] += [] if x is None else [x]
    frame = spark.createDataFrame(rows, "g string, x double")
    for share in (0.0, 0.3, 0.5, 1.0):
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
        for levels, width in ((2, 4096), (3, 4)):
            got = {x.g: (x.n, x.value) for x in scoring.order_statistic(frame, ["g"], "x", rank, levels, width).collect()}
            assert got == {g: (len(v), sorted(v)[max(1, math.ceil(len(v) * share)) - 1]) for g, v in by.items() if v}


def test_order_statistic_sorts_no_group(spark):
    frame = spark.range(200_000).select(F.lit("all").alias("g"), (F.rand(3)).alias("x"))
    got = scoring.order_statistic(frame, ["g"], "x", F.lit(190_001)).collect()[0]
    assert got.n == 200_000 and got.value == sorted(x.x for x in frame.select("x").collect())[190_000]


def test_calibration_error(spark):
    rows = [("a", 0.95, True), ("a", 0.95, False), ("a", 1.0, True), ("b", 0.2, False), ("b", 0.29, True), (None, 0.0, False), ("b", None, True), ("b", 0.5, None)]
    table = scoring.reliability(spark.createDataFrame(rows, "stratum string, confidence double, label boolean"))
    got = {x.stratum: x for x in scoring.calibration_error(table, 3).collect()}
    assert table.where("n = 0").count() > 0 and table.groupBy("stratum").count().where("count <> 10").count() == 0
    assert got["a"].n == 3 and abs(got["a"].ece - abs(2 / 3 - 2.9 / 3)) < 1e-12 and got["b"].abstained and got["b"].ece is None and got[None].n == 6
    bins = [(0.95, 1, 3, 2.9, 2), (0.245, 1, 2, 0.49, 1), (0.0, 1, 1, 0.0, 0)]
    assert abs(got[None].ece - sum(abs(hits / n - conf / n) * n for _, _, n, conf, hits in bins) / 6) < 1e-12


# ---- spans


def test_widest_spans_equal_all_pairs(spark):
    r, rows = random.Random(7), []
    for d in range(8):
        rows += [(d, a := r.randrange(60), a + r.randrange(25), f"s{i}") for i in range(r.randint(1, 40))]
    rows += [(9, 0, 10, "x"), (9, 0, 10, "y"), (9, 2, 3, "z"), (10, 5, 5, "one")]
    own = defaultdict(list)
    for d, a, b, x in rows:
        own[d].append((a, b, x))
    want = {(d, *s) for d, held in own.items() for i, s in enumerate(held) if not any(j != i and o[0] <= s[0] and o[1] >= s[1] for j, o in enumerate(held))}
    frame = spark.createDataFrame(rows, "doc_id int, start int, end int, name string")
    for width in (3, 4096):
        assert {tuple(x) for x in spans.widest(frame, ["doc_id"], width).collect()} == want and (10, 5, 5, "one") in want


# ---- the keyed log


def test_log_shows_whole_versions_only(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "eval_id long, dimension string, seq long, atom_id string, verdict boolean, weight double"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    shown = lambda dims=None: {(x.atom_id, x.verdict, x.weight) for x in atom_log.read(spark, path, schema, dimensions=dims).collect()}
    assert shown() == set() and atom_log.write(rows((1, "a", 0, "k1", True, 1.0), (1, "b", 1, "k2", True, 1.0)), path) == 0
    assert atom_log.write(rows((1, "a", 5, "k1", False, 2.0)), path) == 1 and shown() == {("k1", False, 2.0), ("k2", True, 1.0)}
    half = tmp_path / "log" / "v=00000000000000000002"
    rows((1, "a", 9, "k2", False, 9.0)).write.partitionBy("dimension").parquet(str(half))
    (half / "_SUCCESS").unlink()  # as a writer that was lost leaves it
    before = atom_log.read(spark, path, schema)
    assert shown() == {("k1", False, 2.0), ("k2", True, 1.0)} and shown(["b"]) == {("k2", True, 1.0)}
    assert atom_log.fold(spark, path, schema) == 1 and shown() == {("k1", False, 2.0), ("k2", True, 1.0)} == {(x.atom_id, x.verdict, x.weight) for x in before.collect()}
    assert atom_log.write(rows((1, "a", 7, "k1", True, 7.0)), path, 1) == 1 and ("k1", False, 2.0) in shown()  # folded: stays
    assert atom_log.write(rows((1, "b", 1, "k2", False, 3.0)), path) == 2 and shown() == {("k1", False, 2.0), ("k2", False, 3.0)}
    assert atom_log.write(rows((1, "b", 1, "k2", False, 4.0)), path, 2) == 2 and shown() == {("k1", False, 2.0), ("k2", False, 4.0)}  # the batch again
    assert atom_log.vacuum(spark, path) == 2 and shown() == {("k1", False, 2.0), ("k2", False, 4.0)} and atom_log.versions(spark, path) == (1, [2])


def test_streamed_formulas_equal_the_batch(spark, tmp_path):
    r, rows = random.Random(8), []
    roles = ["unit", "axiom", "derived", "responsive", "claim_relevance", "outcome", "on_ask_answer", "abstain_relevant", "impossible_success"]
    for f in scoring.formula_ids()[:9]:
        for e in range(4):
            rows += [(e, "d", f, f"{f}-{e}-{i}", i, f"s{r.randrange(3)}", r.choice(roles[:7] if r.random() < 0.9 else roles), r.random() < 0.6, float(r.randint(1, 4)), 0) for i in range(r.randint(1, 25))]
    schema = atom_stream.SCORED
    frame = spark.createDataFrame([(*x[:-1], None) for x in rows], schema).withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    r.shuffle(rows)
    for batch in range(4):
        ids = [x[3] for x in rows[batch::4]] + ([x[3] for x in rows[0::4]][:20] if batch == 2 else [])  # some come twice
        frame.where(F.col("atom_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "states")
    atom_stream.keep_scores(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), path, str(tmp_path / "check")).awaitTermination()
    got = {(x.eval_id, x.formula_id): x.score for x in atom_stream.kept_scores(spark, path).collect()}
    want = {(x.eval_id, x.formula_id): x.score for x in scoring.by_formula(frame.drop("at"), atom_stream.GROUP).collect()}
    assert got == pytest.approx(want) and len(want) == 36 and len(atom_log.versions(spark, path)[1]) == 4


def test_spans_are_dealt_by_number_so_that_small_sizes_stay_apart(spark):
    from gaugeleaf.plans import reasoning_queries

    assert "REPARTITION_BY_NUM" in reasoning_queries.clause_spans(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
