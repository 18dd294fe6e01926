"""What holds a derived claim up: conditions on premises, values and errors carried along a claim graph, contradictions within an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.config import Config
from gaugeleaf.functions import scoring
from gaugeleaf.functions import text as t
from gaugeleaf.operators.graph import shared_checkpoint

AND, OR, K_OF_N, UNCERTAIN = "AND", "OR", "k-of-n", "uncertain"


# ---- sufficiency


def _holds(covered: Column, size: Column, negated: Column, target_negated: Column, tau: float) -> Column:
    """The entailment test of edges, from how many of a claim's tokens premises cover and whether a premise negates."""
    raw = F.when(size == 0, 0.0).otherwise(covered / size)
    return (raw >= tau) & ~((raw >= 0.5) & (negated != target_negated))


def sufficiency(sets: DataFrame, settings: Config = Config(), budget: int = 6) -> DataFrame:
    """eval_id, ord, claim_id, premises, alone, load_bearing, condition, k: how a claim's premises (graph.premise_sets()) hold it up.

    A premise is load-bearing if the others don't entail the claim without it, which shows in the tokens that it alone covers. AND: all
    are. OR: several entail the claim by themselves. k-of-n: any k do and no k - 1; found by trying all subsets of at most `budget`
    premises, whose tokens are bits. Anything else is uncertain, and counts as AND with k of all.
    """
    negation = F.array(*map(F.lit, c.NEGATION))
    n, tau = F.size("ps"), settings.edge_tau
    rows = sets.select("eval_id", "ord", "claim_id", "tokens", "ps", n.alias("premises"), F.arrays_overlap("tokens", negation).alias("negated"))
    holders = lambda x: F.filter(F.transform("ps", lambda p, i: F.when(F.array_contains(p["tokens"], x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("held", F.transform("tokens", holders)).withColumn("against", F.transform("ps", lambda p: F.arrays_overlap(p["tokens"], negation)))
    rows = rows.withColumn("size", F.size("tokens")).withColumn("covered", F.size(F.filter("held", lambda h: F.size(h) > 0))).withColumn("n_against", F.size(F.filter("against", lambda x: x)))
    test = lambda covered, negated: _holds(covered, F.col("size"), negated, F.col("negated"), tau)
    each = F.sequence(F.lit(0), F.col("premises") - 1)
    lone = F.filter(each, lambda i: test(F.size(F.filter("held", lambda h: F.array_contains(h, i))), F.get("against", i)))
    sole = lambda i: F.size(F.filter("held", lambda h: (F.size(h) == 1) & (F.get(h, F.lit(0)) == i)))
    needed = F.filter(each, lambda i: ~test(F.col("covered") - sole(i), F.col("n_against") - F.get("against", i).cast("int") > 0))
    rows = rows.withColumn("alone", F.size(lone)).withColumn("load_bearing", F.when(F.col("premises") == 1, 1).otherwise(F.size(needed)))
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    bits = F.transform("held", lambda h: F.aggregate(h, F.lit(0), lambda a, i: a.bitwiseOR(bit(i))))
    some = F.aggregate(F.filter(each, lambda i: F.get("against", i)), F.lit(0), lambda a, i: a.bitwiseOR(bit(i)))
    small = F.col("premises") <= budget
    rows = rows.withColumn("bits", F.when(small, bits)).withColumn("some", F.when(small, some))
    subset = lambda s: test(F.size(F.filter("bits", lambda b: b.bitwiseAND(s) != 0)), F.col("some").bitwiseAND(s) != 0)
    tried = F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.col("premises")) - 1), lambda s: F.struct(F.bit_count(s).alias("of"), subset(s).alias("ok")))
    rows = rows.withColumn("tried", F.when(small & (F.col("premises") > 1), tried))
    threshold = F.filter(F.sequence(F.lit(2), F.col("premises")), lambda k: F.forall("tried", lambda x: F.when(x["of"] == k, x["ok"]).when(x["of"] == k - 1, ~x["ok"]).otherwise(True)))
    rows = rows.withColumn("least", F.when(F.col("tried").isNotNull(), F.get(threshold, F.lit(0))))
    all_ = (F.col("load_bearing") == F.col("premises")) & ((F.col("alone") == 0) | (F.col("premises") == 1))
    condition = F.when(all_, AND).when(F.col("alone") > 1, OR).when(F.col("least") < F.col("premises"), K_OF_N).otherwise(UNCERTAIN)
    rows = rows.withColumn("condition", condition)
    k = F.when(F.col("condition") == OR, 1).when(F.col("condition") == K_OF_N, F.col("least")).otherwise(F.col("premises"))
    return rows.select("eval_id", "ord", "claim_id", "premises", "alone", "load_bearing", "condition", k.alias("k"))


# ---- values and errors along a graph


def node_values(nodes: DataFrame, links: DataFrame, tau: float = 0.5) -> DataFrame:
    """eval_id, node, value, ratio, factor, limiting, committed, error, dominant, layer, covered: truth carried along links as its weakest part.

    nodes: eval_id, node, truth (of what rests on no premise, else null), ratio (share of a claim's parts that are filled), k (how many
    premises it takes; null: all) and error (the measured error rate of how it was decided; null: never measured). links: eval_id, src, dst.

    A derived node's factor is the least value among the premises that count: all, or, where k committed ones (value of tau or
    more) are enough and there, the committed ones; limiting names the premise that has it (the least one of equals) and value is ratio *
    factor. A node without premises has its truth, or 0 if it has none. error is the largest on the way of what counts, the node's own included,
    and dominant the node that brought it in; covered is false if some rate on the way was never measured, and such rates are left out
    of error. Nodes on a cycle, or above one, stay null with layer null.

    Layer after layer: a round joins the nodes valued by the last one with the links that wait for them, and links of valued nodes go.
    """
    own = nodes.select("eval_id", "node", "truth", F.coalesce("ratio", F.lit(1.0)).alias("ratio"), "k", F.col("error").alias("own_error"))
    links = links.select("eval_id", "src", "dst").distinct().join(own.select("eval_id", F.col("node").alias("src")), ["eval_id", "src"], "left_semi")
    links = links.join(own.where("truth is null").select("eval_id", F.col("node").alias("dst")), ["eval_id", "dst"], "left_semi")
    fields = ("value", "error", "dominant", "covered")
    waiting = shared_checkpoint(links.select("eval_id", "src", "dst", *(F.lit(None).cast(kind).alias(f) for f, kind in zip(fields, ("double", "double", links.schema["src"].dataType, "boolean")))))
    tips = own.join(links.select("eval_id", F.col("dst").alias("node")).distinct(), ["eval_id", "node"], "left_anti")
    ratio = F.when(F.col("truth").isNull(), F.col("ratio")).otherwise(1.0)
    done = tips.select(
        "eval_id", "node", F.coalesce("truth", F.lit(0.0)).alias("value"), ratio.alias("ratio"), F.coalesce("truth", F.lit(0.0)).alias("factor"), F.lit(None).cast(links.schema["src"].dataType).alias("limiting"),
        F.coalesce("own_error", F.lit(0.0)).alias("error"), F.when(F.col("own_error").isNotNull(), F.col("node")).alias("dominant"), F.col("own_error").isNotNull().alias("covered"), F.lit(0).alias("layer"),
    )
    frontier = shared_checkpoint(done)
    valued, layer = [frontier], 0
    while not frontier.isEmpty():
        layer += 1
        new = frontier.select("eval_id", F.col("node").alias("src"), *(F.col(f).alias(f"new_{f}") for f in fields))
        met = waiting.join(new, ["eval_id", "src"], "left").select("eval_id", "src", "dst", *(F.coalesce(f, f"new_{f}").alias(f) for f in fields))
        met = shared_checkpoint(met)
        sums = lambda of: F.min(F.when(of, F.struct("value", "src")))
        worst = lambda of: F.max(F.when(of & F.col("dominant").isNotNull(), F.struct("error", "dominant")))
        good, every = F.col("value") >= tau, F.lit(True)
        parts = met.groupBy("eval_id", F.col("dst").alias("node")).agg(
            F.bool_and(F.col("value").isNotNull()).alias("ready"), F.count_if(good).alias("n_good"), F.count("*").alias("n"), sums(every).alias("all_min"), sums(good).alias("good_min"),
            worst(every).alias("all_worst"), worst(good).alias("good_worst"), F.bool_and("covered").alias("all_covered"), F.bool_and(F.when(good, F.col("covered"))).alias("good_covered"),
        )
        rows = parts.where("ready").join(own, ["eval_id", "node"])
        enough = F.coalesce((F.col("n_good") >= F.col("k")) & (F.col("k") < F.col("n")), F.lit(False))
        pick = lambda name: F.when(enough, F.col(f"good_{name}")).otherwise(F.col(f"all_{name}"))
        rows = rows.select("eval_id", "node", "ratio", "own_error", pick("min").alias("m"), pick("worst").alias("w"), pick("covered").alias("c"))
        mine = F.col("own_error").isNotNull() & (F.col("w").isNull() | (F.col("own_error") >= F.col("w.error")))
        frontier = shared_checkpoint(rows.select(
            "eval_id", "node", (F.col("ratio") * F.col("m.value")).alias("value"), "ratio", F.col("m.value").alias("factor"), F.col("m.src").alias("limiting"),
            F.greatest(F.coalesce("own_error", F.lit(0.0)), F.coalesce("w.error", F.lit(0.0))).alias("error"), F.when(mine, F.col("node")).otherwise(F.col("w.dominant")).alias("dominant"),
            (F.col("own_error").isNotNull() & F.col("c")).alias("covered"), F.lit(layer).alias("layer"),
        ))
        valued.append(frontier)
        waiting = met.join(frontier.select("eval_id", F.col("node").alias("dst")), ["eval_id", "dst"], "left_anti")
    out = valued[0]
    for rows in valued[1:]:
        out = out.unionByName(rows)
    return own.select("eval_id", "node").join(out, ["eval_id", "node"], "left").withColumn("committed", F.col("value") >= tau)


def error_rates(decisions: DataFrame, least: int = 30) -> DataFrame:
    """kind, n, wrong, error: the upper end of the 95 % interval of how often decisions of a kind were wrong; null below `least` of them.

    decisions: kind, right. A kind that was hardly measured gets no number.
    """
    n = decisions.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~F.col("right")).alias("wrong"))
    _, high = scoring.wilson(F.col("wrong"), F.col("n"))
    return n.select("kind", "n", "wrong", F.when(F.col("n") >= least, high).alias("error"))


def error_profile(values: DataFrame, flags: DataFrame) -> DataFrame:
    """eval_id, nodes, error, dominant, uncovered and a count for each kind of flag: two kinds of error, never added up.

    error is the largest that a committed node carries and dominant the node it comes from. flags: eval_id, node, flag; what may
    have been missed is counted, not measured.
    """
    worst = F.max(F.when(F.col("committed") & F.col("dominant").isNotNull(), F.struct("error", "dominant")))
    rows = values.groupBy("eval_id").agg(F.count("*").alias("nodes"), worst.alias("w"), F.count_if(~F.coalesce("covered", F.lit(False))).alias("uncovered"))
    counts = flags.groupBy("eval_id", "flag").agg(F.count_distinct("node").alias("n")).groupBy("eval_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n")))).alias("flags"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return rows.join(counts, "eval_id", "left").select("eval_id", "nodes", F.col("w.error").alias("error"), F.col("w.dominant").alias("dominant"), "uncovered", F.coalesce("flags", none).alias("flags"))


# ---- contradictions


def contradictions(claims: DataFrame, settings: Config = Config(), block: int = 256) -> DataFrame:
    """eval_id, first, second, by: pairs of claims (their ord) of one answer of which one contradicts the other, by its claim's ord.

    claims: eval_id, ord, text. A claim is contradicted only by one that covers a share contra_tau of its tokens and differs in negation. In an
    answer with at most `block` claims of each kind all meet under the answer; those of longer answers meet under tokens.
    """
    negation = F.array(*map(F.lit, c.NEGATION))
    rows = claims.select("eval_id", "ord", t.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).withColumn("neg", F.arrays_overlap("tokens", negation))
    sides = rows.groupBy("eval_id").agg(F.count_if("neg").alias("denied"), F.count_if(~F.col("neg")).alias("stated")).where("denied > 0 AND stated > 0")
    rows = shared_checkpoint(rows.join(sides.select("eval_id", (F.greatest("denied", "stated") > block).alias("long")), "eval_id"))
    short = rows.where("NOT long").select("eval_id", "ord", "tokens", "neg")
    share = F.size(F.array_intersect("a.tokens", "b.tokens")) / F.size("a.tokens")
    met = short.alias("a").join(short.alias("b"), "eval_id").where((F.col("a.neg") != F.col("b.neg")) & (F.col("a.ord") != F.col("b.ord")))  # both sides are one shuffle
    found = met.where(share >= settings.contra_tau).select("eval_id", "a.ord", F.col("b.ord").alias("by"))
    found = found.unionByName(_under_tokens(rows.where("long"), settings.contra_tau, block))
    return found.groupBy("eval_id", F.least("ord", "by").alias("first"), F.greatest("ord", "by").alias("second")).agg(F.min("by").alias("by"))


def _under_tokens(rows: DataFrame, tau: float, block: int) -> DataFrame:
    """eval_id, ord, by: each claim with those that contradict it, in answers of any length. rows: eval_id, ord, tokens, neg.

    Two claims that differ in negation share only tokens that claims of both kinds have; the others are dropped early, and no claim
    travels with them. Of n tokens, m = ceil(tau * n) are to be covered. So of the tokens left, the two share one of the size - m + 1
    that the fewest claims of the other kind have; each claim looks under these, and a pair is judged under the first token that
    it shares. Crowded tokens are split: claims that look go by `block`s, and those that are looked for to every block.
    """
    said = rows.select("eval_id", "ord", "neg", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    known = said.groupBy("eval_id", "token").agg(F.count_if("neg").alias("denied"), F.count_if(~F.col("neg")).alias("stated")).where("denied > 0 AND stated > 0")
    against = F.when(F.col("neg"), F.col("stated")).otherwise(F.col("denied"))
    left = F.array_sort(F.collect_list(F.struct(against.alias("against"), "token")))
    kept = said.join(known, ["eval_id", "token"]).groupBy("eval_id", "ord", "neg", "n").agg(F.transform(left, lambda x: x["token"]).alias("tokens"))
    kept = shared_checkpoint(kept)
    least = F.greatest(F.ceil(tau * F.col("n") - 1e-9), F.lit(1)).cast("int")  # a product may be a little too large
    looks = kept.where(F.size("tokens") >= least).select("*", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - least + 1)).alias("token"))
    crowd = looks.groupBy("eval_id", "token", "neg").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asks = looks.join(crowd, ["eval_id", "token", "neg"]).withColumn("block", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int")).drop("blocks")
    other = kept.select("eval_id", F.explode("tokens").alias("token"), (~F.col("neg")).alias("neg"), F.col("ord").alias("by"), F.col("tokens").alias("premise"))
    other = other.join(crowd, ["eval_id", "token", "neg"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    both = F.array_intersect("tokens", "premise")  # in the order of tokens
    met = asks.join(other, ["eval_id", "token", "neg", "block"]).where(F.col("ord") != F.col("by"))
    return met.where((F.size(both) / F.col("n") >= tau) & (F.get(both, F.lit(0)) == F.col("token"))).select("eval_id", "ord", "by")


def consistency(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """eval_id, claims, contradictions, contradicting, score, passed: a gate, 1 without any contradiction and 0 else."""
    n = claims.groupBy("eval_id").agg(F.count("*").alias("claims"))
    hit = pairs.select("eval_id", F.explode(F.array("first", "second")).alias("ord")).groupBy("eval_id").agg(F.count_distinct("ord").alias("contradicting"))
    rows = n.join(pairs.groupBy("eval_id").agg(F.count("*").alias("contradictions")), "eval_id", "left").join(hit, "eval_id", "left").fillna(0)
    passed = F.col("contradictions") == 0
    return rows.select("eval_id", "claims", "contradictions", "contradicting", passed.cast("double").alias("score"), passed.alias("passed"))
