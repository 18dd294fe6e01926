"""Claim graphs: premises, typing, anchors, support trees, rescue of derived claims. Iterations of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeleaf import config as c
from gaugeleaf.config import Config
from gaugeleaf.functions import text as t


def minimal(premises: Column, target: Column, tau: float) -> Column:
    """Greedy reduction of an array of structs(ord, id, tokens): each premise goes if the rest still confirms the target."""
    confirms = lambda kept: _confirms(F.array_distinct(F.flatten(F.transform(kept, lambda p: p["tokens"]))), target, tau)

    def drop(kept: Column, p: Column) -> Column:
        rest = F.filter(kept, lambda q: q["id"] != p["id"])
        return F.when((F.size(rest) > 0) & confirms(rest), rest).otherwise(kept)

    return F.aggregate(premises, premises, drop)


def _confirms(premise: Column, target: Column, tau: float) -> Column:
    negation = F.array(*map(F.lit, c.NEGATION))
    raw = t.coverage(target, premise)
    return (raw >= tau) & ~((raw >= 0.5) & (F.arrays_overlap(premise, negation) != F.arrays_overlap(target, negation)))


def premise_sets(claims: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, ord, claim_id, tokens, ps: for each claim the earlier claims (structs of ord, id, tokens) that share terms with it and
    together entail it, none left out yet.

    claims has eval_id, ord, claim_id, text. An answer's claims are few; pairs stay within one answer.
    """
    rows = claims.select("eval_id", "ord", "claim_id", t.tokens(F.col("text")).alias("tokens"), t.tokens(F.col("text"), c.TERM_STOP).alias("terms"))
    a = rows.select("eval_id", F.struct(F.col("ord"), F.col("claim_id").alias("id"), F.col("tokens")).alias("p"), F.col("terms").alias("p_terms"))
    met = rows.join(a, "eval_id").where((F.col("p.ord") < F.col("ord")) & (t.coverage(F.col("terms"), F.col("p_terms")) >= settings.topical_min))
    sets = met.groupBy("eval_id", "ord", "claim_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.first("tokens").alias("tokens"))
    return sets.where(_confirms(F.array_distinct(F.flatten(F.transform("ps", lambda p: p["tokens"]))), F.col("tokens"), settings.edge_tau))


def topical_edges(claims: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, src, dst: the premise sets, reduced to what is needed."""
    sets = premise_sets(claims, settings)
    kept = sets.select("eval_id", F.col("claim_id").alias("dst"), F.explode(minimal(F.col("ps"), F.col("tokens"), settings.edge_tau)).alias("p"))
    return kept.select("eval_id", F.col("p.id").alias("src"), "dst").where("src <> dst").distinct()


def numeric_edges(claims: DataFrame, settings: Config = Config(), few: int = 32) -> DataFrame:
    """eval_id, src, dst: the first pair of earlier claims, in order, whose numbers add or subtract to a claim's number.

    The numbers of an answer of at most `few` claims lie in one row and are tried there, after one shuffle. Of longer answers a claim and
    one earlier number leave three numbers that would complete the pair; these are looked up by stretches of the number line, as wide as
    the tolerance (and the rounding of sums) lets them differ, in their own and both neighbouring ones.
    """
    rows = claims.select("eval_id", "ord", "claim_id", "text").withColumn("size", F.count("*").over(Window.partitionBy("eval_id")))
    numbered = rows.select("eval_id", "ord", "claim_id", "size", t.first_number(F.col("text")).alias("x"))
    first = _pairs_in_row(numbered.where(F.col("size") <= few), settings).unionByName(_pairs_by_stretch(numbered.where((F.col("size") > few) & F.col("x").isNotNull()), settings))
    return first.select("eval_id", F.explode("two").alias("src"), F.col("claim_id").alias("dst"))


def _near(x: Column, a: Column, b: Column, settings: Config) -> Column:
    """Whether the numbers a and b add or subtract to x."""
    one = lambda v: F.abs(x - v) <= settings.numeric_tolerance * F.greatest(F.abs(x), F.abs(v), F.lit(1.0))
    return one(a + b) | one(a - b) | one(b - a)


def _pairs_in_row(n: DataFrame, settings: Config) -> DataFrame:
    """eval_id, claim_id, two: the first pair of each number of short answers. Three nested loops over a row's numbers, which Spark compiles.

    Claims without a number are no part of any pair; to drop them before would make Spark look for the number twice.
    """
    lists = n.groupBy("eval_id").agg(F.collect_list(F.struct("ord", "x", "claim_id")).alias("ns")).where(F.size("ns") > 2)
    two = lists.select("eval_id", "ns", F.explode("ns").alias("n")).select("eval_id", "ns", "n", F.explode("ns").alias("a")).where("a.ord < n.ord")
    met = two.select("eval_id", "n", "a", F.explode("ns").alias("b")).where("a.ord < b.ord and b.ord < n.ord").where(_near(F.col("n.x"), F.col("a.x"), F.col("b.x"), settings))
    first = met.groupBy("eval_id", "n.ord", "n.claim_id").agg(F.min_by(F.array("a.claim_id", "b.claim_id"), F.struct("a.ord", "b.ord")).alias("two"))
    return first.select("eval_id", "claim_id", "two")


def _pairs_by_stretch(n: DataFrame, settings: Config) -> DataFrame:
    """The same for answers of any length."""
    wide = n.groupBy("eval_id").agg(F.max(F.abs("x")).alias("most"), F.count("*").alias("held")).where("held > 2")
    wide = wide.select("eval_id", (F.greatest("most", F.lit(1.0)) * (2 * settings.numeric_tolerance + 1e-9)).alias("width"))
    n = n.join(wide, "eval_id")
    a = n.select("eval_id", F.col("ord").alias("a"), F.col("x").alias("xa"), F.col("claim_id").alias("ida"))
    b = n.select("eval_id", F.col("ord").alias("b"), F.col("x").alias("xb"), F.col("claim_id").alias("idb"), F.floor(F.col("x") / F.col("width")).alias("stretch"))
    two = n.join(a, "eval_id").where("a < ord")
    wanted = F.array(F.col("x") - F.col("xa"), F.col("xa") - F.col("x"), F.col("x") + F.col("xa"))
    at = F.flatten(F.transform(wanted, lambda w: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(w / F.col("width")) + d)))
    met = two.withColumn("stretch", F.explode(F.array_distinct(at))).join(b, ["eval_id", "stretch"]).where("a < b and b < ord")
    met = met.where(_near(F.col("x"), F.col("xa"), F.col("xb"), settings))
    first = met.groupBy("eval_id", "ord", "claim_id").agg(F.min_by(F.array("ida", "idb"), F.struct("a", "b")).alias("two"))
    return first.select("eval_id", "claim_id", "two")


def found_edges(claims: DataFrame, settings: Config = Config()) -> DataFrame:
    """Numeric premises where there are any, else topical ones, as they are found: a claim that an answer repeats may lead back to itself."""
    numeric = numeric_edges(claims, settings)
    return numeric.unionByName(topical_edges(claims, settings).join(numeric.select("eval_id", "dst").distinct(), ["eval_id", "dst"], "left_anti"))


def edges(claims: DataFrame, settings: Config = Config()) -> DataFrame:
    """found_edges() without cycles.

    Premises stand earlier than what they support, so only a claim that an answer repeats can lead back to itself.
    """
    claims = shared_checkpoint(claims.select("eval_id", "ord", "claim_id", "text"))
    found = found_edges(claims, settings)
    order = claims.groupBy("eval_id", F.col("claim_id").alias("node")).agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    again = shared_checkpoint(order.where("n > 1").select("eval_id").distinct())
    if again.isEmpty():
        return found
    found = shared_checkpoint(found)
    cut = cut_cycles(found.join(again, "eval_id", "left_semi"), order.join(again, "eval_id", "left_semi"))
    return found.join(again, "eval_id", "left_anti").unionByName(cut)


def cut_cycles(links: DataFrame, order: DataFrame) -> DataFrame:
    """links (eval_id, src, dst) without those by which the first node of a cycle leads into it. order: eval_id, node, ord.

    Each cycle has a back link, from a node to itself or to an earlier one, and lies where back links' stretches of ord overlap; all
    other links stay unseen. In each such stretch the first node that a back link leads to loses its links to nodes that
    lead back to it, which ends all its cycles; with its links set aside, the stretches are made anew, until no back link is
    left. Rounds: as many as back links lead to different nodes of a stretch, and within each the steps of its longest way.
    """
    at = order.select("eval_id", F.col("node").alias("at"), "ord")
    ends = lambda x, name: at.withColumnRenamed("at", x).withColumnRenamed("ord", name)
    links = shared_checkpoint(links.select("eval_id", "src", "dst").distinct().join(ends("src", "a"), ["eval_id", "src"]).join(ends("dst", "b"), ["eval_id", "dst"]))
    rest, cut = links, []
    while True:
        back = shared_checkpoint(stretches(rest.where("a >= b").select("eval_id", F.col("b").alias("low"), F.col("a").alias("high"))))
        if back.isEmpty():
            break
        blocks = back.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / 1024), F.floor(F.col("high") / 1024))))
        inside = rest.withColumn("block", F.floor(F.col("a") / 1024)).join(blocks, ["eval_id", "block"]).where("a between low and high and b between low and high")
        inside = shared_checkpoint(inside.select("eval_id", "src", "dst", "a", "b", "low"))
        reach = frontier = shared_checkpoint(inside.where("b = low").select("eval_id", "low", F.col("src").alias("node")).distinct())
        while not frontier.isEmpty():
            into = inside.select("eval_id", "low", F.col("dst").alias("node"), "src", "a").where("a > low")
            step = frontier.join(into, ["eval_id", "low", "node"]).select("eval_id", "low", F.col("src").alias("node")).distinct()
            frontier = shared_checkpoint(step.join(reach, ["eval_id", "low", "node"], "left_anti"))
            reach = reach.unionByName(frontier)
        gone = inside.where("a = low").join(reach.withColumnRenamed("node", "dst"), ["eval_id", "low", "dst"], "left_semi")
        cut.append(shared_checkpoint(gone.select("eval_id", "src", "dst")))
        rest = inside.where("a <> low and b <> low").select("eval_id", "src", "dst", "a", "b")  # no other link is on a cycle
    kept = links.select("eval_id", "src", "dst")
    for gone in cut:
        kept = kept.join(gone, ["eval_id", "src", "dst"], "left_anti")
    return kept


def stretches(spans: DataFrame) -> DataFrame:
    """eval_id, low, high: spans that overlap put together, by a running maximum over sorted starts."""
    before = Window.partitionBy("eval_id").orderBy("low", F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.distinct().withColumn("new", F.coalesce((F.col("low") > F.max("high").over(before)).cast("int"), F.lit(1)))
    rows = rows.withColumn("k", F.sum("new").over(Window.partitionBy("eval_id").orderBy("low", F.desc("high"))))
    return rows.groupBy("eval_id", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("k")


def typed(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """claims with ctype, bound_text, context_incomplete: indexical claims take the filler of the first sibling that has one."""
    sib = claims.select("eval_id", F.col("claim_id").alias("sib"), F.col("ord").alias("sib_ord"), t.filler(F.col("text")).alias("fill")).where("fill is not null")
    fills = claims.where(t.is_indexical(F.col("text"))).join(sib, "eval_id").where("sib <> claim_id").groupBy("eval_id", "ord").agg(F.min_by("fill", "sib_ord").alias("fill"))
    rows = claims.join(fills, ["eval_id", "ord"], "left").join(supports.select("eval_id", "claim_id", (F.size("chunks") > 0).alias("held")), ["eval_id", "claim_id"], "left")
    deictic = t.is_indexical(F.col("text"))
    ctype = F.when(deictic, "indexical").when(F.col("held") == F.lit(False), "inference").otherwise("independent")
    bound = F.when(deictic & F.col("fill").isNotNull(), F.concat("text", F.lit(" ["), "fill", F.lit("]"))).otherwise(F.col("text"))
    return rows.withColumn("ctype", ctype).withColumn("bound_text", bound).withColumn("context_incomplete", deictic & F.col("fill").isNull()).drop("fill", "held")


def centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """eval_id, node, centrality: distinct sources of links, loops left out, 0 without any."""
    n = links.where("src <> dst").groupBy("eval_id", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("centrality"))
    return nodes.join(n, ["eval_id", "node"], "left").withColumn("centrality", F.coalesce("centrality", F.lit(0)).cast("long"))


def anchors(nodes: DataFrame, links: DataFrame, seeds: DataFrame, settings: Config = Config()) -> DataFrame:
    """Seeds and nodes of enough centrality."""
    return seeds.select("eval_id", "node").unionByName(centrality(nodes, links).where(F.col("centrality") >= settings.centrality_min).select("eval_id", "node")).distinct()


def support_tree(anchor: DataFrame, links: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, node, depth, weight: premises reached from anchors against the links, max_hops joins, least depth.

    Each hop joins what the last one reached, checkpointed, so that the plan doesn't grow with the hops.
    """
    links = shared_checkpoint(links.where("src <> dst").select("eval_id", F.col("dst").alias("node"), "src").distinct())
    frontier = shared_checkpoint(anchor.select("eval_id", "node").distinct().withColumn("depth", F.lit(0)))
    tree = frontier
    for hop in range(1, settings.max_hops + 1):
        step = frontier.join(links, ["eval_id", "node"]).select("eval_id", F.col("src").alias("node")).distinct()
        frontier = shared_checkpoint(step.join(tree.select("eval_id", "node"), ["eval_id", "node"], "left_anti").withColumn("depth", F.lit(hop)))
        tree = tree.unionByName(frontier)
    return tree.withColumn("weight", F.pow(F.lit(settings.depth_decay), F.col("depth")))


def rescue(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """eval_id, node, axiom, resolved: a node that is no axiom resolves once all its parents, one at least, do.

    A round joins only the nodes that the last one resolved with the links that still wait for their premise, and what it answers
    leaves those links; rounds end when nothing resolves.
    """
    rows = nodes.select("eval_id", "node", "axiom").distinct()
    frontier = shared_checkpoint(rows.where("axiom").select("eval_id", "node"))
    derived = rows.where("not axiom").select("eval_id", F.col("node").alias("dst"))
    waiting = shared_checkpoint(links.select("eval_id", "src", "dst").distinct().join(derived, ["eval_id", "dst"], "left_semi"))
    resolved = frontier
    while not frontier.isEmpty():
        met = shared_checkpoint(waiting.join(frontier.select("eval_id", F.col("node").alias("src"), F.lit(True).alias("hit")), ["eval_id", "src"], "left"))
        frontier = shared_checkpoint(met.groupBy("eval_id", F.col("dst").alias("node")).agg(F.bool_and(F.col("hit").isNotNull()).alias("all")).where("all").select("eval_id", "node"))
        waiting = met.where("hit is null").select("eval_id", "src", "dst")
        resolved = resolved.unionByName(frontier)
    return rows.join(resolved.withColumn("ok", F.lit(True)), ["eval_id", "node"], "left").select("eval_id", "node", "axiom", F.coalesce("ok", F.lit(False)).alias("resolved"))


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one on a local master only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        import tempfile

        _OWN.append(tempfile.mkdtemp(prefix="gaugeleaf-"))
    return _OWN[0]


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def orphans(outside: DataFrame, anchor: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, claim_id, kind, relevant: off_topic before stranded_contradiction before stranded_support before background.

    A claim off the topic is dropped; else it contradicts or supports by what it says of the anchors: it is the premise, each
    anchor a hypothesis. outside has eval_id, claim_id, tokens, on_topic; anchor has eval_id, tokens.
    """
    met = outside.join(anchor.select("eval_id", F.col("tokens").alias("claimed")), "eval_id", "left")
    met = met.withColumn("label", F.when(F.col("claimed").isNotNull(), t.entailment(F.col("tokens"), F.col("claimed"), settings.entail_tau, settings.contra_tau)["label"]))
    seen = met.groupBy("eval_id", "claim_id").agg(F.bool_or(F.col("label") == "C").alias("c"), F.bool_or(F.col("label") == "E").alias("e"), F.bool_or("on_topic").alias("on_topic"))
    kind = F.when(~F.col("on_topic"), "off_topic").when(F.col("c"), "stranded_contradiction").when(F.col("e"), "stranded_support").otherwise("background")
    return seen.select("eval_id", "claim_id", kind.alias("kind"), F.col("on_topic").alias("relevant"))


def graded(signals: DataFrame, links: DataFrame, settings: Config = Config()) -> DataFrame:
    """signals with depth, kind, relevant and grade: claims on a support tree by depth_decay ** depth, others by their kind.

    Anchors are claims on the ask and claims of enough centrality. signals has eval_id, claim_id, tokens, on_topic, on_ask.
    """
    signals, links = shared_checkpoint(signals), shared_checkpoint(links)
    nodes = signals.select("eval_id", F.col("claim_id").alias("node")).distinct()
    seeds = signals.where("on_ask").select("eval_id", F.col("claim_id").alias("node")).distinct()
    anchor = shared_checkpoint(anchors(nodes, links, seeds, settings))
    tree = support_tree(anchor, links, settings).select("eval_id", F.col("node").alias("claim_id"), "depth", "weight")
    rows = signals.join(tree, ["eval_id", "claim_id"], "left")
    roots = signals.join(anchor.select("eval_id", F.col("node").alias("claim_id")), ["eval_id", "claim_id"], "left_semi").select("eval_id", "tokens").distinct()
    kinds = orphans(rows.where("depth is null").select("eval_id", "claim_id", "tokens", "on_topic"), roots, settings)
    rows = rows.join(kinds, ["eval_id", "claim_id"], "left")
    grade = F.when(F.col("depth").isNotNull(), F.col("weight")).when(F.col("relevant"), 1.0).otherwise(0.0)
    return rows.withColumn("grade", grade).withColumn("relevant", F.col("depth").isNotNull() | F.coalesce("relevant", F.lit(False))).drop("weight")


def anchor_band(signals: DataFrame, links: DataFrame, settings: Config = Config()) -> DataFrame:
    """eval_id, anchor_count, band_low, band_high, abstained: the guarantee on anchors, by how many there are."""
    nodes = signals.select("eval_id", F.col("claim_id").alias("node")).distinct()
    anchor = anchors(nodes, links, signals.where("on_ask").select("eval_id", F.col("claim_id").alias("node")).distinct(), settings)
    n = anchor.groupBy("eval_id").agg(F.count("*").alias("anchor_count"))
    few = F.col("anchor_count") < settings.conformal_min_n
    low = 1 - settings.anchor_alpha
    return n.select("eval_id", "anchor_count", F.lit(low).alias("band_low"), F.when(few, 1.0).otherwise(F.least(F.lit(1.0), low + 1 / (F.col("anchor_count") + 1))).alias("band_high"), few.alias("abstained"))


def status(nodes: DataFrame, atoms: DataFrame) -> DataFrame:
    """eval_id, node, status: axiom or derived by a true atom of that role, else failed."""
    true = atoms.where("verdict and role in ('axiom', 'derived')").groupBy("eval_id", F.col("subject").alias("node")).agg(F.bool_or(F.col("role") == "axiom").alias("axiom"))
    shown = F.when(F.col("axiom"), "axiom").when(~F.col("axiom"), "derived").otherwise("failed")
    return nodes.select("eval_id", "node").distinct().join(true, ["eval_id", "node"], "left").select("eval_id", "node", shown.alias("status"))


def edge_recall(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: recall, precision, tp, detected, gold; 1.0 where there is nothing to find."""
    d, g = detected.select("eval_id", "src", "dst").distinct(), gold.select("eval_id", "src", "dst").distinct()
    one = d.withColumn("d", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["eval_id", "src", "dst"], "full")
    row = one.agg(F.count_if(F.col("d").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("d").alias("detected"), F.count("g").alias("gold"))
    share = lambda n: F.coalesce(F.col("tp") / F.nullif(n, F.lit(0)), F.lit(1.0))
    return row.select(share("gold").alias("recall"), share("detected").alias("precision"), "tp", "detected", "gold")


def node_link(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """eval_id, graph: nodes and links of each evaluation as JSON, ordered by name.

    nodes has eval_id, node, ctype, status, context_incomplete; links has eval_id, src, dst, etype.
    """
    colour = F.when(F.col("status") == "failed", "red").otherwise("green")
    node = F.struct(F.col("node").cast("string").alias("id"), F.col("ctype").alias("type"), "status", colour.alias("color"), "context_incomplete")
    link = F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "etype", F.when(F.col("etype") == "contradicts", "red").otherwise("gray").alias("color"))
    n = nodes.groupBy("eval_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    e = links.groupBy("eval_id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    none = F.array().cast(e.schema["links"].dataType)
    return n.join(e, "eval_id", "left").select("eval_id", F.to_json(F.struct("nodes", F.coalesce("links", none).alias("links"))).alias("graph"))


def ordered(claims: DataFrame) -> DataFrame:
    """claims with ord, their place in the answer."""
    return claims.withColumn("ord", F.row_number().over(Window.partitionBy("eval_id").orderBy("sent_ord", "clause_ord")) - 1)
