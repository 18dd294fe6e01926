"""Near-duplicate groups by an LSH forest over MinHash signatures, links confirmed on the full shingle sets.

1. Each document becomes its set of word shingles (hashed) and a signature of 128 minima. Documents with equal sets form
   a class; from here on a class is its smallest doc_id.
2. The forest: tree t orders classes by the signature rotated by t * 8 minima. A region is a run of classes with a common
   prefix. Regions start at a prefix of two minima; one that holds more than `region` classes is descended, by prefixes of
   6, 12 and 24, so that depth adapts to how crowded a region is. In a region all classes meet; in a crowded one
   each meets its neighbours in sorted order, those with the longest common prefix, as well as those of the deeper regions.
   Of those it meets, a class proposes the ones whose signatures agree best.
3. First each class's best proposal is checked on full sets, and in crowded regions that with the classes that agree most with
   the region's commonest minima, which joins stars at linear cost. Then every proposal that joins two groups still apart.
4. What meeting left out is made up for exactly, in each region that still has several groups: in crowded regions all classes,
   in others those that met more partners than they proposed, meet on full sets, all outside the largest group with all
   others, counted over an inverted index by pairs of salted blocks of bounded size.
5. Links become components by repeated star contraction; later links contract the groups that they name only.

Cases: a document without words (null or empty text too) has the empty set, is its own component and is linked with
nothing. Fewer words than a shingle: the whole word sequence is the one shingle. Rows that repeat a doc_id with an equal
text get the same row each; with another text, each row follows its own text. A null doc_id never represents a class
unless all of the class lacks one. Other columns are not read. An empty table gives an empty result.

Size: signatures take 512 bytes a document and are written once; full sets are built only for classes in some proposal.
No group is held by one task: a class equal to a third of all rows is one row after partial aggregation, and crowded
regions are dealt by ranges of the sorted order, or by blocks. A pair of similarity 0.85 shares no region in 16 trees with
probability below 1e-8; one that shares a region is found unless its signatures agree in fewer than 90 of 128 minima (4e-6 at 0.85)
and nothing else joins the two. Work in step 4 is, in a region, classes outside its largest
group times all its classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import WordHash, chunks, hashed_words, materialize, mixed, raw_texts, table, texts, window_hashes

MINIMA, TREES, PER_TREE = 128, 16, 8
DEPTHS = (2, 6, 12, 24)
BLOCK, BLOCK_BYTES = 1024, 8 << 20
_rng = np.random.default_rng(20240607)
_ODD = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)


def _sets(batch: pa.RecordBatch, cache: WordHash, shingle: int):
    """The sorted distinct shingle hashes of each document of a chunk."""
    h, bounds = hashed_words(raw_texts(batch), cache, lower=True)
    w = window_hashes(h, shingle)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(w[a : b - shingle + 1])
        elif b > a:
            yield mixed(window_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield h[:0]


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _minima(s: np.ndarray) -> bytes:
    y, m = (s >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(y), 256):
        np.minimum(m, ((y[a : a + 256, None] ^ _XOR) * _ODD).min(axis=0), out=m)
    return m.astype(">u4").tobytes()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n_shingles, set_key (of the whole set) and sig, null for the empty set."""

    def sign(batches):
        cache = WordHash()
        for batch in chunks(batches):
            rows = [(len(s), _key(s), _minima(s)) if len(s) else (0, None, None) for s in _sets(batch, cache, shingle)]
            n, key, sig = zip(*rows)
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "row", "n_shingles", "set_key", "sig"])

    return texts(docs).withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(sign, "doc_id long, row long, n_shingles long, set_key binary, sig binary")


def _rotated(tree: Column) -> Column:
    at = tree * F.lit(4 * PER_TREE)
    return F.concat(F.expr(f"substring(sig, tree * {4 * PER_TREE} + 1)"), F.substring("sig", F.lit(1), at))


def _region(depth: int) -> Column:
    return F.xxhash64("tree", F.lit(depth), F.substring(_rotated(F.col("tree")), F.lit(1), F.lit(4 * depth)))


def _compared(rows: DataFrame, region: int, best: int, least: int) -> DataFrame:
    """Runs of equal region, sorted by rotated signature: all classes of a run meet, in long runs those near in order.

    a < b, agree: each class with the `best` it agrees with most; a = b, region: a class of a region at the top of its tree
    that met more partners than that.
    """

    def propose(batches):
        seen: set[tuple[int, int]] = set()

        def flush(key: int, top_: bool, runs: list):
            ids, sigs = (np.concatenate(x) for x in zip(*runs))
            out, full = [], []
            step = region if len(ids) <= region else region // 2
            for a in range(0, max(1, len(ids) - (region - step)), step):
                i, s = ids[a : a + region], sigs[a : a + region]
                for r in range(0, len(i), 32):
                    same = (s[r : r + 32, None, :] == s[None]).sum(axis=2, dtype=np.int16)
                    same[np.arange(len(same)), np.arange(r, r + len(same))] = -1
                    k = min(best, len(i) - 1)
                    top = np.argpartition(-same, k - 1, axis=1)[:, :k]
                    x, y = np.nonzero(np.take_along_axis(same, top, axis=1) >= least)
                    y = top[x, y]
                    full.append(i[r + np.flatnonzero((same >= least).sum(axis=1) > k)])
                    p, q = i[r + x], i[y]
                    out.append(np.stack([np.minimum(p, q), np.maximum(p, q), same[x, y].astype(np.int64)]))
            found = np.unique(np.concatenate(out, axis=1), axis=1)
            new = [j for j, pair in enumerate(zip(found[0].tolist(), found[1].tolist())) if pair not in seen]
            found = found[:, new]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(zip(found[0].tolist(), found[1].tolist()))
            more = np.unique(np.concatenate(full)) if full and top_ else ids[:0]
            n, m = found.shape[1], len(more)
            return pa.record_batch(
                [
                    pa.array(np.concatenate([found[0], more]), pa.int64()), pa.array(np.concatenate([found[1], more]), pa.int64()), pa.array([*found[2].tolist(), *[None] * m], pa.int32()),
                    pa.array([None] * n + [key] * m, pa.int64()),
                ],
                ["a", "b", "agree", "region"],
            )

        held_key, at_top, held, fresh = None, False, [], 0
        for batch in batches:
            keys, ids, tops = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "rep", "top"))
            short = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").astype(np.uint16).reshape(-1, MINIMA)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != held_key:
                    if fresh and sum(len(x[0]) for x in held) > 1:
                        yield flush(held_key, at_top, held)
                    held_key, at_top, held, fresh = int(keys[a]), bool(tops[a]), [], 0
                held.append((ids[a:b], short[a:b]))
                fresh += b - a
                if fresh >= 16 * region:
                    yield flush(held_key, at_top, held)
                    held, fresh = [tuple(np.concatenate(x)[-region // 2 :] for x in zip(*held))], 0
        if fresh and sum(len(x[0]) for x in held) > 1:
            yield flush(held_key, at_top, held)

    return rows.select("region", "top", "rep", "sig").mapInArrow(propose, "a long, b long, agree int, region long")


def _least(percent: int) -> int:
    """Minima that a linked pair shares at least, but for 4.5 standard deviations."""
    p = percent / 100
    return int(MINIMA * (p - 4.5 * (p * (1 - p) / MINIMA) ** 0.5))


def proposals(classes: DataFrame, region: int, best: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What meeting finds, and what it leaves out.

    a < b, agree: pairs of classes that meet in some tree and whose signatures agree well. rep, region: who met more partners
    in a region that is not crowded. rep, region: all classes of crowded regions; deeper regions are parts of these.
    """
    tree = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    level = tree.select("rep", "tree", F.array(*map(_region, DEPTHS)).alias("below"))
    met = crowded = None
    for _ in DEPTHS:
        placed = level.select("rep", "tree", F.get("below", F.lit(0)).alias("region"), F.slice("below", F.lit(2), F.lit(len(DEPTHS))).alias("below"))
        counts = placed.groupBy("region").agg(F.count("*").alias("held")).where("held > 1")
        thin = placed.join(counts, "region").withColumn("top", F.lit(crowded is None)).withColumn("below", F.when(F.col("held") > region, F.col("below")))
        thin = materialize(thin)
        met = thin if met is None else met.unionByName(thin)
        level = thin.where(F.col("held") > region)
        if crowded is None:
            crowded = level.select("rep", "region")
        if level.isEmpty():
            break
    met = met.drop("below")
    rows = met.join(classes, "rep")
    calm = rows.where(F.col("held") <= region).repartition("region").sortWithinPartitions("region")
    order = rows.where(F.col("held") > region).withColumn("place", _rotated(F.col("tree")))
    crowd = order.repartitionByRange("region", "place").sortWithinPartitions("region", "place")
    least = _least(percent)
    found = materialize(_compared(calm, region, best, least).unionByName(_compared(crowd, region, 1, least)))
    pairs = materialize(found.where("a < b").groupBy("a", "b").agg(F.max("agree").alias("agree")))
    return pairs, found.where("a = b").select(F.col("a").alias("rep"), "region").distinct(), crowded


def _blocks(met: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """rep, crowd, group, block, apart, blocks: classes of regions with several groups, dealt to blocks of bounded size.

    Regions whose largest group has the same smallest class are one crowd: these are at most one a tree, and mostly hold the
    same classes. Blocks 0 .. apart - 1 hold the classes outside that group, apart .. blocks - 1 the group.
    """
    rows = met.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "region", F.coalesce("component", "rep").alias("group"))
    rows = materialize(rows)
    each = rows.groupBy("region", "group").agg(F.count("*").alias("n"), F.min("rep").alias("crowd"))
    held = each.groupBy("region").agg(F.count("*").alias("several"), F.max_by(F.struct("group", "crowd"), F.struct("n", "group")).alias("main")).where("several > 1")
    rows = rows.join(held.select("region", "main.crowd", F.col("main.group").alias("main")), "region").select("rep", "crowd", "group", (F.col("group") == F.col("main")).alias("inside")).distinct()
    rows = materialize(rows.join(sizes, "rep"))
    count = lambda part: F.ceil(F.greatest(F.count_if(part) / BLOCK, F.sum(F.when(part, F.col("size")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    held = rows.groupBy("crowd").agg(count(~F.col("inside")).alias("apart"), count(F.col("inside")).alias("mains"))
    at = F.xxhash64("rep", "crowd")
    block = F.when(F.col("inside"), F.col("apart") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("apart")))
    return materialize(rows.join(held, "crowd").select("rep", "crowd", "group", block.cast("int").alias("block"), "apart", (F.col("apart") + F.col("mains")).alias("blocks")))


def to_hubs(crowded: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a < b: each class of a crowded region with the one it agrees with most among the most central classes of the region.

    Central are, in each of a region's blocks, the two classes that agree most with the block's commonest minima, and of those
    of all blocks the best four.
    """
    least = _least(percent)

    def central(table_):
        sigs = np.frombuffer(b"".join(table_.column("sig").to_pylist()), ">u4").astype(np.uint32).reshape(-1, MINIMA)
        agree = np.zeros(len(sigs), np.int64)
        for column in sigs.T:
            value, n = np.unique(column, return_counts=True)
            agree += column == value[n.argmax()]
        top = np.argsort(-agree, kind="stable")[:2]
        return table_.take(pa.array(top)).append_column("agree", pa.array(agree[top], pa.int64())).select(["region", "blocks", "agree", "rep", "sig"])

    sizes = crowded.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = crowded.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("rep", "region"), F.col("blocks")).cast("int"))
    rows = materialize(rows.join(classes, "rep"))
    hubs = rows.groupBy("region", "block").applyInArrow(central, "region long, blocks int, agree long, rep long, sig binary")
    hubs = hubs.groupBy("region", "blocks").agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", "rep", "sig")), False), 1, 4).alias("hubs"))
    hubs = hubs.select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hubs")

    def agreeing(batches):
        for batch in batches:
            out = []
            for rep, sig, near in zip(*(batch.column(c).to_pylist() for c in ("rep", "sig", "hubs"))):
                own = np.frombuffer(sig, ">u4")
                found = [(int((own == np.frombuffer(h["sig"], ">u4")).sum()), h["rep"]) for h in near if h["rep"] != rep]
                if found and max(found)[0] >= least:
                    out.append((rep, *max(found)))
            one, agree, hub = zip(*out) if out else ((), (), ())
            yield pa.record_batch([pa.array(one, pa.int64()), pa.array(hub, pa.int64()), pa.array(agree, pa.int32())], ["one", "hub", "agree"])

    met = rows.join(hubs, ["region", "block"]).select("rep", "sig", "hubs").mapInArrow(agreeing, "one long, hub long, agree int")
    best = met.groupBy("one").agg(F.max_by("hub", F.struct("agree", "hub")).alias("hub"))
    return best.select(F.least("one", "hub").alias("a"), F.greatest("one", "hub").alias("b")).distinct()


def still_apart(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a < b: links between classes of one crowd and different groups, enough to join all groups that full sets link."""

    def linked(key, table_):
        _, i, j = (k.as_py() for k in key)
        ids, groups, block = (table_.column(c).to_numpy() for c in ("rep", "group", "block"))
        all_sets = [np.frombuffer(s, "<u8") for s in table_.column("shingles").to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        lengths = np.array([len(all_sets[k]) for k in right], np.int64)
        held, of = np.concatenate([np.zeros(0, np.uint64), *(all_sets[k] for k in right)]), np.repeat(np.arange(len(right)), lengths)
        order = np.argsort(held, kind="stable")
        held, of, root, out = held[order], of[order], {}, []

        def find(g):
            while root.get(g, g) != g:
                root[g] = g = root.get(root[g], root[g])
            return g

        for k in left.tolist():
            s = all_sets[k]
            start = np.searchsorted(held, s, "left")
            n = np.searchsorted(held, s, "right") - start
            place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(of[place], minlength=len(right))
            near = right[(groups[right] != groups[k]) & (both > 0) & (100 * both >= percent * (len(s) + lengths - both))]
            for g, at in zip(*(x.tolist() for x in np.unique(groups[near], return_index=True))):
                x, y = find(int(groups[k])), find(g)
                if x != y:
                    root[y] = x
                    out.append(sorted((int(ids[k]), int(ids[near[at]]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    others = F.when(F.col("block") < F.col("apart"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("apart") - 1))
    dealt = blocks.select("rep", "crowd", "group", "block", F.explode(others).alias("other"))
    dealt = dealt.select("rep", "crowd", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.join(sets, "rep").groupBy("crowd", "i", "j").applyInArrow(linked, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right"))

    def keep(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(keep, "b long, a long").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable), for edges (a, b) with a < b. Large-star and small-star steps in turn.

    Done once the edges are stars: every node points to one other, to which none points on.
    """
    edges = materialize(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component) after more links (a, b): only the groups that links name are contracted anew."""
    at = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    named = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_group", "a").alias("x"), F.coalesce("b_group", "b").alias("y")).where("x <> y")
    named = materialize(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if named.isEmpty():
        return groups
    above = materialize(components(named).withColumnRenamed("node", "old").withColumnRenamed("component", "new"))
    moved = groups.join(above, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    roots = above.select(F.col("old").alias("node"), F.col("new").alias("component"))
    return materialize(moved.unionByName(roots))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, region: int = 512, best: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row (a hash of doc_id and text): one row per row of docs."""
    signed = materialize(signatures(docs, shingle))
    classes = materialize(signed.where("n_shingles > 0").groupBy("set_key", "sig").agg(F.min("doc_id").alias("rep"))).where("rep is not null")
    pairs, full, crowded = proposals(classes.select("rep", "sig"), region, best, percent)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(crowded.select(F.col("rep").alias("doc_id"))).distinct().join(classes.select(F.col("rep").alias("doc_id"), "set_key"), "doc_id")

    def rebuild(batches):
        cache = WordHash()
        for batch in chunks(batches):
            for rep, key, s in zip(batch.column("doc_id").to_pylist(), batch.column("set_key").to_pylist(), _sets(batch, cache, shingle)):
                if _key(s) == key:
                    yield pa.record_batch([pa.array([rep], pa.int64()), pa.array([s.astype("<u8").tobytes()], pa.binary())], ["rep", "shingles"])

    sets = materialize(texts(docs).join(wanted, "doc_id").mapInArrow(rebuild, "rep long, shingles binary").dropDuplicates(["rep"]))

    ways = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("one")).withColumn("other", F.col("a") + F.col("b") - F.col("one"))
    first = ways.groupBy("one").agg(F.max_by(F.struct("a", "b"), F.struct("agree", -F.col("other"))).alias("p")).select("p.a", "p.b").distinct()
    if not crowded.isEmpty():
        first = first.unionByName(to_hubs(crowded, classes.select("rep", "sig"), percent)).distinct()
    first = materialize(first)
    groups = components(confirmed(first, sets, percent))
    at = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    apart = (
        pairs.join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
        .where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b"))
    )
    groups = joined(groups, confirmed(apart, sets, percent))
    sizes = sets.select("rep", F.length("shingles").alias("size"))
    groups = joined(groups, still_apart(_blocks(full.unionByName(crowded), groups, sizes), sets, percent))
    member = classes.join(groups, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "row", "n_shingles", "set_key").join(member, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "row")
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row")
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("row")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS t FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c WHERE 100 * i >= 85 * (na + nb - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
