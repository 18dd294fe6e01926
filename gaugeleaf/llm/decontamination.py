"""Benchmark decontamination by a positional inverted index of the training documents.

Benchmark items are cut into windows of `window` consecutive words (shorter items are one window); equal windows of several
items are one. The corpus frequency of every benchmark term is counted. The posting lists (document, position) of each
window's two rarest terms are written as a table, the index; lists are shifted by the term's place in the window, so that both
give the start a match would have, and intersected on document, window and start. What is in both lists is compared with the
whole window at the positions of the document. For proximity, the lists of each item's two rarest terms meet within a tolerance.

Cases: a null or empty text has no words and no hit. Items without words or item_id have no windows. Items that share a
window all count. Rows that repeat are judged by their own text, also under one doc_id or none. Columns of docs besides doc_id
and text are not read; clean() hands all of them on, whatever their names. Empty tables: an empty benchmark hits nothing,
empty documents give an empty result.

Size: the corpus is scanned twice, as (term, position) rows that meet the benchmark's terms before any shuffle. Shuffled are
sums, the postings of rarest terms as (document, window, start), and the texts once to meet their matches. Tables from the
benchmark are broadcast only while they have `broadcast_rows` rows and 64 MB at most, beyond that Spark plans the join. No
posting list and no window's list of items is held in one row, so a term of a third of all documents, or a window of all
items, is dealt like any other; only what one document itself hits is put together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import KEY, keyed, materialize, packed, table, texts, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _small(df: DataFrame, most: int, most_bytes: int = 64 << 20) -> DataFrame:
    """df, marked for broadcast if a count of its rows and of the bytes of its strings says that it is small."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "array<string>")]
    size = F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", *strings))), F.lit(0))
    rows, held = df.limit(most + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= most and held <= most_bytes else df


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    return items.where("item_id is not null and size(words) > 0").distinct()


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """w (a hash), words, item_id: the windows of the benchmark, a row for each item that has one."""
    n = F.least(F.size("words"), F.lit(window))
    cut = items.select("item_id", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("s"))
    rows = cut.select("item_id", F.slice("words", F.col("s") + 1, F.col("n")).alias("words"))
    return rows.select(F.xxhash64("words").alias("w"), "words", "item_id").distinct()


def pairs_of(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """item_id, rare, second: each item's two rarest different terms of those that the corpus has; items with fewer have no row."""
    terms = items.select("item_id", F.explode(F.array_distinct("words")).alias("term")).join(frequencies, "term")
    two = terms.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("df", "term"))), 1, 2).alias("two")).where("size(two) = 2")
    return two.select("item_id", F.col("two")[0]["term"].alias("rare"), F.col("two")[1]["term"].alias("second"))


def postings(docs: DataFrame, terms: DataFrame | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """KEY, pos (from 0), term: the positional index of the training text, of all terms or of those in `terms`."""
    rows = keyed(docs).select(*KEY, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return rows if terms is None else rows.join(_small(terms.select("term").distinct(), broadcast_rows), "term", "left_semi").select(*KEY, "pos", "term")


def term_frequencies(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """term, df: how often each term of the items stands in the whole corpus."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    found = texts(docs).select(F.explode(words_of(F.col("text"))).alias("term")).join(_small(terms, broadcast_rows), "term")
    return found.groupBy("term").agg(F.count("*").alias("df"))


def anchors(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """term, w, ahead (words from the window's start to the term), part: the places of each window's two rarest terms.

    part is 1 for the rarest and 2 for the next; 3 for the only one of a window of one word.
    """
    placed = windows.select("w", "words", F.posexplode("words").alias("q", "term")).join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    two = placed.groupBy("w", "words").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "q", "term"))), 1, 2).alias("two"))
    rows = two.select("w", F.size("two").alias("n"), F.posexplode("two").alias("i", "a"))
    return rows.select("a.term", "w", F.col("a.q").alias("ahead"), F.when(F.col("n") == 1, 3).otherwise(F.col("i") + 1).alias("part")).distinct()


def intersections(index: DataFrame, chosen: DataFrame, broadcast_rows: int) -> DataFrame:
    """KEY, w, start: where the shifted posting lists of both rarest terms of a window meet."""
    met = index.join(_small(chosen, broadcast_rows), "term").select(*KEY, "w", (F.col("pos") - F.col("ahead")).alias("start"), "part").where("start >= 0")
    return met.groupBy(*KEY, "w", "start").agg(F.bit_or("part").alias("parts")).where("parts = 3").drop("parts")


class Index(NamedTuple):
    """Written tables: windows (w, words) and who has them (w, words, item_id), places of rarest terms, pairs of rarest terms
    (pair, rare, second) and who has them (pair, item_id), and the postings of all these terms."""

    windows: DataFrame
    holders: DataFrame
    chosen: DataFrame
    pairs: DataFrame
    paired: DataFrame
    postings: DataFrame


def index_of(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = 200_000, near: bool = True) -> Index:
    """The index of docs (doc_id, text) for the windows of the benchmark and, if `near`, for its items' pairs of rarest terms."""
    items = materialize(_items(benchmark))
    holders = materialize(windows_of(items, window))
    windows = materialize(holders.select("w", "words").distinct())
    frequencies = materialize(term_frequencies(docs, items, broadcast_rows))
    chosen = materialize(anchors(windows, frequencies))
    two = materialize(pairs_of(items, frequencies) if near else pairs_of(items.limit(0), frequencies))
    pairs = materialize(two.select("rare", "second").distinct().withColumn("pair", F.monotonically_increasing_id()))
    paired = materialize(two.join(pairs, ["rare", "second"]).select("pair", "item_id"))
    terms = chosen.select("term").unionByName(pairs.select(F.explode(F.array("rare", "second")).alias("term")))
    return Index(windows, holders, chosen, pairs, paired, materialize(postings(docs, terms, broadcast_rows)))


def phrase_matches(docs: DataFrame, index: Index, broadcast_rows: int = 200_000) -> DataFrame:
    """docs with KEY, own_words and own_matches (start, w, words): exact occurrences of windows. docs: doc_id, text, at most `rest` besides."""
    found = intersections(index.postings, index.chosen, broadcast_rows).join(_small(index.windows, broadcast_rows), "w")
    found = found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "w", "words")).alias("found"))
    joined = keyed(docs).join(found, KEY, "left").withColumn("own_words", words_of(F.col("text")))
    none = F.array().cast(found.schema["found"].dataType)
    exact = F.filter(F.coalesce("found", none), lambda c: F.slice("own_words", c["start"] + 1, F.size(c["words"])) == c["words"])
    return joined.withColumn("own_matches", exact).drop("found")


def near_pairs(index: Index, slop: int, broadcast_rows: int = 200_000) -> DataFrame:
    """KEY, pair, pos, distance: the places of a pair's rarer term with the other at most `slop` words away, in any order.

    Lists meet by stretches of slop + 1 words, of the same stretch or a neighbouring one, so that no two whole lists of a
    document are paired. Items with the same two terms are one pair.
    """
    at = F.floor(F.col("pos") / (slop + 1))
    listed = lambda term: index.postings.join(_small(index.pairs.select("pair", F.col(term).alias("term")), broadcast_rows), "term")
    first = listed("rare").select(*KEY, "pair", "pos", F.explode(F.array(at - 1, at, at + 1)).alias("stretch"))
    second = listed("second").select(*KEY, "pair", F.col("pos").alias("other"), at.alias("stretch"))
    met = first.join(second, [*KEY, "pair", "stretch"]).withColumn("distance", F.abs(F.col("pos") - F.col("other"))).where(F.col("distance") <= slop)
    return met.groupBy(*KEY, "pair", "pos").agg(F.min("distance").alias("distance"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5) -> DataFrame:
    """doc_id, item_id, pos, distance: where the item's two rarest different terms stand at most `slop` words apart, in any order.

    pos is a place of the rarer term and distance that to the nearest other one.
    """
    index = index_of(docs, benchmark)
    near = near_pairs(index, slop).join(index.paired, "pair")
    return keyed(docs).select(*KEY, "doc_id").join(near, KEY).select("doc_id", "item_id", "pos", "distance")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (as sorted strings), contaminated, n_near, near_distance: a row per row of docs.

    n_near: items whose two rarest terms stand at most `slop` words apart somewhere; near_distance: the least such distance.
    Items of a window are rows until a document's own are put together.
    """
    index = index_of(docs, benchmark, window, broadcast_rows)
    rows = phrase_matches(texts(docs), index, broadcast_rows)
    covered = F.flatten(F.transform("own_matches", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1)))
    own = F.array_distinct(F.transform("own_matches", lambda c: F.struct(c["w"].alias("w"), c["words"].alias("words"))))
    rows = materialize(rows.select("doc_id", *KEY, F.size("own_words").cast("long").alias("n_words"), F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), own.alias("own")))
    met = rows.select(*KEY, F.explode("own").alias("m")).select(*KEY, "m.w", "m.words").join(_small(index.holders, broadcast_rows), ["w", "words"])
    items = met.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    each = near_pairs(index, slop, broadcast_rows).groupBy(*KEY, "pair").agg(F.min("distance").alias("distance"))
    many = _small(index.paired.groupBy("pair").agg(F.count("*").alias("n")), broadcast_rows)
    near = each.join(many, "pair").groupBy(*KEY).agg(F.sum("n").alias("n_near"), F.min("distance").alias("near_distance"))
    rows = rows.drop("own").join(items, KEY, "left").join(near, KEY, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("near_distance").cast("int").alias("near_distance"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without any occurrence of a window, all columns as they are."""
    rows = packed(docs)
    return unpacked(phrase_matches(rows, index_of(rows, benchmark, window, near=False)).where(F.size("own_matches") == 0), docs)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near", "near_distance")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM s),
l AS (SELECT DISTINCT n FROM k),
g AS MATERIALIZED (SELECT doc_id, l.n, unnest(range(1, greatest(len(w) - l.n + 2, 1))) AS i, unnest(list_transform(range(1, greatest(len(w) - l.n + 2, 1)), lambda x: array_to_string(w[x:x + l.n - 1], ' '))) AS t FROM d, l),
m AS (SELECT g.doc_id, g.i, g.n, k.item_id FROM g JOIN k ON k.n = g.n AND k.t = g.t),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
tw AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b), dw AS MATERIALIZED (SELECT doc_id, i, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT term FROM tw)),
fq AS (SELECT term, count(*) AS df FROM dw GROUP BY term), rk AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS k FROM tw JOIN fq USING (term)),
pr AS (SELECT item_id, x.term AS rare, y.term AS second FROM rk x JOIN rk y USING (item_id) WHERE x.k = 1 AND y.k = 2), pp AS (SELECT rare, second, count(*) AS n FROM pr GROUP BY ALL),
nr AS (SELECT doc_id, rare, second, n, min(abs(x.i - y.i)) AS dist FROM pp JOIN dw x ON x.term = rare JOIN dw y USING (doc_id) WHERE y.term = second AND abs(x.i - y.i) <= 5 GROUP BY ALL),
ne AS (SELECT doc_id, sum(n) AS n_near, min(dist) AS near_distance FROM nr GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(near_distance AS INTEGER) AS near_distance
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN ne USING (doc_id)
"""
