"""Periodic runs: stretches of words that repeat with a period, three times or more, found by a suffix tree of the words.

A run is a stretch of consecutive words whose smallest period is q, of max(min_words, min_turns * q) words at least, that
neither neighbouring word extends. After Stoye and Gusfield: two equal words-strings of length d that stand side by side and
whose next words differ (a branching tandem repeat) are two leaves of one suffix tree node of depth d, d words apart, under
different children. For each node the leaves of the smaller children are gone through and their partners looked up by rank,
n log n look-ups in all. Every run ends with a branching tandem repeat of its smallest period; rotating it to the left word
by word gives the run's start, and repeats of a multiple of that period inside a run are merged into it.

The tree is held as suffix array and longest common prefixes: the entry between two neighbours is a node with two sides, so
that a node of many children is a chain of such entries of one depth. A tree is built only over stretches in which each
window of min_words * (min_turns - 2) / min_turns words is found twice in its document: all words of a run are in one such
stretch, as is what could extend it, so that no run is lost. Words are compared by 64-bit hashes.

Collapsing a document drops each word that some run contains after that run's first q words.

Cases: null and empty texts, texts of one word or of white space have no runs and collapse to nothing or to their words. Very
long texts are processed whole. Repeated rows, repeated and null doc_ids get a result each. Runs are given by start, then
period. Other columns are not read. An empty table gives an empty result.

Size: one scan, no shuffle and no state across documents, so no key can be hot. A task holds 4 MB of text or one document at a
time, and some 60 bytes a word; stretches with periods some 300 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm import sql
from gaugeleaf.llm.common import WordHash, chunks, hashed_words, mixed, raw_texts, starts_inside, table, texts, window_hashes

WORD = r"[^\x20\x09-\x0D]+"
_TABLE, _LOOKUPS = 1 << 20, 1 << 21
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(h: np.ndarray, bounds: np.ndarray, min_words: int, window: int) -> list[tuple[int, int]]:
    """From and to of the stretches of min_words at least whose windows each are found twice in their document."""
    inside = starts_inside(bounds, window)
    if not inside.any():
        return []
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))[: len(inside)]
    keys = mixed(window_hashes(h, window) + doc * np.uint64(0x9E3779B97F4A7C15))
    known = np.sort(keys[inside])
    twice = np.zeros(_TABLE, bool)
    twice[known[1:][known[1:] == known[:-1]] & np.uint64(_TABLE - 1)] = True
    found = inside & twice[keys & np.uint64(_TABLE - 1)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], found, [False]))))
    starts, ends = edges[::2], edges[1::2] + window - 1
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= min_words]


def _suffix_array(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks, and lcp[m], the common prefix of the suffixes of ranks m - 1 and m, by doubling."""
    n, ranks, width = len(first), [first], 1
    while True:
        rank = ranks[-1]
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        steps = np.concatenate(([0], np.cumsum(keys[order[1:]] != keys[order[:-1]])))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            break
        ranks.append(rank)
        width *= 2
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = ranks[k][a[same]] == ranks[k][b[same]]
        a[same] += 1 << k
        b[same] += 1 << k
        lcp[1:][same] += 1 << k
    return order, rank, lcp


def _spans(lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each entry m of lcp the ranks low .. high - 1 of its node's two sides, low .. m - 1 and m .. high - 1."""
    n = len(lcp)
    low, high, open_ = [0] * n, [n] * n, []
    for m in range(1, n):
        x = lcp[m]
        while open_ and lcp[open_[-1]] > x:
            high[open_.pop()] = m
        low[m] = open_[-1] if open_ else 0
        open_.append(m)
    return low, high


def _branching(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, most: np.ndarray):
    """(starts, periods) of all branching tandem repeats whose period is at most most[start], by leaves of smaller sides."""
    n = len(order)
    low, high = (np.array(x, np.int64) for x in _spans(lcp.tolist()))
    nodes = np.flatnonzero((lcp > 0) & (lcp <= most[order]))
    left = nodes - low[nodes] <= high[nodes] - nodes
    a, b = np.where(left, low[nodes], nodes), np.where(left, nodes, high[nodes])
    c, d = np.where(left, nodes, low[nodes]), np.where(left, high[nodes], nodes)
    ends = np.cumsum(b - a)
    at = 0
    while at < len(nodes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LOOKUPS, "right")))
        sizes = (b - a)[at:stop]
        node = np.repeat(np.arange(at, stop), sizes)
        leaf = order[np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a[node]]
        depth = lcp[nodes[node]]
        for partner, start in ((leaf + depth, leaf), (leaf - depth, leaf - depth)):
            there = (partner >= 0) & (partner < n)
            place = rank[np.where(there, partner, 0)]
            hit = there & (place >= c[node]) & (place < d[node])
            yield start[hit], depth[hit]
        at = stop


def _rotated(h: np.ndarray, from_: int, start: int, period: int) -> int:
    """The least start, from_ at least, that a repeat of this period at `start` can be rotated to on the left."""
    step = 64
    while start > from_:
        low = max(from_, start - step)
        differ = np.flatnonzero(h[low:start] != h[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 4
    return start


def find_runs(h: np.ndarray, bounds: np.ndarray, min_words: int = 24, min_turns: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document of a chunk; h has the hashes of all words, bounds where documents start."""
    window = min_words * (min_turns - 2) // min_turns
    if window < 2:
        raise ValueError("runs are looked for from three turns and six words on")
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    stretches = _stretches(h, bounds, min_words, window)
    if not stretches:
        return out
    sizes = np.array([b - a for a, b in stretches])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    of = np.repeat(np.arange(len(stretches)), sizes)
    words = np.concatenate([h[a:b] for a, b in stretches])
    own = mixed(words + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # no word of a stretch equals one of another
    order, rank, lcp = _suffix_array(np.unique(own, return_inverse=True)[1].astype(np.int64))
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(words), 0x9E3779B97F4A7C15, np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * powers[:-1])))
    ends, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, period in _branching(order, rank, lcp, (sizes // min_turns)[of]):
        end = start + 2 * period
        first = end - np.maximum(min_words, min_turns * period)
        whole = first >= begins[of[start]]
        end, period, first = end[whole], period[whole], first[whole]
        turned = (sums[end - period] - sums[first]) * powers[period] == sums[end] - sums[first + period]
        ends.append(end[turned])
        periods.append(period[turned])
    ends, periods = np.concatenate(ends), np.concatenate(periods)
    by = np.lexsort((periods, ends))
    ends, periods = ends[by], periods[by]
    docs = np.searchsorted(bounds, [a for a, _ in stretches], "right") - 1
    for group in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends)) + 1):
        end, left = int(ends[group[0]]) if len(group) else 0, periods[group]
        while len(left):
            q, k = int(left[0]), int(of[end - 1])
            start = _rotated(own, int(begins[k]), end - 2 * q, q)
            left = left[1:]
            if end - start >= max(min_words, min_turns * q):
                left = left[(left % q != 0) | (end - 2 * left < start)]
                a, doc = stretches[k][0], int(docs[k])
                out[doc].append((a + start - int(begins[k]) - int(bounds[doc]), end - start, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a blank."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()] if runs else words)


def periodic_runs(docs: DataFrame, min_words: int = 24, min_turns: int = 3) -> DataFrame:
    """doc_id, runs (an array of start, length and period, in words) and collapsed (the text without repeats, words joined by a blank)."""

    def search(batches):
        cache = WordHash()
        for batch in batches:
            for part in chunks([batch]):
                raw = raw_texts(part)
                runs = find_runs(*hashed_words(raw, cache), min_words, min_turns)
                short = [collapsed(t.split(), found) for t, found in zip(raw, runs)]
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
                yield pa.record_batch([part.column("doc_id"), pa.array(rows, pa.list_(_RUN)), pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return texts(docs).mapInArrow(search, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def wound(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document, by hash, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.get(F.transform(F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"))), lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))), " ")), F.lit(0))

    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    new = F.get(F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, turned(w))), F.lit(0))
    return texts(docs).select("doc_id", F.when(h % 10 == 0, F.coalesce(new, "text")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with most turns, runs_sha256, collapsed_sha256."""
    rows = periodic_runs(wound(table(spark, sf_dir, "documents")))
    more = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), more)
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = rows.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal 16-word windows q words apart; stretches of neighbouring pairs of one q are q-periodic. A run of 24 words or more and of
#: three turns has such a pair, as 24 - 8 and 2 * q are 16 or more.
ORACLE = r"""
WITH raw AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
""" + sql.CRCS + r""",
hashed AS (SELECT k, doc_id, w0, len(w0) AS n, """ + sql.crc32("CAST(doc_id AS VARCHAR)") + r""" AS h FROM raw, crcs),
params AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
docs AS (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM params),
wins AS (SELECT k, unnest(range(n - 15)) AS i, unnest(list_transform(range(n - 15), lambda i: hash(w[i + 1 : i + 16]))) AS v FROM docs WHERE n >= 24),
pairs AS (SELECT x.k, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.k, y.i - x.i ORDER BY x.i) AS island FROM wins x JOIN wins y ON x.k = y.k AND x.v = y.v AND y.i > x.i),
found AS (SELECT k, q, min(i) AS s, count(*) + 15 + q AS l FROM pairs GROUP BY k, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.k = f.k AND o.q < f.q AND f.q % o.q = 0 AND o.s <= f.s AND o.s + o.l >= f.s + f.l)),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS c FROM (SELECT k, unnest(range(n)) AS i, unnest(w) AS x FROM docs) ANTI JOIN gone USING (k, i) GROUP BY k),
lines AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t, list({'s': s, 'l': l, 'q': q} ORDER BY s, q) AS r FROM runs GROUP BY k),
best AS (SELECT *, list_reduce(r, lambda a, b: CASE WHEN b.l * a.q > a.l * b.q THEN b ELSE a END) AS b FROM lines)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS "start", b.l AS length, b.q AS period, b.l * 1000 // b.q AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (k) LEFT JOIN kept USING (k)"""
