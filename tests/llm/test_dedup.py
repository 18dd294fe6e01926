"""op2 and op10 against brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gaugeleaf.llm import near_dedup, substring_dedup

WINDOW = 13


def removed(rows, window=WINDOW):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixed_rows(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 30))] for _ in range(5)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            t[at:at] = p
        rows.append((i, " ".join(t)))
    return rows


def test_removal_equals_brute_force(spark, odd):
    for df in (odd, spark.createDataFrame(mixed_rows(), "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        for size in (16_000_000, 300):
            got = substring_dedup.remove_repeats(df, WINDOW, block_bytes=size, bucket_windows=50, digest=True)
            assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr) == removed(rows)


def test_many_hot_windows_and_rows_of_one_id(spark):
    licence = " ".join(f"w{k}" for k in range(50_012))  # 50,000 windows, in half of all documents
    rows = [(i, f"own {i} " * 9 + (licence if i % 2 else "")) for i in range(24)] + [(5, "again " + licence)] * 9 + [(None, licence)] * 9 + [(30, None), (31, licence)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.remove_repeats(df, WINDOW, block_bytes=500_000, bucket_windows=100_000, digest=True)
    assert sorted((tuple(r)[:3] + (r.kept,) for r in got.drop("intervals").collect()), key=repr) == removed(rows)


def test_both_passes_read_one_exchange(spark):
    df = substring_dedup.remove_repeats(spark.createDataFrame(mixed_rows(), "doc_id long, text string"))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_intervals_are_maximal_and_kept_is_text(spark):
    shared = " ".join(f"s{k}" for k in range(20))
    df = spark.createDataFrame([(1, shared), (2, f"a {shared} b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert rows[2].kept == "a b" and [(x.start, x.end) for x in rows[2].intervals] == [(1, 21)] and rows[1].intervals == []


def test_empty_tables(none):
    assert substring_dedup.remove_repeats(none).count() == 0 and near_dedup.near_duplicates(none).count() == 0


def shingles(text, k):
    w = tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split())
    return set() if not w else {w} if len(w) < k else {w[i : i + k] for i in range(len(w) - k + 1)}


def grouped(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    out = []
    for x, (i, _) in enumerate(rows):
        comp = least.get(find(x), i) if sets[x] else i
        out.append((i, len(sets[x]), comp, comp == i))
    return sorted(out, key=repr)


def near_rows(seed=5):
    rng = random.Random(seed)
    rows, words = [], [f"v{k}" for k in range(500)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, odd, shingle, percent):
    for df, region in ((odd, 512), (spark.createDataFrame(near_rows(), "doc_id long, text string"), 512), (spark.createDataFrame(near_rows(), "doc_id long, text string"), 8)):
        got = near_dedup.near_duplicates(df, shingle, percent, region=region)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == grouped(rows, shingle, percent)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0


def bridged_rows(copies=5):
    """Two groups of 14 texts, joined by one pair whose members agree better with all others of their groups."""
    rows = []
    for c in range(copies):
        base = [f"c{c}w{k}" for k in range(200)]

        def text(*changed):
            return " ".join(f"{w}x" if k in changed else w for k, w in enumerate(base))

        spots = [4 * k + 2 for k in range(8)]
        texts = [text(*spots[:3])] + [text(60 + 4 * k) for k in range(13)] + [text(*spots)] + [text(*spots, 120 + 4 * k) for k in range(13)]
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("region", [512, 8])
def test_one_link_between_large_groups_is_found(spark, region):
    rows = bridged_rows()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, region=region)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == grouped(rows, 3, 85)


def star_rows(copies, seed=7):
    """A base of 400 words and copies with nine words replaced each, which link to the base and hardly to one another."""
    rng = random.Random(seed)
    base = [f"s{k}" for k in range(400)]
    rows = [(copies, " ".join(base))]
    for c in range(copies):
        t = list(base)
        for k in rng.sample(range(400), 9):
            t[k] = f"c{c}x{k}"
        rows.append((c, " ".join(t)))
    return rows


def test_star_of_thousands_of_copies_is_one_group(spark):
    """Every copy within 0.85 of the base is in the base's group."""
    rows = star_rows(5000)
    base = shingles(rows[0][1], 3)
    linked = {i for i, t in rows if 100 * len(base & (s := shingles(t, 3))) >= 85 * len(base | s)}
    assert len(linked) > 4000
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()}
    assert {got[i] for i in linked} == {got[5000]}


@pytest.mark.parametrize("block", [4096, 16])
def test_crowded_groups_equal_brute_force(spark, monkeypatch, block):
    """Stars around several bases that resemble one another, in crowded regions, by blocks of any size."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, rows = random.Random(11), []
    for b in range(6):
        base = [f"s{k}" if k % 40 else f"s{k}b{b}" for k in range(400)]
        for c in range(25):
            t = list(base)
            for k in rng.sample(range(400), rng.randint(0, 12)):
                t[k] = f"b{b}c{c}x{k}"
            rows.append((len(rows), " ".join(t)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, region=8)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr) == grouped(rows, 3, 85)
