"""op1, op3, op4, op5, op6 against plain Python."""

import base64
import datetime as dt
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeleaf.llm import byte_bpe, decontamination, packing, pii, url_filter


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, odd, tokenizer):
    path, pattern = byte_bpe.vocabulary()
    more = spark.createDataFrame([(20, "it's <|endoftext|>  x\u0085y \u2003z ½² 12345 😀\n\n "), (21, "ab" * 500 + "é")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    want = sorted(((r.doc_id, tokenizer.encode_ordinary(r.text or "")) for r in docs.collect()), key=repr)
    rows = byte_bpe.encode(docs, path, pattern).withColumn("raw", byte_bpe.decode(F.col("ids"), path)).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=repr) == want
    assert sorted(((r.doc_id, bytes(r.raw)) for r in rows), key=repr) == sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=repr)
    short = docs.where("length(text) < 200 or text is null")
    for native in (byte_bpe.encode_native(short, path, pattern, cached=50, sample_docs=5), byte_bpe.encode_distinct(short, path, pattern)):
        assert sorted(((r.doc_id, list(r.ids)) for r in native.collect()), key=repr) == [x for x in want if x in [(r.doc_id, tokenizer.encode_ordinary(r.text or "")) for r in short.collect()]]


def test_bpe_empty(none):
    assert byte_bpe.encode(none, *byte_bpe.vocabulary()).count() == 0


def test_packing_is_lossless(spark, odd, tokenizer):
    path, pattern = byte_bpe.vocabulary()
    packed = packing.pack(odd, path, pattern, row_tokens=256, rows_per_matrix=4).cache()
    parts = {}
    for r in packing.unpack(packed, 256).collect():
        parts.setdefault(r.doc_id, []).append((r.part, list(r.ids)))
    whole = {}
    for r in odd.select("doc_id", "text").collect():
        ids = tokenizer.encode_ordinary(r.text or "")
        whole.setdefault(r.doc_id, []).extend((k, ids[a : a + 256]) for k, a in enumerate(range(0, len(ids), 256)))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in whole.items() if v}
    import numpy as np

    for r in packed.collect():
        pos = np.frombuffer(r.positions, "<u2").reshape(r.n_rows, 256)
        for k, edges in enumerate(r.cu_seqlens):
            assert edges[0] == 0 and edges[-1] <= 256 and all((pos[k, a:b] == np.arange(b - a)).all() for a, b in zip(edges, edges[1:]))


def test_rows_that_repeat_fill_many_shards(spark, tokenizer):
    path, pattern = byte_bpe.vocabulary()
    text = "the same text again, and some more of it " * 3
    n = len(tokenizer.encode_ordinary(text))
    df = spark.createDataFrame([(7, text)] * 3000 + [(None, text)] * 500, "doc_id long, text string").repartition(4)
    packed = packing.pack(df, path, pattern, row_tokens=128, rows_per_matrix=8, shard_tokens=n * 200).cache()
    held = packed.select((F.col("matrix_id") / (1 << 32)).cast("long").alias("shard"), F.aggregate("doc_ids", F.lit(0), lambda a, x: a + F.size(x)).alias("k")).groupBy("shard").agg(F.sum("k").alias("k")).collect()
    assert sum(r.k for r in held) == 3500 * -(-n // 128) and len(held) >= 16 and max(r.k for r in held) < 600 * -(-n // 128)
    assert {tuple(r.ids) for r in packing.unpack(packed, 128).where("part = 0").select("ids").collect()} == {tuple(tokenizer.encode_ordinary(text)[:128])}


def test_best_fit_takes_the_fullest_row():
    import random

    rng = random.Random(1)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
        free, want = [], []
        for i, n in enumerate(sizes):
            fit = min((f for f in free if f >= n), default=None)
            if fit is None:
                free.append(50 - n)
            else:
                free[free.index(fit)] -= n
            want.append(fit)
        rows = packing.best_fit(sizes, 50)
        assert sorted(i for r in rows for i in r) == list(range(200)) and all(sum(sizes[i] for i in r) <= 50 for r in rows) and len(rows) == len(free)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits(docs, items, window=10):
    cut = []
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        if w and i is not None:
            n = min(window, len(w))
            cut += [(i, w[k : k + n]) for k in range(len(w) - n + 1)]
    out = []
    for i, t in docs:
        w, at, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for item, x in cut:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    at |= set(range(k, k + len(x)))
                    found.add(str(item))
        out.append((i, len(w), len(at), len(found), ",".join(sorted(found)), bool(at)))
    return sorted(out, key=repr)


def test_phrases_equal_brute_force(spark, odd):
    items = [(1, "The CAT sat, on the mat and looked at the dog in"), (2, "word"), (3, None), (4, ""), (10, "another text under"), (11, "mat sat cat"), (None, "two words"), (2, "word"), (12, "a b a b a b a b a b a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in decontamination.report(odd, bench).collect()]
    assert sorted(got, key=repr) == hits(rows, items)


def test_no_items_and_no_documents(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(odd, bench).where("contaminated").count() == 0
    assert decontamination.report(none, bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare x x other"), (2, "other rare"), (3, "rare x x x x x x x x x other")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "rare other x")], "item_id long, text string")
    got = {(r.doc_id, r.distance) for r in decontamination.proximity_matches(docs, bench, slop=5).collect()}
    assert got == {(1, 3), (2, 1)}
    assert decontamination.postings(docs).where("term = 'rare'").count() == 3
    rows = {r.doc_id: (r.n_near, r.near_distance, r.n_hit) for r in decontamination.report(docs, bench).collect()}
    assert rows == {1: (1, 3, 0), 2: (1, 1, 0), 3: (0, None, 0)}


def test_proximity_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(4000)]
    rows = [(i % 37 or None, " ".join(words[i * 40 : i * 40 + rng.randrange(40)]) or None) for i in range(100)]
    rows += rows[:9]  # repeats, under one doc_id and without any
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for i in range(30)] + [(40, None), (41, ""), (None, "w1 w2"), (42, "absent w1"), (43, "w3 w3 w3"), (44, "w59 w58"), (45, "w59 w58 w0")]
    texts = [(t or "").split() for _, t in rows]
    df = Counter(w for t in texts for w in t)
    two = [sorted({w for w in (t or "").split() if w in df}, key=lambda w: (df[w], w))[:2] for i, t in items if i is not None]
    want = []
    for (i, _), t in zip(rows, texts):
        best = [min((abs(p - q) for p, x in enumerate(t) if x == a for q, y in enumerate(t) if y == b), default=99) for a, b in (x for x in two if len(x) == 2)]
        near = [x for x in best if x <= 5]
        want.append((i, len(near), min(near, default=None)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 1):  # with broadcasts and without
        got = [(r.doc_id, r.n_near, r.near_distance) for r in decontamination.report(docs, bench, broadcast_rows=most).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(n for _, n, _ in want) > 50


def test_a_window_of_all_items(spark):
    """Its items are rows: a document that hits it names them all."""
    shared = " ".join(f"s{i}" for i in range(10))
    bench = spark.createDataFrame([(i, f"{shared} own{i} end") for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {shared} after"), (2, "before after"), (3, f"{shared} own7 end")], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontamination.report(docs, bench).collect()}
    assert (rows[1].n_items, rows[1].n_hit, rows[2].n_items, rows[3].n_items, rows[3].n_hit) == (3000, 10, 0, 3000, 12)
    assert rows[1]["items"] == sorted(map(str, range(3000)))


def test_url_rules_and_parts(spark):
    urls = [
        None, "", "no scheme", "HTTP://A.Example.NET/x", "http://example.net/en/1", "http://www.example.net/en/1", "http://example.net/de/", "https://m.example.com/de/1", "http://x.org/fr/", "http://net",
        "http://notnet/x", "a://b://c.net/", "http://y.net?q=/", "http://z.net/#f", "http://k.org/fr",
    ]
    df = spark.createDataFrame([(i, u, "<html>", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, html string, score int, rule string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.labelled_urls(spark)).collect()}

    def want(u):
        at = (u or "").find("://")
        rest = u[at + 3 :] if u and at >= 0 else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOW)
        fit = [(len(r), v, r) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else None

    for i, u in enumerate(urls):
        host, path, rule, verdict = want(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))


def test_url_model_on_held_out_urls(spark):
    """Frames, and names, that the labelled table does not have: the model is a weak judge of those, but leaves wanted ones alone."""
    frames = ("https://shop.my{w}site.example/p/{n}", "http://{w}.net.example/index.php?id={n}", "https://a.b.example.org/x/{w}-{n}.html", "http://the-{w}-zone.example.com/")
    names = ["bramowik", "quellin", "dorsafe", "ponteva", "urlingham", "maisonet", "fjordal", "zebrina", "copenly", "tuvalin", "ostrander", "kelvima"]
    rows = [(f.format(w=w, n=17 * k), label) for label, words in ((1, url_filter.UNWANTED), (0, url_filter.WANTED), (0, names)) for w in words for k, f in enumerate(frames)]
    table = url_filter.labelled_urls(spark)
    seen = [(r.url, r.label) for r in table.collect()]
    assert not {u for u, _ in seen} & {u for u, _ in rows}
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows + seen)], "page_id long, url string")
    got = {r.page_id: r.score for r in url_filter.judge(df, table, rules=()).collect()}
    bad, good = ([got[i] for i, (_, x) in enumerate(rows) if x == label] for label in (1, 0))
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    own = [(got[len(rows) + i] >= 0.5) == bool(label) for i, (_, label) in enumerate(seen)]
    assert auc >= 0.7 and sum(g < 0.5 for g in good) >= 0.85 * len(good) and sum(own) >= 0.85 * len(own), (auc, sum(g < 0.5 for g in good) / len(good), sum(own) / len(own))


def test_url_rule_part_equals_sql(spark):
    """Host, path, rule and the rules' verdicts over the pages table; the model's verdict is not SQL's to state."""
    import duckdb

    got = url_filter.op5_url_filter(spark, "/root/testdata/sf0.001").collect()
    arms = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{v}|{r}'" for v, r in sorted(url_filter.RULES, key=lambda x: -len(x[1])))
    sql = f"""SELECT page_id, host, path, CASE {arms} END AS fit FROM (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM '/root/testdata/sf0.001/pages.parquet')"""
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    assert len(got) == len(want) and all((r.host, r.path) == want[r.page_id][:2] for r in got)
    for r in got:
        fit = want[r.page_id][2]
        assert (r.rule, r.verdict) == tuple(reversed(fit.split("|"))) if fit else r.rule is None and r.verdict == ("block" if r.score >= 0.5 else "allow")


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms_keep_their_format(spark, odd):
    texts = {
        1: "card 4041894974608795 or 4041 8949 7460 8795", 2: "bad 4041894974608796", 3: "+1 (988) 555-2485, +1 (988) 555-2485", 4: "42.144.35.254 not 300.1.1.1", 5: "bosbt.42@mail8.example.com",
        6: "DE89 3704 0044 0532 0130 00", 7: "078-05-1120 on 1987-02-03 and 02/30/2001", 8: None, 9: "", 10: "plain words",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df).collect()}
    a, b = re.match(r"card (\d{16}) or ([\d ]+)$", got[1].text).groups()
    assert a == b.replace(" ", "") != "4041894974608795" and luhn(a) and a[0] == "4"
    assert [got[i].text for i in (2, 8, 9, 10)] == [texts[i] for i in (2, 8, 9, 10)]
    x, y = got[3].text.split(", ")
    assert x == y != "+1 (988) 555-2485" and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x)
    ip = got[4].text.split(" ")
    assert ip[2] == "300.1.1.1" and ip[0] != "42.144.35.254" and all(int(p) < 256 for p in ip[0].split("."))
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com", got[5].text) and got[5].text != texts[5]
    plain = got[6].text.replace(" ", "")
    assert plain[:2] == "DE" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain != texts[6].replace(" ", "")
    ssn, day = re.match(r"(\d{3}-\d{2}-\d{4}) on (\d{4}-\d{2}-\d{2}) and 02/30/2001$", got[7].text).groups()
    assert ssn != "078-05-1120" and dt.date(1900, 1, 1) <= dt.date.fromisoformat(day) < dt.date(1900, 1, 1) + dt.timedelta(pii.DAYS)
    assert pii.pseudonymize(odd).select("doc_id", "lang", "score").count() == odd.count()


def plain_feistel(values, bounds, key, kind):
    cut = len(values) // 2
    left, right, lb, rb = values[:cut], values[cut:], bounds[:cut], bounds[cut:]

    def add(half, hb, other, turn):
        seed = f"{key}|{kind}|{turn}|{','.join(map(str, other))}"
        h = "".join(hashlib.sha256(f"{m}|{seed}".encode()).hexdigest() for m in "abc")
        return [(v + int(h[6 * i : 6 * i + 6], 16)) % b for i, (v, b) in enumerate(zip(half, hb))]

    for turn in range(pii.ROUNDS):
        left, right = (add(left, lb, right, turn), right) if turn % 2 == 0 else (left, add(right, rb, left, turn))
    return left + right


def test_feistel_is_a_permutation(spark):
    rows = [(a, b) for a in range(6) for b in range(7)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = df.select("a", "b", pii.feistel(F.array("a", "b"), F.array(F.lit(6), F.lit(7)), F.lit("k"), "t").alias("v")).collect()
    assert len({tuple(r.v) for r in got}) == 42 and all(list(r.v) == plain_feistel([r.a, r.b], [6, 7], "k", "t") for r in got)


def test_phones_of_any_area_and_country(spark):
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(073) 155-8658", "+14155552671", "+44 20 7946 0958", "+49 (0)30 1234567", "+353 1 234 5678", "415-555-2671"]
    df = spark.createDataFrame([(i, f"call {p}, now") for i, p in enumerate(phones)], "doc_id long, text string")
    for r in pii.pseudonymize(df).collect():
        old, new = phones[r.doc_id], r.text[5:-5]
        code = re.match(r"\+(?:1|44|49|353)|", old).group()
        assert list(r.pii) == ["phone"] and new != old and new.startswith(code) and re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", old)
        assert not (old[4:5] == "(" and (old[5] < "2") != (new[5] < "2"))


def test_cards_and_ibans_beside_other_digits(spark):
    card, iban = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"
    texts = [f"{card} 12/26", f"{card} 123", f"{card} 5500 0000 0000 0004", f"123456 {card}", f"{iban} 2024", f"{iban} {card}", f"{card} 2001-12-31", f"{card} 078-05-1120"]
    kinds = [["card"], ["card"], ["card", "card"], ["card"], ["iban"], ["iban", "card"], ["card", "date"], ["card", "ssn"]]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].pii) == kinds[i] and card not in got[i].text and iban not in got[i].text and len(got[i].text) == len(t)
    assert got[0].text.endswith(" 12/26") and got[1].text.endswith(" 123") and got[3].text.startswith("123456 ") and got[4].text.endswith(" 2024")


def test_url_model_on_words_it_never_saw(spark):
    """A fourth of the words of both kinds is left out in turn and judged by a model of the others: better than chance, no more."""
    pairs = []
    for turn in range(4):
        out = [w for k, w in enumerate(url_filter.UNWANTED) if k % 4 == turn], [w for k, w in enumerate(url_filter.WANTED) if k % 4 == turn]
        rows = [(f.format(w=w, n=77), label) for label, words in ((1, out[0]), (0, out[1])) for w in words for f in url_filter.FRAMES]
        df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
        got = {r.page_id: r.score for r in url_filter.judge(df, url_filter.labelled_urls(spark, frozenset(out[0] + out[1])), rules=()).collect()}
        bad, good = ([got[i] for i, (_, x) in enumerate(rows) if x == label] for label in (1, 0))
        pairs += [(b > g) + 0.5 * (b == g) for b in bad for g in good]
    assert sum(pairs) / len(pairs) > 0.5
