"""Each pipeline stage against plain Python, on tables with clashing columns, nulls, empty and long texts, ties and repeats."""

import datetime as dt
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_dedup import grouped, near_rows
from test_text_ops import LOW, hits, luhn, plain_feistel

import corpus_pipeline
from gaugeleaf.llm import ngram_ratio, pii, quality_resampling

#: Names that stages, operators and Spark's own plans use inside.
CLASHING = ["row", "words", "items", "found", "n_words", "contaminated", "matches", "pii", "pii_found", "pii_new", "row_", "rest", "own_doc", "own_row", "new", "kept", "kept_id", "target", "held", "a.b", "c0", "w", "start", "term"]
BENCH = [(1, "The CAT sat, on the mat and looked at the dog in the yard"), (2, "never seen anywhere"), (3, None), (4, "")]
PRIVATE = [
    "card 4041 8949 7460 8795, again 4041894974608795 and 4041894974608796", "+1 (988) 555-2485 or +44 20 7946 0958 or 415-555-2671", "42.144.35.254 not 300.1.1.1", "write to bosbt.42@mail8.example.com",
    "DE89 3704 0044 0532 0130 00 and AT61 1904 3002 3457 3201 2024", "078-05-1120 on 1987-02-03, 03.02.1987 and 02/30/2001 or 000-05-1120", "4111 1111 1111 1111 12/26", "2001-12-31 4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rows = [(i, int(i % 3 != 0), 0) for i in range(60)] + [(None, 1, 0), (7, None, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, odd):
    more = near_rows()[:50] + [(200 + i, t) for i, t in enumerate(PRIVATE)] + [(300, " ".join(f"long{k}" for k in range(20_000))), (301, "Shouted %%% ### words " * 5)]
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    return rows.select("doc_id", "text", F.length("text").alias("n_chars"), *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING)).repartition(3).cache()


def shown(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_columns_pass_unchanged(spark, docs, folder, name, stage):
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rest = ["doc_id", *CLASHING]
    given = shown(docs.select(*(F.col(f"`{c}`") for c in rest)).collect())
    kept = shown(got.select(*(F.col(f"`{c}`") for c in rest)).collect())
    assert kept and set(kept) <= set(given) and (name != "private" or kept == given)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, docs, folder, name, stage):
    got = stage(spark, docs.where("false"), folder)
    assert got.count() == 0 and (name == "tokens" or got.columns == docs.columns)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates_equal_brute_force(spark, docs, folder):
    rows = pairs(docs)
    kept = [(i, t) for (i, t), g in zip(rows, with_groups(rows)) if g]
    assert shown(pairs(corpus_pipeline.near_duplicates(spark, docs, folder))) == shown(kept)


def with_groups(rows):
    """Whether each row is kept: grouped() sorts, so each row asks for its own text."""
    found = {}
    for k, (i, t) in enumerate(rows):
        found.setdefault((i, t), []).append(k)
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    of = {k: component for k, _, component, _ in grouped(numbered, 5, 80)}
    least = {}
    for k, component in of.items():
        if rows[k][0] is not None:
            least[component] = min(least.get(component, rows[k][0]), rows[k][0])
    return [rows[k][0] == least.get(of[k], rows[k][0]) if (rows[k][1] or "").split() else True for k in range(len(rows))]


def test_decontaminated_equals_brute_force(spark, docs, folder):
    rows = pairs(docs)
    bad = {(i, n, h) for i, n, h, *_ in hits([r for r in rows], BENCH) if h}
    assert bad
    clean = [(i, t) for i, t in rows if not hits([(i, t)], BENCH)[0][5]]
    assert shown(pairs(corpus_pipeline.decontaminated(spark, docs, folder))) == shown(clean)


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def gram_buckets(text):
    tokens = [xxhash.xxh3_64_intdigest(t) for t in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+", (text or "").translate(LOW).encode())]
    two = [mix((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(tokens, tokens[1:])]
    return [x % ngram_ratio.BUCKETS for x in [*map(mix, tokens), *two]]


def test_quality_equals_brute_force(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    noise = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 52)).alias("u")
    rows = [(r.doc_id, r.text, r.target, r.held, (r.u + 0.5) / 2**52) for r in ngram_ratio.with_target(docs, labels).select("doc_id", "text", "target", "held", noise).collect()]
    raw, target = np.zeros(ngram_ratio.BUCKETS), np.zeros(ngram_ratio.BUCKETS)
    for _, t, good, _, _ in rows:
        for b in gram_buckets(t):
            raw[b] += 1
            target[b] += good
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    weights = [sum(ratio[b] for b in gram_buckets(t)) for _, t, *_ in rows]
    got = quality_resampling.resample(docs, labels).select("doc_id", "log_weight").collect()
    assert np.allclose(sorted(r.log_weight for r in got), sorted(weights), atol=1e-6)
    lowest = np.percentile([w for w, r in zip(weights, rows) if r[3]], 0.5)
    k = sum(w >= lowest - 1e-9 for w in weights)
    perturbed = [w - math.log(-math.log(r[4])) for w, r in zip(weights, rows)]
    cut = sorted(perturbed, reverse=True)[k - 1]
    want = [(r[0], r[1]) for p, r in zip(perturbed, rows) if p >= cut - 1e-9]
    assert 0 < len(want) and shown(pairs(corpus_pipeline.quality(spark, docs, folder))) == shown(want)


def dressed(text, new):
    new = iter(new)
    return "".join(next(new) if c.isdigit() else c for c in text)


def classes(text):
    size = lambda c: 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1
    base = lambda c: 48 if c.isdigit() else 97 if c.islower() else 65
    return [ord(c) - base(c) if size(c) > 1 else 0 for c in text], [size(c) for c in text], lambda vs: "".join(chr(base(c) + v) if size(c) > 1 else c for c, v in zip(text, vs))


def mod97(text):
    a = 0
    for c in text:
        a = (a * 10 + int(c) if c.isdigit() else a * 100 + ord(c) - 55) % 97
    return a


def plain_new(kind, text, key):
    """The pseudonym of a found string by its kind, or None where a check fails."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        if not (13 <= len(digits) <= 19 and luhn(digits)):
            return None
        moved = digits[0] + "".join(map(str, plain_feistel(list(map(int, digits[1:-1])), [10] * (len(digits) - 2), key, kind)))
        return dressed(text, moved + next(str(c) for c in range(10) if luhn(moved + str(c))))
    if kind == "iban":
        plain = text.replace(" ", "")
        if not (15 <= len(plain) <= 34 and mod97(plain[4:] + plain[:4]) == 1):
            return None
        values, bounds, write = classes(plain[4:])
        moved = write(plain_feistel(values, bounds, key, kind))
        new = iter(plain[:2] + f"{98 - mod97(moved + plain[:2] + '00'):02d}" + moved)
        return "".join(c if c == " " else next(new) for c in text)
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, b, c = plain_feistel([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], key, kind)
        return f"{a + (2 if a > 664 else 1):03d}-{b + 1:02d}-{c + 1:04d}"
    if kind == "phone":
        abroad = re.match(r"\+[2-9]", text)
        code = re.match(pii.COUNTRY, digits).group() if abroad else digits[:-10]
        own, edge = [int(c) for c in digits[len(code) :]], 1 if abroad else 2
        led = [i == 0 or (not abroad and i == 3) for i in range(len(own))]
        low = [edge if x and v >= edge else 0 for x, v in zip(led, own)]
        bounds = [(10 - edge if v >= edge else edge) if x else 10 for x, v in zip(led, own)]
        new = plain_feistel([v - x for v, x in zip(own, low)], bounds, key, kind)
        return dressed(text, code + "".join(str(v + x) for v, x in zip(new, low)))
    if kind == "ip":
        part = list(map(int, text.split(".")))
        return ".".join(map(str, plain_feistel(part, [256] * 4, key, kind))) if max(part) < 256 else None
    if kind == "date":
        shape = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[re.search(r"[-./]", text).group()]
        first = dt.datetime.fromisoformat(pii.FIRST_DAY)
        try:
            day = (dt.datetime.strptime(text, shape) - first).days
        except ValueError:
            return None
        if not 0 <= day < pii.DAYS:
            return None
        a, b = plain_feistel([day // 270, day % 270], [270, 270], key, kind)
        return (first + dt.timedelta(a * 270 + b)).strftime(shape)
    values, bounds, write = classes(text.split("@")[0])
    return write(plain_feistel(values, bounds, key, kind)) + "@" + text.split("@")[1]


def plain_text(text, key):
    def pieces(found):
        kind = next((k for k, shape in pii.SHAPES[:-1] if re.fullmatch(shape, found)), "card")
        if kind != "card":
            return [(kind, found)]
        groups, out, i = re.findall("[0-9]+[ -]?", found), [], 0
        while i < len(groups):
            runs = ("".join(groups[i : j + 1]) for j in range(min(i + 18, len(groups) - 1), i - 1, -1))
            took = next((r for r in runs if plain_new("card", r, key)), groups[i])
            out.append(("card", took))
            i += len(re.findall("[0-9]+[ -]?", took))
        return out

    return re.sub(pii.PATTERN, lambda m: "".join(plain_new(kind, p, key) or p for kind, p in pieces(m.group())), text) if text else text


def test_private_equals_brute_force(spark, docs, folder):
    spark.conf.set("spark.gaugeleaf.pii.key", "k1")
    try:
        got = [(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.private(spark, docs, folder).select("doc_id", "text", "n_chars").collect()]
    finally:
        spark.conf.unset("spark.gaugeleaf.pii.key")
    want = [(i, new := plain_text(t, "k1"), None if t is None else len(new)) for i, t in pairs(docs)]
    assert shown(got) == shown(want) and sum(a != b for (_, a, _), (_, b) in zip(shown(want), shown(pairs(docs)))) >= 8


def test_pseudonyms_need_a_key_to_repeat(spark):
    df = spark.createDataFrame([(1, "078-05-1120"), (2, "so 078-05-1120")], "doc_id long, text string")
    one = {r.doc_id: r.text for r in pii.pseudonymize(df, "one").collect()}
    assert one == {r.doc_id: r.text for r in pii.pseudonymize(df, "one").collect()} != {r.doc_id: r.text for r in pii.pseudonymize(df, "two").collect()}
    drawn = {r.doc_id: r.text for r in pii.pseudonymize(df).collect()}
    assert drawn[2] == f"so {drawn[1]}" and drawn == {r.doc_id: r.text for r in pii.pseudonymize(df).collect()}


def test_runs_of_digits_of_any_length(spark):
    card = "4111 1111 1111 1111"
    for run, by in (("7" * 10_000, 1), ("12 34 " * 2500, 1), ("7" * 300_000, 1), ("12 34-" * 50_000, 0), ("7" * 5_000_000, 0)):
        text = f"see {run} and {card}."
        rows = corpus_pipeline.private(spark, spark.createDataFrame([(1, text, len(text)), (2, None, None)], "doc_id long, text string, n_chars long"), "")
        got = {r.doc_id: r.text for r in rows.collect()}
        assert got[2] is None and len(got[1]) == len(text) and card not in got[1] and got[1].startswith("see ")
        if by:
            spark.conf.set("spark.gaugeleaf.pii.key", "k1")
            same = {r.doc_id: r.text for r in corpus_pipeline.private(spark, rows.sparkSession.createDataFrame([(1, text)], "doc_id long, text string"), "").collect()}
            spark.conf.unset("spark.gaugeleaf.pii.key")
            assert same[1] == plain_text(text, "k1")
