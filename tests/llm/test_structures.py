"""Sharding, conversation repair and periodic runs against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from gaugeleaf.llm import conversation_repair as cr
from gaugeleaf.llm import periodic_runs as pr
from gaugeleaf.llm import sharding
from gaugeleaf.llm.common import WordHash, hashed_words

SF = "/root/testdata/sf0.001"


# ---- sharding


def plain_best_fit(sizes, capacity):
    free, bins = [], []
    for size in sizes:
        fits = [(f, b) for b, f in enumerate(free) if f >= size]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(max(size, capacity))
        free[b] -= size
        bins.append(b)
    return bins


def test_best_fit_equals_a_search_of_all_bins():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.choice([10, 64, 65, 1000, 5000])
        sizes = sorted((r.randint(1, int(capacity * 1.1)) for _ in range(r.randint(0, 80))), reverse=True)
        got, want = sharding.best_fit(sizes, capacity), plain_best_fit(sizes, capacity)
        left = lambda bins: sorted(sum(s for s, b in zip(sizes, bins) if b == k) for k in set(bins))
        assert left(got) == left(want)  # bins of equal room may be swapped
        if got and max(sizes) <= capacity:
            assert sharding.best_fit(sizes, capacity, max(got) + 1) == got and sharding.best_fit(sizes, capacity, max(got)) is None


def test_levelled_bins():
    r = random.Random(6)
    for _ in range(50):
        sizes = sorted((int(r.paretovariate(1.2) * 10) for _ in range(r.randint(1, 300))), reverse=True)
        bins = sharding.level(sizes, 8)
        sums = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(8)]
        alone = [s for s in sizes if s * 8 > sum(sizes)]
        rest = [s for s in sums if s not in alone]
        assert max(sums) <= max(sizes[0], -(-sum(sizes) // 8) + sizes[0]) and len(bins) == len(sizes)
        if len(sizes) > 100 and rest:
            assert max(rest) - min(rest) <= max(20, sorted(set(sizes) - set(alone))[-1])


def held_shards(rows, docs, count=None):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    where = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    return {k: sum(r.size for r in rows if r.shard == k) for k in range(count or max(slots, default=-1) + 1)}


def test_shards_of_near_equal_bytes(spark):
    rows = sharding.op11_sharding(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sums = held_shards(rows, docs, 8)
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values()) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_hot_text_odd_rows_and_no_rows(spark, odd, none):
    rows = [(i % 9, "hot text " * 20) for i in range(400)] + [(i, f"text {i} " * (i % 7)) for i in range(800)] + [(None, None), (None, None), (3, "")]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), count=8).collect()
    sums = sorted(held_shards(got, rows, 8).values())
    assert sums[-1] >= 400 * 181 and sums[-2] - sums[0] < 60
    given = [(r.doc_id, r.text) for r in odd.collect()]
    held_shards(sharding.shards(odd, count=8).collect(), given, 8)
    assert sharding.shards(none, count=8).count() == 0 and sharding.shards(none, capacity=10).count() == 0


def test_fixed_capacity(spark):
    r = random.Random(7)
    rows = [(i, "x" * r.randint(0, 400) + str(i)) for i in range(600)] + [(1000 + i, "same " * 10) for i in range(7)] + [(2000, "y" * 5000)]
    sums = held_shards(sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), capacity=3000, task_groups=50).collect(), rows)
    assert sorted(sums.values())[-1] == 5001 and sorted(sums.values())[-2] <= 3000
    assert len(sums) <= -(-sum(len(t) + 1 for _, t in rows) // 3000) + 2
    with pytest.raises(ValueError):
        sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"))


# ---- conversations


def plain_repair(rows):
    """(cost, audit) by dynamic programming over whole prefixes; rows: (initial, must go, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(cells):
        cells = dict(cells)
        for _ in range(3):
            for (s, x), t in step.items():
                if x != "s" and s in cells:
                    c, a = cells[s]
                    cells[t] = min(cells.get(t, (9e9, "")), (c + 3, a + "I"))
        return cells

    cells = {"": (0, "")}
    for initial, gone, cut in rows:
        new = {}
        for s, (c, a) in inserted(cells).items():
            ways = [(s, 4, "D")]
            if not gone:
                ways += [(t, 3 + 3 * cut, "R") for (q, x), t in step.items() if q == s and x != "s"]
                ways += [(step[s, initial], 3 * cut, "K")] if (s, initial) in step else []
            for t, cost, edit in ways:
                new[t] = min(new.get(t, (9e9, "")), (c + cost, a + edit))
        cells = new
    return min(cell for s, cell in inserted(cells).items() if s in ("", "a"))


def test_a_star_equals_dynamic_programming():
    r = random.Random(8)
    for n in [0, 1, 2, 3, 5, 8, 13, 40] * 40:
        rows = [(r.choice("suauax "), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]
        audit = cr.edits(rows, cr.NONE, None)
        assert (cr.price(audit, rows), audit) == plain_repair(rows)


def test_every_short_conversation_by_every_edit():
    for n in range(4):
        for rows in itertools.product([("s", False, False), ("u", False, True), ("a", False, False), ("u", True, False)], repeat=n):
            found = []
            for edits in itertools.product(["D", "K", "R", "IK", "IR", "ID", "IIK", "IIR"], repeat=n):
                for end in ("", "I", "II"):
                    audit = "".join(edits) + end
                    state, ok = cr.NONE, True
                    kept = iter(rows)
                    for e in audit:
                        row = next(kept) if e != "I" else None
                        if e == "D":
                            continue
                        x = row[0] if e == "K" else "a" if state == cr.USER else "u"
                        state = cr.STEPS.get((state, x), -1)
                        if state < 0 or (row and row[1]):
                            ok = False
                            break
                    if ok and state in (cr.NONE, cr.ASSISTANT):
                        found.append((cr.price(audit, list(rows)), audit))
            audit = cr.edits(list(rows), cr.NONE, None)
            assert (cr.price(audit, list(rows)), audit) == min(found)


def test_blocks_join_to_the_same_repair(monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(cr, "BLOCK", 3)
    for n in [0, 1, 3, 4, 7, 12, 50] * 40:
        rows = [(r.choice("suaua"), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]
        audit = cr.edits(rows, cr.NONE, None)
        assert (cr.price(audit, rows), audit) == plain_repair(rows)


def plain_conversations(rows):
    """What op12 returns, from (conv_id, turn, role, text)."""
    out = {c: [] for c, *_ in rows}
    space = lambda x: " " if x is None else x
    for c, t, role, text in rows:
        kind, role, text = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20, space(role), space(text)
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        out[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for c, held in out.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, *_ in held if t is not None}
        seen, flags, faults = set(), [], Counter()
        for _, role, text in held:
            last = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            flags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain_repair(flags)
        lines, state, kept = [], "", iter(held)
        for e in audit:
            row = next(kept) if e != "I" else None
            if e != "D":
                role = row[1] if e == "K" else "assistant" if state == "u" else "user"
                state = role[0]
                lines.append(f"{role}:{row[2] if row else ''}")
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[c] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def conversations():
    r = random.Random(10)
    words = ["Yes.", "No", "well?", " ", "", "Ärger 日本語!", "same", "Ok.\n "]
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice([*words, None, f"text {t}.", f"text {c} {t}"])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"line {t % 700}{'.' * (t % 3 > 0)}") for t in range(1500)]  # longer than a block and than a range
    rows += [(None, t, "user", f"q {t}?") for t in range(5)] + [(101, None, "user", "no turn."), (101, 5, "assistant", "x" * 300_000 + "."), (102, None, None, None)]
    return rows


@pytest.fixture()
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_conversations_equal_brute_force(spark, tmp_path, many_ranges):
    rows = conversations()
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, h string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in cr.op12_conversation_repair(spark, folder).collect()}
    want = plain_conversations(rows)
    assert got.keys() == want.keys()
    assert [c for c in got if got[c] != want[c]] == []
    assert len({r.part for r in cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 100").select("part").collect()}) > 1


def test_repaired_rows_and_no_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 0, "assistant", "Hello."), (1, 1, "user", "why?"), (2, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cr.repair(frame).collect()}
    assert got[1].audit == "IKDKI" and got[1].cost == 10 and got[1].duplicate == 1 and got[2].audit == "D" and list(got[2].lines) == []
    assert [tuple(x) for x in got[1].lines] == [("user", ""), ("assistant", "Hello."), ("user", "why?"), ("assistant", "")]
    assert cr.repair(frame.where("conv_id = 9")).count() == 0


def test_conversations_table(spark):
    got = {r.conv_id: tuple(r)[1:] for r in cr.op12_conversation_repair(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == plain_conversations(rows)


# ---- periodic runs


def plain_runs(words, least=24, turns=3):
    n, out = len(words), []
    for q in range(1, n // turns + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, turns * q) and not any(q % p == 0 and s <= i and s + m >= j + q for s, m, p in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(r):
    words = []
    for _ in range(r.randint(0, 6)):
        kind = r.random()
        if kind < 0.4:
            words += [r.choice("abcdefghij") for _ in range(r.randint(0, 40))]
        elif kind < 0.8:
            turn, n = [r.choice("abc") for _ in range(r.randint(1, 12))], r.randint(1, 90)
            words += (turn * (n // len(turn) + 1))[:n]
        else:
            words += words[: r.randint(0, 30)]
    return " ".join(words)


@pytest.mark.parametrize("least, turns", [(24, 3), (6, 3), (12, 4)])
def test_runs_equal_brute_force(least, turns):
    r, found = random.Random(11), 0
    for _ in range(150):
        docs = [periodic(r) for _ in range(r.randint(1, 6))]
        got = pr.find_runs(*hashed_words([d.encode() for d in docs], WordHash()), least, turns)
        want = [plain_runs(d.split(), least, turns) for d in docs]
        assert got == want
        found += sum(map(len, want))
    assert found > 200


def test_long_runs_and_bounds():
    for text, run in (("x " * 100_000, (0, 100_000, 1)), ("a b c " * 40_000, (0, 120_000, 3)), ("a " * 24, (0, 24, 1)), (" ".join(f"w{i % 700}" for i in range(2100)), (0, 2100, 700))):
        assert pr.find_runs(*hashed_words([text.encode()], WordHash())) == [[run]]
    assert pr.find_runs(*hashed_words([("a " * 23).encode(), b"", " ".join(f"w{i % 700}" for i in range(2099)).encode()], WordHash())) == [[], [], []]
    with pytest.raises(ValueError):
        pr.find_runs(*hashed_words([b"a"], WordHash()), 24, 2)


def plain_op13(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_periodic_runs_of_documents(spark, odd, none, tmp_path):
    r = random.Random(12)
    rows = [(x.doc_id, x.text) for x in odd.collect()] + [(i, periodic(r)) for i in range(20, 120)] + [(200, "word " * 30_000), (None, "tick tock " * 20)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, length int, runs string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(repr, map(tuple, pr.op13_periodic_runs(spark, folder).collect())))
    assert got == sorted(repr(plain_op13(i, t)) for i, t in rows)
    assert pr.periodic_runs(none).count() == 0 and sum("None" in x for x in got) < len(got) - 40
