"""Repair of conversations whose roles don't alternate, by the cheapest edits, found by A* on an edit lattice.

A node of the lattice is a place between two rows and what the repaired roles so far end with: nothing, a system row, a user
row, an assistant row. Edits lead on: keep a row (0), change its role to user or assistant (3), delete it (4; a must for blank
and duplicate rows), or insert an empty user or assistant row before it (3); a truncated row that is not deleted adds 3. The
repaired roles must be nothing, or user and assistant in turn, an optional system row first and an assistant row last. The
heuristic is admissible: the sum over the rows ahead of what no path avoids, 4 for a row that must go and 3 for a truncated
one. The queue is keyed by cost plus heuristic, then by the edits' initials so far (D, I, K, R), so the first path that
reaches a node is the cheapest one and, of these, that whose initials are the least in ASCII; as both only grow by what is
appended to them and no two paths to a node differ by a prefix, the same holds of whole repairs.

Long conversations: rows are sorted by conversation and turn into ranges of about equal size, wherever a conversation ends, so one
of any length is dealt to many tasks. A task cuts its rows into blocks of 256, finds the best path from each of the four states to
each other through every block, and joins blocks: costs back from the end, then from the start the least initials among
the cheapest. Of a conversation in several ranges, costs and ranks of paths alone (32 numbers a range) meet in a group; the choice
made there goes back to the ranges.

Cases: a null role or text counts as one blank, so the text is blank; a null turn comes first; rows of one turn go by role, text and
place in the scan; a null conv_id is a conversation of its own. A role that is empty or starts with another letter than s, u,
a can't be kept. Repeated rows are duplicates. Very long texts are compared by length, CRC-32 and a 64-bit hash. Other
columns are not read. A conversation without rows (all dropped) is not in the result of repair(); an empty table gives an empty one.

Size: rows are sorted once and read again; duplicates are found by the least place for each hashed text, summed before
their shuffle. A task holds one range of rows. The final digest of a conversation, a SHA-256 over all its lines, is computed
range after range as they stream through one task, which holds one range's lines at a time.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gaugeleaf.llm import sql
from gaugeleaf.llm.common import materialize, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: What a finished conversation still needs after each state: cost and initials of inserted rows.
ENDINGS = {NONE: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
BLOCK, FAR = 256, 1 << 60
WORD = r"[^\x20\x09-\x0D]"

Row = tuple[str, bool, bool]  # the role's initial, whether the row must go, whether it is truncated


def paths(rows: list[Row], start: int, ends: dict[int, tuple[int, str]] | None = None) -> dict[int, tuple[int, str]]:
    """A*: for each state that rows can lead to from `start`, the least cost and, of its paths, the least initials.

    With ends (what each state still costs and its initials), only the best of all, by the state it leaves the rows in.
    """
    ahead = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] else CUT if rows[i][2] else 0)
    queue, closed, found = [(ahead[0], "", 0, start)], set(), {}
    while queue:
        guess, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i > len(rows):
            return {state: (guess, audit)}
        cost = guess - ahead[i]
        if i == len(rows):
            found[state] = (cost, audit)
            if ends is not None and state in ends:
                heapq.heappush(queue, (cost + ends[state][0], audit + ends[state][1], i + 1, state))
            continue
        initial, must_go, cut = rows[i]
        moves = [(DELETE, "D", i + 1, state)]
        for role in ROLES:
            if (after := STEPS.get((state, role))) is not None:
                moves.append((INSERT, "I", i, after))
                if not must_go:
                    moves.append((REROLE + CUT * cut, "R", i + 1, after))
        if not must_go and (after := STEPS.get((state, initial))) is not None:
            moves.append((KEEP + CUT * cut, "K", i + 1, after))
        for price, edit, j, after in moves:
            if (j, after) not in closed:
                heapq.heappush(queue, (cost + price + ahead[j], audit + edit, j, after))
    return found


Block = dict[tuple[int, int], tuple[int, object]]  # (from, to): cost, and what tells paths of equal cost apart, least first


def blocks(rows: list[Row]) -> list[Block]:
    return [{(s, t): p for s in range(4) for t, p in paths(rows[a : a + BLOCK], s).items()} for a in range(0, len(rows), BLOCK)]


def route(parts: list[Block], start: int, ends: dict[int, int]) -> list[int] | None:
    """The states between parts, the first and the last too, of the best path to a state of `ends`, which adds its cost there."""
    rest = [[ends.get(s, FAR) for s in range(4)]]
    for part in reversed(parts):
        rest.append([min((c + rest[-1][t] for (a, t), (c, _) in part.items() if a == s), default=FAR) for s in range(4)])
    rest.reverse()
    if rest[0][start] >= FAR:
        return None
    states = [start]
    for part, now, after in zip(parts, rest, rest[1:]):
        s = states[-1]
        states.append(min((mark, t) for (a, t), (c, mark) in part.items() if a == s and c + after[t] == now[s])[1])
    return states


def edits(rows: list[Row], start: int, end: int | None) -> str:
    """Initials of the cheapest edits from `start` to `end`, or to the conversation's end where that is None."""
    ends = ENDINGS if end is None else {end: (0, "")}
    if len(rows) <= BLOCK:
        return next(iter(paths(rows, start, ends).values()))[1]
    parts = blocks(rows)
    states = route(parts, start, {s: c for s, (c, _) in ends.items()})
    return "".join(part[s, t][1] for part, s, t in zip(parts, states, states[1:])) + (ENDINGS[states[-1]][1] if end is None else "")


def price(audit: str, rows: list[Row]) -> int:
    """What edits cost."""
    kept = iter(audit.replace("I", ""))
    return INSERT * audit.count("I") + sum(DELETE if e == "D" else (REROLE if e == "R" else KEEP) + CUT * cut for e, (_, _, cut) in zip(kept, rows))


def repaired(rows: list[Row], audit: str, state: int):
    """(place of the row or None, role or None to keep it, edit) for each edit, from `state` on."""
    i = 0
    for edit in audit:
        if edit == "D":
            yield i, None, edit
        else:
            initial = rows[i][0] if edit == "K" else "a" if state == USER else "u"
            state = STEPS[state, initial]
            yield (None if edit == "I" else i), (None if edit == "K" else ROLES[initial]), edit
        i += edit != "I"


def _ordered() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h"), F.asc("uid")]


def checked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank, duplicate, truncated or null), part and nothing else, written to the shared folder.

    part numbers ranges of rows in order of conversation and turn.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("crc", F.struct(F.crc32(F.col("text").cast("binary")), F.length("text")))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("role").alias("c"), F.col("h").alias("d"), F.col("uid").alias("e"))
    first = rows.groupBy("conv_id", "role", "h", "crc").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("k1"), F.col("role").alias("k2"), F.col("h").alias("k3"), F.col("crc").alias("k4"), F.col("first.e").alias("first_uid"))
    same = F.col("conv_id").eqNullSafe(F.col("k1")) & (F.col("role") == F.col("k2")) & (F.col("h") == F.col("k3")) & (F.col("crc") == F.col("k4"))
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(F.col("uid") != F.col("first_uid"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    met = rows.join(first, same, "left").select(*rows.columns, fault.alias("fault"))
    ranged = met.repartitionByRange(*_ordered()).withColumn("part", F.spark_partition_id())
    return materialize(ranged.select("conv_id", "turn", "role", "text", "h", "uid", "fault", "part"))


def _streamed(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(conv_id, part, start, end, rows of one range in order) for each conversation and range; yields dicts."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = (r["conv_id"], r["part"], r["state"], r["until"])
                if held and now != key:
                    out += work(*key, held)
                    held = []
                key = now
                held.append(r)
            yield out
        yield list(work(*key, held)) if held else []

    def batched(batches):
        for out in each(batches):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    dealt = rows.repartition("conv_id", "part").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", F.asc_nulls_first("turn"), "role", "h", "uid")
    return dealt.mapInArrow(batched, schema)


def _flags(held: list[dict]) -> list[Row]:
    return [(r["role"][:1], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in held]


def _choices(rows: DataFrame) -> DataFrame:
    """conv_id, part, state and until: by which states the cheapest repair of a conversation in several ranges enters and leaves each."""

    def costs(conv_id, part, state, until, held):
        flags = _flags(held)
        parts = blocks(flags)
        for s in range(4):
            ways = [(t, "".join(p[a, b][1] for p, a, b in zip(parts, states, states[1:]))) for t in range(4) if (states := route(parts, s, {t: 0}))]
            for rank, (audit, t) in enumerate(sorted((a, t) for t, a in ways)):
                yield {"conv_id": conv_id, "part": part, "s": s, "t": t, "cost": price(audit, flags), "rank": rank}

    table_ = _streamed(rows.withColumn("state", F.lit(None).cast("int")).withColumn("until", F.lit(None).cast("int")), costs, "conv_id long, part int, s int, t int, cost long, rank int")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        ranges = [(part, {(r.s, r.t): (r.cost, r.rank) for r in g.itertuples()}) for part, g in group.groupby("part", sort=True)]
        states = route([b for _, b in ranges], NONE, {s: c for s, (c, _) in ENDINGS.items()})
        until = [int(t) for t in states[1:-1]] + [-1]
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[0], "part": [p for p, _ in ranges], "state": states[:-1], "until": until}).astype({"conv_id": "Int64"})

    return table_.groupBy("conv_id").applyInPandas(choose, "conv_id long, part int, state int, until int")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, part, state, audit, cost, and lines (array of role, text) of the repaired rows of each range of each conversation.

    Put together in order of part, they are the conversation's repair. rows has conv_id, turn, role, text. Also first, last (initials of
    the range's first and last row as given), illegal (pairs of neighbours in the range), blank, duplicate, truncated.
    """
    rows = checked(rows) if "fault" not in rows.columns else rows
    spans = rows.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    long_ = materialize(spans.where("low < high").select(F.col("conv_id").alias("long_id")))  # at most one for each border between ranges
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    whole = rows.join(F.broadcast(long_), same, "left_anti").withColumn("state", F.lit(NONE)).withColumn("until", F.lit(-1))
    pieces = rows.join(F.broadcast(long_), same, "left_semi")
    chosen = materialize(_choices(pieces)).select(F.col("conv_id").alias("c1"), F.col("part").alias("c2"), "state", "until")
    pieces = pieces.join(chosen, F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("part") == F.col("c2"))).select(*rows.columns, "state", "until")

    def mend(conv_id, part, state, until, held):
        flags = _flags(held)
        audit = edits(flags, state, None if until < 0 else until)
        lines = []
        for place, role, edit in repaired(flags, audit, state):
            if edit != "D":
                lines.append({"role": role or held[place]["role"], "text": "" if place is None else held[place]["text"]})
        initials = [f[0] for f in flags]
        faults = [r["fault"] for r in held]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        yield {"conv_id": conv_id, "part": part, "audit": audit, "cost": price(audit, flags), "lines": lines, "first": initials[0], "last": initials[-1], "illegal": illegal} | {f: faults.count(f) for f in FAULTS}

    return _streamed(whole.select(*rows.columns, "state", "until").unionByName(pieces), mend, PIECE)


FAULTS = ("blank", "duplicate", "truncated")
PIECE = "conv_id long, part int, audit string, cost long, lines array<struct<role: string, text: string>>, first string, last string, illegal long, blank long, duplicate long, truncated long"


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the hash of all its repaired lines, role:text, joined by line ends. Ranges stream by in order."""

    def hashed(batches):
        key, sha, empty = None, None, True
        for batch in batches:
            ids, digests_ = [], []
            for conv_id, text, n in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("n").to_pylist()):
                if sha is None or conv_id != key:
                    if sha is not None:
                        ids.append(key)
                        digests_.append(sha.hexdigest())
                    key, sha, empty = conv_id, hashlib.sha256(), True
                if n:
                    sha.update(("" if empty else "\n").encode() + text.encode())
                    empty = False
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests_, pa.string())], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    text = F.array_join(F.transform("lines", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    rows = pieces.select("conv_id", "part", text.alias("text"), F.size("lines").alias("n"))
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part").mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by hash: rows dropped, emptied, stripped of full stops, repeated, given to the user."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation, after damage."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = checked(damaged(given))
    pieces = materialize(repair(rows))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    before = F.lag("last").over(Window.partitionBy("conv_id").orderBy("part"))  # pieces: one for each range that a conversation is in
    ranged = pieces.withColumn("joint", F.when(before.isNotNull() & ~F.concat(before, "first").isin("su", "ua", "au"), 1).otherwise(0))
    total = lambda c: F.sum(c).alias(c)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit")
    # a conversation's last range holds the rows inserted at its end
    found = ranged.groupBy("conv_id").agg(*map(total, FAULTS), (F.sum("illegal") + F.sum("joint")).alias("illegal"), total("cost"), audit)
    out = given.select("conv_id").distinct()
    for part in (gaps, found, digests(pieces)):
        part = part.withColumnRenamed("conv_id", "own_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", *FAULTS, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by dynamic programming: for each state the least (cost, initials, lines) after each row, one recursion a row."""
    best = lambda *cells: f"list_sort([{', '.join(cells)}])[1]"
    more = lambda cell, cost, edit, line="": f"{{'c': {cell}.c + {cost}, 'a': {cell}.a || '{edit}', 't': {f'list_append({cell}.t, {line})' if line else f'{cell}.t'}}}"
    far = "{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}"
    go = lambda cell, may, cost, edit, line: f"CASE WHEN {may} AND NOT gone THEN {more(cell, cost, edit, line)} ELSE {far} END"
    to = lambda cells, role: ", ".join(
        x for c in cells for x in (go(c, f"initial = '{role[0]}'", "cut", "K", "role || ':' || text"), go(c, "true", "3 + cut", "R", f"'{role}:' || text"))
    )
    return f"""
WITH RECURSIVE {sql.CRCS},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql.crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crcs),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM given WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM dam),
flags AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
  NOT list_contains(['.', '!', '?'], regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)) AS unended FROM placed),
marked AS MATERIALIZED (SELECT *, blank OR seen AS gone, CASE WHEN unended AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS cut,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd FROM flags),
best(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}}, {far}, {far}, {far} FROM marked
  UNION ALL
  SELECT conv_id, i, {more("n", "4", "D")}, {best(more("s", "4", "D"), go("n", "initial = 's'", "cut", "K", "role || ':' || text"))}, {best(more("u1", "4", "D"), to(("n", "s", "a1"), "user"))}, {best(more("a1", "4", "D"), to(("u1",), "assistant"))}
  FROM (SELECT *, {best("a", more("u1", "3", "I", "'assistant:'"))} AS a1 FROM (
    SELECT m.conv_id, m.i, initial, role, text, gone, cut, n, s, a, {best("u", more("n", "3", "I", "'user:'"), more("s", "3", "I", "'user:'"), more("a", "3", "I", "'user:'"))} AS u1 FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1))),
ends AS (SELECT conv_id, {best("n", more("s", "6", "II", "'user:'").replace("list_append(s.t, 'user:')", "list_concat(s.t, ['user:', 'assistant:'])"), more("u", "3", "I", "'assistant:'"), "a")} AS e FROM best JOIN (SELECT conv_id AS k, max(i) AS i FROM marked GROUP BY conv_id) l ON l.k IS NOT DISTINCT FROM conv_id AND l.i = best.i),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut > 0) AS truncated, count(*) FILTER (odd) AS illegal FROM marked GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends f ON f.conv_id IS NOT DISTINCT FROM g.conv_id"""


ORACLE = _oracle()
