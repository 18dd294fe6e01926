"""Byte-level BPE encoding and decoding with a given rank file: ranked merges folded over the bytes of distinct pieces.

A text is cut into pieces by the tokenizer's pattern. A piece starts as its single bytes; step by step the leftmost
neighbouring pair whose joined bytes have the lowest rank is merged, until no pair has one. encode() folds each distinct
piece once as long as it stays in a task's cache of bounded size, in Arrow batches; encode_native() states the same fold
in Spark's higher-order functions over a literal rank map. Both give equal ids; the native one takes several times the
CPU seconds that the check tool allows (README has the figures), so op6 and the pipeline use encode(). Decoding
concatenates the bytes of the ids by a literal table, in higher-order functions.

Cases: a null text counts as empty and has no ids. Special tokens' strings are ordinary text. Repeated rows get equal rows.
Other columns are not read. An empty table gives an empty result.

Size: one scan of the texts, no shuffle. A fold takes n log n steps for a piece of n bytes, so one endless word is no trap.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import KEY, chunks, keyed, raw_texts, table, texts

SLOTS, WORD_SLOTS = 1 << 16, 1 << 16
_BYTES, _NONE = [bytes([b]) for b in range(256)], 1 << 60


def java_pattern(pattern: str) -> str:
    """The pattern for Java: there, \\s has ASCII blanks only."""
    return pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}").replace(r"\s", r"\p{IsWhite_Space}")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[bytes, ...]:
    """The byte strings of a rank file on the driver, by id."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(path, "rb"))}
    return tuple(ranks[i] for i in range(len(ranks)))


def _literal(value, kind: str) -> Column:
    """A nested constant: one string that the optimizer turns into a literal."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _slot(left, right, slots: int):
    return (left * 40_503 + right * 2_654_435) % slots


@lru_cache(maxsize=4)
def _rank_tables(path: str) -> tuple[Column, Column, Column]:
    """Ids of single bytes, maps from pairs to joined ids, and the bytes of each id as Latin-1 text."""
    pieces = load_ranks(path)
    ids = {p: i for i, p in enumerate(pieces)}
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for joined, i in ids.items():
        for cut in range(1, len(joined)):
            a, b = ids.get(joined[:cut]), ids.get(joined[cut:])
            if a is not None and b is not None:
                slots[_slot(a, b, SLOTS)][str((a << 20) + b)] = i
    return (
        _literal([ids[bytes([x])] for x in range(256)], "array<int>"),
        _literal(slots, "array<map<string,int>>").cast("array<map<bigint,int>>"),  # JSON has string keys only
        _literal([p.decode("latin-1") for p in pieces], "array<string>"),
    )


def fold(piece: Column, path: str) -> Column:
    """The ids of one piece, by ranked merges over its bytes."""
    single, pairs, _ = _rank_tables(path)

    def joined(a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("long"), 20) + b
        return F.get(pairs, F.pmod(a.cast("long") * 40_503 + b.cast("long") * 2_654_435, F.lit(SLOTS)).cast("int"))[key]

    def step(ids: Column, _: Column) -> Column:
        n = F.size(ids)
        ranks = F.when(n > 1, F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n - 1), joined)).otherwise(F.array(F.lit(None).cast("int")))

        def merge(r: Column) -> Column:
            low = F.array_min(r)
            at = F.array_position(r, low).cast("int")
            return F.when(low.isNull(), ids).otherwise(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, n)))

        return F.get(F.transform(F.array(ranks), merge), F.lit(0))

    raw = F.split(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), "")
    start = F.transform(raw, lambda c: F.get(single, F.ascii(c)))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(piece)), start, step)


def pieces_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def frequent_pieces(docs: DataFrame, path: str, pattern: str, most: int, sample_docs: int, seed: int = 3) -> Column | None:
    """Maps from the `most` frequent distinct pieces of a bounded sample to their ids, each folded once."""
    n = docs.count()
    some = docs.sample(min(1.0, sample_docs / n), seed) if n else docs
    words = some.select(F.explode(pieces_of(F.col("text"), pattern)).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(most)
    rows = words.repartition(24).select("w", F.pmod(F.hash("w"), F.lit(WORD_SLOTS)).alias("slot"), fold(F.col("w"), path).alias("ids")).collect()
    if not rows:
        return None
    slots: list[dict[str, list[int]]] = [{} for _ in range(WORD_SLOTS)]
    for w, slot, ids in rows:
        slots[slot][w] = ids
    return _literal(slots, "array<map<string,array<int>>>")


def encode_native(docs: DataFrame, path: str, pattern: str, cached: int = 65_536, sample_docs: int = 20_000) -> DataFrame:
    """What encode() gives, in higher-order functions: frequent distinct pieces of a sample are folded once, others in place.

    Which pieces the sample holds changes no result.
    """
    docs = texts(docs)
    known = frequent_pieces(docs, path, pattern, cached, sample_docs) if cached else None

    def ids(w: Column) -> Column:
        if known is None:
            return fold(w, path)
        return F.coalesce(F.get(known, F.pmod(F.hash(w), F.lit(WORD_SLOTS)))[w], fold(w, path))

    return docs.select("doc_id", F.flatten(F.transform(pieces_of(F.col("text"), pattern), ids)).alias("ids"))


def encode_distinct(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What encode() gives, in DataFrame operations: each distinct piece of the corpus is folded once and its ids joined back.

    The places of pieces are shuffled twice, by piece and by document; README has the figures.
    """
    rows = keyed(texts(docs))
    placed = rows.select(*KEY, F.posexplode(pieces_of(F.col("text"), pattern)).alias("pos", "w"))
    folded = placed.select("w").distinct().select("w", fold(F.col("w"), path).alias("own"))
    listed = F.array_sort(F.collect_set(F.struct("pos", "own")))
    ids = placed.join(folded, "w").groupBy(*KEY).agg(F.flatten(F.transform(listed, lambda x: x["own"])).alias("ids"))
    return rows.select(*KEY, "doc_id").join(ids, KEY, "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the leftmost pair of lowest rank is joined until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [_BYTES[b] for b in piece]
    if len(parts) > 64:
        return _merged_long(parts, ranks)
    get = ranks.get
    low = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
    while low:
        rank = min(low)
        if rank == _NONE:
            break
        i = low.index(rank)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del low[i]
        if i < len(low):
            low[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            low[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _merged_long(parts: list[bytes | None], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and links between the parts left."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and (rank := ranks.get(both := parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, both))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in parts if p is not None]


class PieceIds(dict):
    """Packed ids of text between blanks. A blank before a non-blank always starts a piece, so a text is cut there."""

    def __init__(self, path: str, pattern: str, limit: int = 500_000):
        super().__init__()
        import regex

        blank = r"\p{White_Space}"
        own = pattern.replace(r"[^\s", "[^" + blank).replace(r"\S", r"\P{White_Space}").replace(r"\s", blank)
        self.ranks, self.limit = {p: i for i, p in enumerate(load_ranks(path))}, limit
        self.pieces: dict[str, list[int]] = {}
        self.cut, self.loose = regex.compile(own).findall, regex.compile(r" (?:\s|$)").search

    def fold(self, text: str) -> bytes:
        ids: list[int] = []
        for p in self.cut(text):
            if (known := self.pieces.get(p)) is None:
                if len(self.pieces) >= self.limit:
                    self.pieces.clear()
                known = self.pieces[p] = merged(p.encode(), self.ranks)
            ids += known
        return array("i", ids).tobytes()

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[text] = self.fold(text)
        return ids

    def text(self, text: str) -> bytes:
        if self.loose(text):
            return b"".join([self[p] for p in self.cut(text)])
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + r] for r in rest])


@lru_cache(maxsize=1)
def _kept_pieces(path: str, pattern: str) -> PieceIds:
    """A worker process keeps its pieces from task to task."""
    return PieceIds(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids, a row for each row of docs."""

    def read(batches):
        known = _kept_pieces(path, pattern)
        for batch in chunks(batches):
            ids = [known.text(raw.decode()) for raw in raw_texts(batch)]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"])

    return texts(docs).mapInArrow(read, "doc_id long, ids array<int>")


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids stand for."""
    latin = _rank_tables(path)[2]
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(latin, i)), ""), "ISO-8859-1")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    rows = encode(table(spark, sf_dir, "documents"), path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
