"""Token-id output: documents packed into rows of fixed length by best fit, longest first.

Texts become token ids. A document longer than a row is cut into parts of a full row and a rest, nothing is dropped. Parts
are dealt to shards by hash of document, part and place in the scan; in a shard they go, longest first, each to the fullest row that still holds it, found by a
segment tree over free capacities. Rows leave as matrices of ids (padded), with the cumulative lengths of each row's
segments and positions that start again at 0 in every segment.

Cases: a text without tokens (null, empty) is in no row. Rows that repeat are packed each. Parts of equal length go by
doc_id and part. A null doc_id is packed and stays null. Other columns are not read. An empty table gives an empty result.

Size: one scan; ids are shuffled once, packed in two or four bytes. A shard holds about `shard_tokens` tokens at any size
of the corpus, also where many rows are equal, and a task holds one shard at a time; packing by shard costs at most a few open rows a shard.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.byte_bpe import load_ranks, vocabulary
from gaugeleaf.llm.common import chunks, raw_texts, table, texts

_LOOSE = re.compile(r" (?:\s|$)")
_ROW = pa.schema([
    ("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))),
    ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("parts", pa.list_(pa.list_(pa.int32()))),
])
_KIND = "matrix_id long, n_rows int, ids binary, positions binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, parts array<array<int>>"


class _Encoder(dict):
    """Token ids of pieces, as bytes. A blank before a non-blank always starts a token, so text is cut there and pieces are kept."""

    def __init__(self, path: str, pattern: str, dtype: str, limit: int = 300_000):
        super().__init__()
        import tiktoken

        ranks = {p: i for i, p in enumerate(load_ranks(path))}
        self.tokenizer, self.dtype, self.limit = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), dtype, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[piece] = np.array(self.tokenizer.encode_ordinary(piece), self.dtype).tobytes()
        return ids

    def text(self, text: str) -> bytes:
        if _LOOSE.search(text):
            return np.array(self.tokenizer.encode_ordinary(text), self.dtype).tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[p] for p in [" " + r for r in rest]])


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indexes of `lengths` (given longest first), each put into the fullest row that still holds it."""
    size = 1
    while size <= capacity:
        size *= 2
    some = [False] * (2 * size)  # some[size + c]: whether a row with c free is open
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []

    def mark(c: int, value: bool) -> None:
        node = size + c
        some[node] = value
        while node > 1:
            node //= 2
            now = some[2 * node] or some[2 * node + 1]
            if some[node] == now:
                break
            some[node] = now

    def least_from(c: int) -> int:
        """The smallest open capacity of c or more, or -1."""
        node = size + c
        if some[node]:
            return c
        while node > 1:
            if node % 2 == 0 and some[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if some[2 * node] else 2 * node + 1
                return node - size
            node //= 2
        return -1

    for i, n in enumerate(lengths):
        c = least_from(n) if n < capacity else -1
        if c < 0:
            row, left = len(rows), capacity - n
            rows.append([i])
        else:
            row = free[c].pop()
            if not free[c]:
                mark(c, False)
            rows[row].append(i)
            left = c - n
        if left:
            free[left].append(row)
            if len(free[left]) == 1:
                mark(left, True)
    return rows


def pack(docs: DataFrame, path: str, pattern: str, row_tokens: int = 2048, rows_per_matrix: int = 128, pad_id: int | None = None, shard_tokens: int = 8_000_000) -> DataFrame:
    """matrix_id, n_rows, ids and positions (n_rows x row_tokens, little-endian), cu_seqlens, doc_ids and parts of each row."""
    docs = texts(docs)
    vocabulary_size = len(load_ranks(path))
    pad = vocabulary_size if pad_id is None else pad_id
    dtype = "<u2" if max(pad, vocabulary_size) < 1 << 16 and row_tokens < 1 << 16 else "<u4"
    width = int(dtype[-1])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(32, int(size / 2.5 / shard_tokens) + 1)

    def cut(batches):
        encoder = _Encoder(path, pattern, dtype)
        for batch in chunks(batches):
            doc_ids, parts, ids = [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                whole = encoder.text(raw.decode())
                for part, a in enumerate(range(0, len(whole), row_tokens * width)):
                    doc_ids.append(doc_id)
                    parts.append(part)
                    ids.append(whole[a : a + row_tokens * width])
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "part", "ids"])

    def matrices(shard: int, rows: list[list]):
        rows = sorted(rows, key=lambda r: (-len(r[2]), r[0] is None, r[0], r[1], r[2]))
        bins = best_fit([len(r[2]) // width for r in rows], row_tokens)
        for a in range(0, len(bins), rows_per_matrix):
            part = bins[a : a + rows_per_matrix]
            ids = np.full((len(part), row_tokens), pad, dtype)
            positions = np.zeros((len(part), row_tokens), dtype)
            edges = []
            for k, row in enumerate(part):
                edge = [0]
                for i in row:
                    x = np.frombuffer(rows[i][2], dtype)
                    ids[k, edge[-1] : edge[-1] + len(x)] = x
                    positions[k, edge[-1] : edge[-1] + len(x)] = np.arange(len(x))
                    edge.append(edge[-1] + len(x))
                edges.append(edge)
            yield pa.record_batch([
                pa.array([(shard << 32) + a // rows_per_matrix], pa.int64()), pa.array([len(part)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([positions.tobytes()], pa.binary()),
                pa.array([edges], _ROW.field("cu_seqlens").type), pa.array([[[rows[i][0] for i in r] for r in part]], _ROW.field("doc_ids").type), pa.array([[[rows[i][1] for i in r] for r in part]], _ROW.field("parts").type),
            ], schema=_ROW)

    def fill(batches):
        now, held = None, []
        for batch in batches:  # sorted by shard: one is held at a time
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "part", "ids"))):
                if held and shard != now:
                    yield from matrices(now, held)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield from matrices(now, held)

    pieces = docs.mapInArrow(cut, "doc_id long, part int, ids binary")
    place = F.monotonically_increasing_id()  # deals rows that repeat to all shards; read once, in this one exchange
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", place), F.lit(shards)).cast("int"))
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(fill, _KIND)


def write(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet files of binary columns, by Spark's own writer, on any store that Spark reaches."""
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame, row_tokens: int = 2048, width: int = 2) -> DataFrame:
    """doc_id, part, ids (array): every segment of the matrices again."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{width}").reshape(row["n_rows"], row_tokens)
                out = [(d, p, ids[k, a:b].tolist()) for k in range(row["n_rows"]) for d, p, a, b in zip(row["doc_ids"][k], row["parts"][k], row["cu_seqlens"][k], row["cu_seqlens"][k][1:])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["doc_id", "part", "ids"])

    return packed.mapInArrow(read, "doc_id long, part int, ids array<int>")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return pack(table(spark, sf_dir, "documents"), path, pattern)
