"""Removal of passages that an earlier document has too, by Rabin-Karp hashes of fixed-length word windows.

Documents are dealt to blocks, and a block finds each distinct window it has and the smallest doc_id that has it there. These go
to buckets by hash, where the smallest doc_id of all blocks is found for each hash; blocks that have a larger one are told. A
block then removes every window whose smallest doc_id, its own or the one it was told, is smaller than the document's. Windows
that a document has to lose merge into maximal intervals of words.

A window that very many documents share, be it one of thousands, costs a bucket one entry a block and not one a document: the
minimum is taken in the block first. Nothing is sampled, listed or broadcast.

Cases: a null or empty text has no words, nothing is removed and the kept text is empty. A row without doc_id takes no
part: it loses nothing and makes no one lose anything. Rows that repeat doc_id and text get the same result, and never
make each other lose words; rows of one doc_id and different texts neither, each loses by its own text. Such rows are dealt by
text and place in the scan too, so that many of them are many blocks. A very long text is a block by itself. Other columns are not
read. An empty table gives an empty result.

Size: the texts are shuffled once, compressed, and both passes read that one exchange; besides, eight bytes a distinct window of a
block and about one for its document, and hash and smallest doc_id of those windows that are told. A task holds one
block of `block_bytes` or one bucket of `bucket_windows` windows at a time, at any size of the corpus. Windows of different blocks are
equal if 64 bits and the bucket's own bits agree, windows of one block if 64 do: 1e-3 pairs in 30 GB are equal falsely, a few in
100 TB.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import WordHash, chunks, hashed_words, mixed, raw_texts, starts_inside, table, texts, window_hashes

SECOND_BASE = 0xC2B2AE3D27D4EB4F


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all lowest bytes first: small ones compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)


def _from_planes(raw: bytes, n: int, at: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel()


def _pack_texts(ids: list[int | None], raw: list[bytes]) -> bytes:
    n = len(raw)
    head = np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), np.array([len(t) for t in raw], "<i8")
    return struct.pack("<I", n) + _squeezed(*head, np.frombuffer(b"".join(raw), np.uint8))


def _unpack_texts(packed: bytes) -> list[tuple[int | None, bytes]]:
    n = struct.unpack_from("<I", packed)[0]
    body = zstandard.ZstdDecompressor().decompress(packed[4:])
    ids, there, sizes = np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, 8 * n), np.frombuffer(body, "<i8", n, 9 * n)
    ends = 17 * n + np.cumsum(sizes)
    return [(i if k else None, body[e - m : e]) for i, k, m, e in zip(ids.tolist(), there.tolist(), sizes.tolist(), ends.tolist())]


def _pack_found(hashes: np.ndarray, ids: np.ndarray) -> bytes:
    """Hashes, each with a doc_id; cheap where doc_ids ascend or are few."""
    used, rank = np.unique(ids, return_inverse=True)
    meta = _squeezed(_planes(np.diff(used, prepend=0).astype("<i8")), _planes(np.diff(rank, prepend=0).astype("<i4")))
    return struct.pack("<III", len(used), len(hashes), len(meta)) + meta + hashes.astype("<u8").tobytes()


def _unpack_found(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_ids, n, size = struct.unpack_from("<III", packed)
    meta = zstandard.ZstdDecompressor().decompress(packed[12 : 12 + size])
    ids = np.cumsum(_from_planes(meta, n_ids, 0, "<i8"))
    return np.frombuffer(packed, "<u8", n, 12 + size), ids[np.cumsum(_from_planes(meta, n, 8 * n_ids, "<i4"))]


class _Block:
    """The documents of a block, smallest doc_id first, and the windows of those that have one: hash, document, place."""

    def __init__(self, blobs: list[bytes], cache: WordHash, window: int):
        docs = [d for b in blobs for d in _unpack_texts(b)]
        self.docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
        self.raw = [t for _, t in self.docs]
        owned = sum(i is not None for i, _ in self.docs)
        self.ids = np.array([i for i, _ in self.docs[:owned]], np.int64)
        self.words, bounds = hashed_words(self.raw[:owned], cache)
        self.at = np.flatnonzero(starts_inside(bounds, window))
        self.hashes = window_hashes(self.words, window)[self.at]
        self.which = np.searchsorted(bounds, self.at, "right") - 1
        self.pos = self.at - bounds[self.which]
        self.order = np.argsort(self.hashes, kind="stable")
        ordered = self.hashes[self.order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        self.group = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)  # of each distinct window, in order of hash, the place of its smallest document in order


def _one_by_one(batches):
    """(key, blobs) of each key of sorted batches of key and blob."""
    now, held = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(blob.as_py())
    if held:
        yield now, held


def _batch(names: list[str], rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names)


def _parts(keys: np.ndarray) -> list[np.ndarray]:
    """Places of equal keys, key by key, each in order."""
    order = np.argsort(keys.astype(np.uint16) if not len(keys) or keys.max() < 1 << 16 else keys, kind="stable")
    return [p for p in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(p)]


def _told(blocks: DataFrame, bits: int, window: int) -> DataFrame:
    """block, told: the windows of a block that a document of another block with a smaller doc_id has, with that doc_id."""

    def deal(batches):
        cache = WordHash()
        for block, blobs in _one_by_one(batches):
            b = _Block(blobs, cache, window)
            own = np.sort(b.order[b.first])  # one place of each distinct window, by document
            second = window_hashes(mixed(b.words + np.uint64(1)), window, SECOND_BASE)[b.at[own]]
            bucket = (second >> np.uint64(64 - bits)).astype(np.int64)
            mark = struct.pack("<I", block)
            yield _batch(["bucket", "packed"], [(int(bucket[p[0]]), mark + _pack_found(b.hashes[own[p]], b.ids[b.which[own[p]]])) for p in _parts(bucket)])

    def find(batches):
        for _, blobs in _one_by_one(batches):
            found = [_unpack_found(b[4:]) for b in blobs]
            block = np.repeat([struct.unpack_from("<I", b)[0] for b in blobs], [len(h) for h, _ in found])
            hashes, ids = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(hashes, kind="stable")
            hashes, ids, block = hashes[order], ids[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
            late = np.flatnonzero(ids > least)
            late = late[np.argsort(least[late], kind="stable")]
            yield _batch(["block", "told"], [(int(block[late[p[0]]]), _pack_found(hashes[late[p]], least[late[p]])) for p in _parts(block[late])])

    dealt = blocks.sortWithinPartitions("block").mapInArrow(deal, "bucket int, packed binary")
    return dealt.repartition(1 << min(bits, 17), "bucket").sortWithinPartitions("bucket").mapInArrow(find, "block int, told binary")


def _intervals(at: np.ndarray, window: int, n: int) -> list[list[int]]:
    """The union of the windows that start at `at`, as maximal intervals of words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    gone = np.cumsum(edge)[:n] > 0
    return np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()


def remove_repeats(docs: DataFrame, window: int = 13, block_bytes: int = 16_000_000, bucket_windows: int = 2_000_000, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, intervals (start and end in words, maximal) and kept: the kept text, or its SHA-256 if digest."""
    docs = texts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, bits = max(16, -(-size // block_bytes)), min(24, max(4, int(size / 6.4 / bucket_windows).bit_length()))

    def squeeze(batches):
        for batch in chunks(batches):
            ids, raw, block = batch.column("doc_id").to_pylist(), raw_texts(batch), batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
            yield _batch(["block", "packed"], [(int(block[p[0]]), _pack_texts([ids[i] for i in p], [raw[i] for i in p])) for p in _parts(block)])

    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_blocks)).cast("int"))
    blocks = dealt.mapInArrow(squeeze, "block int, packed binary").repartition(min(n_blocks, 1 << 17), "block")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", span), ("kept", pa.string())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left.column("packed").to_pylist(), WordHash(), window)
        least = b.ids[b.which[b.order[b.first]]]
        distinct = b.hashes[b.order[b.first]]
        for blob in right.column("told").to_pylist():
            hashes, ids = _unpack_found(blob)
            at = np.searchsorted(distinct, hashes)
            least[at] = np.minimum(least[at], ids)
        late = np.sort(b.order[b.ids[b.which[b.order]] > least[b.group]]) if len(b.order) else b.order
        edges = np.searchsorted(b.which[late], np.arange(len(b.raw) + 1))
        out = []
        for k, (doc_id, raw) in enumerate(b.docs):
            words = raw.split()
            n, at = len(words), b.pos[late[edges[k] : edges[k + 1]]]
            spans = _intervals(at, window, n) if len(at) else []
            kept = [words[x:y] for x, y in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [n])] if spans else [words]
            kept = b" ".join([w for part in kept for w in part])
            out.append((doc_id, n, sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    kind = "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,end:int>>, kept string"
    return blocks.groupBy("block").cogroup(_told(blocks, bits, window).groupBy("block")).applyInArrow(cut, kind)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS i, w FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM p),
m AS (SELECT t, min(doc_id) AS least FROM k GROUP BY t),
hit AS (SELECT DISTINCT k.doc_id, k.i + u.j AS i FROM k JOIN m USING (t), (SELECT unnest(range(0, 13)) AS j) u WHERE m.least < k.doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
