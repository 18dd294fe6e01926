"""What the training-data operators share: shared-folder tables, Arrow chunks, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as byte runs without ASCII white space (0x20, 0x09-0x0D): what bytes.split() gives.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text with fixed types, and only those of the other columns that are asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


#: What tells rows apart: repeats of a doc_id by their text too, and rows without doc_id by their text alone.
KEY = ["own_doc", "own_row"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and at most `rest`) with KEY: two longs, of which only rows that repeat both doc_id and text share both."""
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    return rows.withColumn("own_doc", F.coalesce("doc_id", F.xxhash64("text", F.lit("lone")))).withColumn("own_row", F.xxhash64("doc_id", "text"))


def _named(name: str):
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and rest: all other columns in one struct, so that their names can clash with no name of ours."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return texts(docs, F.struct(*(_named(c).alias(f"c{i}") for i, c in enumerate(others)), F.lit(0).alias("own")).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, new: dict | None = None, also: dict | None = None, packed_as: DataFrame | None = None) -> DataFrame:
    """The columns of docs, in order and with their types, from packed rows.

    new: functions of a column's old value, by name. also: more columns, last. packed_as: what was packed, if docs lacks some of it.
    """
    others = [c for c in (packed_as or docs).columns if c not in ("doc_id", "text")]
    at = {c: F.col("rest")[f"c{i}"] for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    own = lambda f: (new or {}).get(f.name, lambda old: old)(at[f.name]).cast(f.dataType).alias(f.name)
    return rows.select(*map(own, docs.schema.fields), *(c.alias(name) for name, c in (also or {}).items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="gaugeleaf-"))
    return _OWN_DIR[0]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back."""
    path = f"{shared_dir(df.sparkSession)}/gaugeleaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(batches, limit: int = 4 << 20):
    """Arrow batches cut so that a piece holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hashes of words, computed once while they stay in a cache of bounded size."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashed_words(raw: list[bytes], cache: WordHash, lower: bool = False, at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, one document after the other, and where each document starts.

    Words turn to hashes once `at_once` of them are there, so that only the words of the last texts are held as objects.
    """
    words: list[bytes] = []
    parts: list[np.ndarray] = []
    bounds = np.zeros(len(raw) + 1, np.int64)
    done = 0
    for i, t in enumerate(raw):
        words += (t.translate(LOWER) if lower else t).split()
        bounds[i + 1] = done + len(words)
        if len(words) >= at_once:
            parts.append(cache.array(words))
            done, words = done + len(words), []
    return np.concatenate([*parts, cache.array(words)]), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp: the polynomial in `base` of every run of `size` word hashes, modulo 2**64, then mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b, acc = np.uint64(base), h[:n].copy()
    for k in range(1, size):
        acc *= b
        acc += h[k : k + n]
    return mixed(acc)


def starts_inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """For each window start of a chunk, whether the window ends in the document where it starts."""
    n = int(bounds[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return doc[:n] == doc[size - 1 :]
