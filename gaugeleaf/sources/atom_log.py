"""A keyed log of atoms in a shared folder: versions are written whole or not at all, the last one of a key holds, old ones fold together.

Version v is a folder v=<v> of Parquet files by dimension; one that folds all versions up to v into the last row of each key is upto=<v>.
A folder counts once its writer has left its _SUCCESS mark in it, so a reader sees whole versions only, and one that began before a
fold goes on with the files that it listed. Writing a version again (a repeated batch) replaces it. Rows are read by any Spark store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.operators.atoms import latest

MARK = "_SUCCESS"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The version that the newest whole fold reaches (-1: none), and the whole versions after it, in order."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return -1, []
    child = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{MARK}")
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    whole = [(kind, int(n)) for kind, _, n in (x.partition("=") for x in names) if kind in ("v", "upto") and n.isdigit() and fs.exists(child(f"{kind}={n}"))]
    base = max((n for kind, n in whole if kind == "upto"), default=-1)
    return base, sorted(n for kind, n in whole if kind == "v" and n > base)


def write(atoms: DataFrame, path: str, version: int | None = None) -> int:
    """Append atoms as one version, the next one unless it is named; a version that a fold has taken in is left as it is."""
    spark = atoms.sparkSession
    base, after = versions(spark, path)
    number = max([base, *after]) + 1 if version is None else version
    if number > base:
        atoms.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy("dimension").parquet(f"{path}/v={number:020d}")
    return number


def read(spark: SparkSession, path: str, schema, key: str | list[str] = "atom_id", dimensions: list[str] | None = None, by: str | None = None) -> DataFrame:
    """The last row of each key, in any order (seq orders); with dimensions, only their folders are read.

    by: a column of the key to deal rows by, if what follows groups by it, too.
    """
    base, after = versions(spark, path)
    out = spark.createDataFrame([], schema).withColumn("version", F.lit(0).cast("long"))
    parts = ([(f"upto={base:020d}", base)] if base >= 0 else []) + [(f"v={n:020d}", n) for n in after]
    for name, n in parts:
        rows = spark.read.schema(schema).parquet(f"{path}/{name}").withColumn("version", F.lit(n).cast("long"))
        out = out.unionByName(rows)
    if dimensions is not None:
        out = out.where(F.col("dimension").isin(*dimensions))
    out = out if by is None else out.repartition(by)
    return latest(out.withColumn("written", F.struct("version", "seq")), key, "written").drop("version", "written")


def fold(spark: SparkSession, path: str, schema, key: str = "atom_id") -> int:
    """Write all versions there are as one table of last rows; returns the version that it reaches. Versions stay until vacuum()."""
    base, after = versions(spark, path)
    if not after:
        return base
    read(spark, path, schema, key).write.mode("overwrite").partitionBy("dimension").parquet(f"{path}/upto={after[-1]:020d}")
    return after[-1]


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove what a whole fold has replaced, and older folds; returns how many folders went. For when no reader of theirs is left."""
    base, _ = versions(spark, path)
    fs, where = _files(spark, path)
    old = [x.getPath() for x in fs.listStatus(where) if (name := x.getPath().getName().partition("="))[2].isdigit() and (int(name[2]) < base or (int(name[2]) == base and name[0] == "v"))]
    for folder in old:
        fs.delete(folder, True)
    return len(old)
