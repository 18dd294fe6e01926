"""Tables on which queries once differed from their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeleaf.plans import catalog
from gaugeleaf.plans.support_queries import r6
from gaugeleaf.streaming import atom_stream


def rows_of(spark, con, name, path):
    got = catalog.queries()[name](spark, path)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    return sorted(repr([r[c] for c in names]) for r in got.collect()), sorted(map(repr, map(list, cursor.fetchall())))


@pytest.mark.parametrize("name", ["edges", "graph_json", "relevance_tree"])
def test_repeated_claims_as_in_sql(spark, tmp_path, name):
    answer = "Revenue rose strongly. Revenue rose strongly today. Revenue rose strongly. Granite cools."
    spark.createDataFrame([(1, 0, "user", "Why did revenue rise?"), (1, 1, "assistant", answer), (2, 0, "user", "What of granite?"), (2, 1, "assistant", "Granite cools.")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "Revenue rose strongly today.", "en", "src1", 28), (2, "Granite cools.", "en", "src3", 14)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = rows_of(spark, con, name, str(tmp_path))
    assert got == want and len(got) > 1


def test_ties_round_as_in_sql(spark):
    x = [333 / 640, 323 / 640, 369 / 5760, 1 / 128, 0.25, -333 / 640, 2 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(r6("x")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in x]


def test_late_atoms_count_without_state_in_memory(spark, tmp_path):
    at = ["2026-01-01", "2026-03-01", "2026-01-02", "2026-01-01"]  # the last one again, long after
    for i, (atom, verdict) in enumerate([("a", True), ("b", True), ("c", False), ("a", True)]):
        row = spark.createDataFrame([(1, "d", "mean", atom, i, atom, "unit", verdict, 1.0, None)], atom_stream.SCORED).withColumn("at", F.lit(at[i]).cast("timestamp"))
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(atom_stream.SCORED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    atom_stream.keep_scores(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert atom_stream.kept_scores(spark, str(tmp_path / "log")).first().score == pytest.approx(2 / 3)
    assert not (tmp_path / "check" / "state").exists()
