"""Evaluation inputs: questions with answers, retrieved chunks, calibration points, fixtures, and readers and writers of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALIBRATION = T.StructType([T.StructField(n, T.StringType(), False) for n in ("id", "claim", "context")] + [T.StructField("label", T.BooleanType(), False), T.StructField("stratum", T.StringType())])
RECALL = T.StructType([T.StructField("question_match", T.StringType()), T.StructField("fact", T.StringType())])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_id, question (the first user turn), answer (assistant turns in order)."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    asked = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    rows = t.groupBy(F.col("conv_id").alias("eval_id")).agg(asked.alias("question"), said.alias("said"))
    return rows.select("eval_id", F.coalesce("question", F.lit("")).alias("question"), F.array_join(F.transform("said", lambda s: s["text"]), " ").alias("answer"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to evaluations in turn; place, date and author follow from source and doc_id."""
    n = spark.read.parquet(f"{sf_dir}/conversations.parquet").agg(F.count_distinct("conv_id").alias("n_conv"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").crossJoin(F.broadcast(n))  # n has one row
    return d.select(
        (F.col("doc_id") % F.col("n_conv")).alias("eval_id"), F.col("doc_id").alias("chunk_ord"), F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("http://"), "source", F.when(F.col("doc_id") % 11 == 0, ".fake/").otherwise(".example/"), "doc_id")).alias("url"),
        F.when(F.col("doc_id") % 7 != 0, F.when(F.col("source") == "src1", "press.example").when(F.col("source") == "src2", "fakenews.example").when(F.col("source") == "src3", "reuters.com").otherwise(F.concat("source", F.lit(".example")))).alias("domain"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN '2026-01-01' WHEN 1 THEN '2027-01-01' END").alias("date"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'Company Communications' WHEN 1 THEN 'Jane Roe' WHEN 2 THEN '' END").alias("author"),
    )


def number_chunks(evals: DataFrame) -> DataFrame:
    """chunks(eval_id, chunk_ord, chunk_id, text) from an array column `context` of texts: ids chunk-1, chunk-2, ..."""
    return evals.select("eval_id", F.posexplode("context").alias("chunk_ord", "text")).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.col("chunk_ord") + 1))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped, a malformed one is an error."""
    rows = spark.read.schema(CALIBRATION).option("mode", "FAILFAST").json(path)
    return rows.where("id is not null").withColumn("stratum", F.coalesce("stratum", F.lit("default")))


def recall_sample(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of question_match and fact; none for an empty path."""
    return spark.read.schema(RECALL).json(path) if path else spark.createDataFrame([], RECALL)


def append_atoms(atoms: DataFrame, path: str, kind: str = "parquet") -> None:
    """One batched append, in folders by dimension, as Parquet or JSON lines."""
    if kind not in ("parquet", "json"):
        raise ValueError(f"unknown log format {kind}")
    atoms.write.mode("append").partitionBy("dimension").format(kind).save(path)


def read_atoms(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The log with its dimension column; order is by seq, never by file."""
    return spark.read.schema(schema).format(kind).load(path)


#: Cases whose outcome is known in kind: name, question, answer, texts, request citations, and (url, domain, author) of the first text.
FERRIES = "Cost drivers behind the change included diesel and crews. Pricing actions taken were a spring fare. One-time or non-recurring items included a strike. Foreign-exchange effects stayed small."
CASES = (
    ("well_sourced", "Why did the herring catch grow?", "The herring catch grew after the quota rose. Ice became cheaper in spring.", ["The herring catch grew after the quota rose. Ice became cheaper in spring."], [], None),
    ("beside_the_point", "Why did the herring catch shrink?", "Granite cools slowly below ground.", ["The herring catch shrank because the water warmed."], [], None),
    ("one_part_of_four", "What were the main drivers of the decline in ferry traffic?", "Cost drivers behind the change included diesel and crews.", [FERRIES], [], None),
    ("words_for_a_patch", "Repair this broken parser.", "The parser reads a token too many, so the last line is lost.", ["The parser reads a token before it looks for the end."], [], None),
    ("denies_its_source", "Is the bridge open tonight?", "The bridge is not open tonight.", ["The bridge is open tonight."], [], None),
    ("made_up_reference", "Why did the herring catch grow?", "The herring catch grew after the quota rose [madeup-7].", ["The herring catch grew after the quota rose."], ["madeup-7"], None),
    ("reference_elsewhere", "Who kept the lighthouse?", "Ida Lewis kept the lighthouse [chunk-2].", ["Ida Lewis kept the lighthouse.", "Granite cools slowly below ground."], [], None),
    ("denied_publisher", "What became of the dam?", "The dam held through the flood [chunk-1].", ["The dam held through the flood."], [], ("https://contentfarm.example/dam", "contentfarm.example", None)),
    ("own_publicity", "How did Northmill do?", "Northmill doubled its output of paper [chunk-1].", ["Northmill doubled its output of paper."], [], ("https://ir.example/northmill", "ir.example", "Investor Relations")),
)


def fixtures(spark: SparkSession) -> DataFrame:
    """eval_id (the case's place), name, question, answer, context, citations, url, domain, author."""
    rows = [(i, *case[:5], *(case[5] or (None, None, None))) for i, case in enumerate(CASES)]
    return spark.createDataFrame(rows, "eval_id long, name string, question string, answer string, context array<string>, citations array<string>, url string, domain string, author string")


def fixture_chunks(cases: DataFrame) -> DataFrame:
    """The chunks of fixtures(); a case's place, domain and author belong to its first."""
    first = lambda c: F.when(F.col("chunk_ord") == 0, F.col(c)).alias(c)
    rows = number_chunks(cases).join(cases.select("eval_id", "url", "domain", "author"), "eval_id")
    return rows.select("eval_id", "chunk_ord", "chunk_id", "text", first("url"), first("domain"), F.lit(None).cast("string").alias("date"), first("author"))
