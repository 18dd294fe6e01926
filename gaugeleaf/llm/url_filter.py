"""URL filter: rules by host and path first, logistic regression on hashed character n-grams for the rest.

Host: what follows the first "://" up to a slash, question mark, hash or the end, A-Z lower-cased. Path: what follows it up
to a question mark, hash or the end. A rule fits its host and all subdomains where the path starts with the rule's; the
longest fitting rule decides. Other URLs are judged by the model: 3- to 5-character grams of host and path, marked apart
and at their ends, hashed to 2**18 weights that a small labelled table taught: words that tell, in invented URLs of several frames.
A word that the table doesn't have is judged by the letters it shares with those it has, which is little.

Cases: a null URL or one without "://" has an empty host and path, which no rule fits; the model judges what remains. Rows
that repeat are judged alike. Other columns, html too, are not read. An empty table gives an empty result.

Size: one scan of the url column, no shuffle, no Python on executors. The labelled table is bounded by `most` rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeleaf.llm.common import table

BUCKETS, SIZES = 1 << 18, (3, 4, 5)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of names that are unwanted, and of names that are not, to make labelled URLs of.
UNWANTED = """casino slots jackpot poker betting lottery bingo roulette pills viagra pharma steroids porn xxx adult sex escort singles cams nude
payday loans doubler freecoins iphone-prize winner warez keygen crack torrent replica spam backlinks clickbait popup adserver tracker
phishing login-verify hacktool cheats miracle-diet get-rich malware scam""".split()
WANTED = """news library university school museum weather recipes garden travel maps health law history nature music cinema science
engineering chess dictionary archive statistics council sports forum docs wiki journal research books courses community church village
energy bakery railway parliament hospital theatre farming geology poetry""".split()
#: Where in a URL a word can stand; {n} is a number.
FRAMES = (
    "http://www.{w}.example.com/en/{n}", "https://{w}-{n}.example.org/de/{n}.html", "http://m.{w}-x.example.net/fr/{n}?page=2", "https://blog.best{w}.example.org/{n}/", "http://site{n}.example.com/{w}/{n}#top",
)
#: Syllables of made-up names, which are wanted as far as their letters say nothing.
SYLLABLES = "ka lo mi ren tor sel va dun pe shi ro an the on er st ne li".split()


def labelled_urls(spark: SparkSession, without: frozenset[str] = frozenset()) -> DataFrame:
    """url, label (1: unwanted): a small table, every word (but those of `without`) in every frame and as many made-up names as there are
    unwanted words.
    """
    n = len(SYLLABLES)
    made = [SYLLABLES[i % n] + SYLLABLES[(3 * i + 1) % n] + SYLLABLES[(7 * i + i // n) % n] for i in range(len(UNWANTED))]
    words = [(w, 1) for w in UNWANTED if w not in without] + [(w, 0) for w in (*WANTED, *made) if w not in without]
    rows = [(frame.format(w=w, n=(37 * i + 11 * j) % 9000 + 100), label) for i, (w, label) in enumerate(words) for j, frame in enumerate(FRAMES)]
    return spark.createDataFrame(rows, "url string, label int")


def _low(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without "://"; white space and line ends are ordinary characters."""
    part = lambda n: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", n)
    return _low(part(1)), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest fitting rule, null if none fits."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(chosen)
    return chosen


def _grams(mark: str, whole: Column, n: int) -> Column:
    starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, told apart by a mark, with repeats."""
    ends = (("h", F.concat(F.lit("<"), host, F.lit(">"))), ("p", F.concat(F.lit("<"), path, F.lit(">"))))
    return F.concat(*(_grams(mark, whole, n) for mark, whole in ends for n in SIZES))


def features(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """rows (host, path) with features: a sparse vector of hashed n-gram counts of length 1."""
    counted = HashingTF(inputCol="grams", outputCol="counts", numFeatures=buckets).transform(rows.withColumn("grams", grams(F.col("host"), F.col("path"))))
    return Normalizer(inputCol="counts", outputCol="features", p=2.0).transform(counted).drop("grams", "counts")


def train(labelled: DataFrame, most: int = 10_000, penalty: float = 0.0005) -> LogisticRegressionModel:
    """Uses `most` labelled rows at most, always the same ones; both labels weigh the same in sum."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("label in (0, 1)").select("url", "label").distinct().orderBy(F.xxhash64("url", "label"), "url", "label").limit(most)
    rows = features(rows.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path")))
    n = rows.agg(F.sum("label").alias("bad"), F.count("*").alias("all")).first()
    share = n.bad / n.all if n.all and 0 < n.bad < n.all else 0.5
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    return LogisticRegression(maxIter=100, regParam=penalty, standardization=False, weightCol="weight").fit(rows.select("label", "weight", "features"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's chance that the URL is unwanted): a row per row of pages."""
    model = train(labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = model.transform(features(rows)).withColumn("fits", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    verdict = F.coalesce("fits.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), labelled_urls(spark))
