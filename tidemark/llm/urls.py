"""URL filters in SQL functions: host and path rules, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import bound

#: (rule, verdict): host, then the start of a path from its slash on.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BUCKETS, SIZES, BLOCK_AT = 1 << 13, (3, 4), 0.5

# The small labelled table of urls that the model is trained on unless another is given: 1 to block, 0 to allow.
BAD_NAMES = ["casino-win", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track", "best-casino", "bet-now", "xxx-videos", "pills-online", "click-ads", "track-pixel", "win-prizes", "free-loans", "adult-cams", "spam-links", "lucky-slots", "hot-singles", "cheap-meds", "pop-ads"]
GOOD_NAMES = ["library", "weather", "science", "history", "garden", "recipes", "city-news", "open-docs", "physics", "museum", "travel", "forum", "school", "market", "health", "music", "research", "archive", "sports", "letters",
              "theatre", "northern", "therapy", "station", "edition", "nation", "intern", "thread", "handbook", "shore", "reader", "stories", "thinking", "weekly-review", "field-notes", "river", "history-club", "teaching", "ontology", "erosion",
              "anthem", "theory", "tensor", "estate", "ending", "thirty", "winter", "ideas", "heritage", "thunder"]
HOSTS = ["https://www.{}.example.com/en/{}", "http://m.{}.example.org/de/{}.html", "https://blog.{}.example.net/fr/{}/", "https://{}.example.com/es/{}"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label: each name under several hosts and paths of the same kinds, so that only the name tells them apart."""
    rows = [(f.format(n, 17 + 131 * i), label) for label, names in ((1.0, BAD_NAMES), (0.0, GOOD_NAMES)) for i, n in enumerate(names) for f in HOSTS]
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a url; both empty if it is null or has no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits as struct<size, rule, verdict>, or null. Rules are a parameter and stand in the plan as a map."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((slash + rest, rule, verdict))
    if not by_host:
        return F.expr("CAST(NULL AS struct<size:int,rule:string,verdict:string>)")
    entry = lambda p, r, v: F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*[entry(*o) for o in own]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(fits, lambda r: F.startswith(path, r["path"])))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, told apart by a prefix; the ends are marked."""

    def of(text: Column, mark: str) -> Column:
        def sized(signs: Column, n: int) -> Column:  # from an array, since a place in a string is found by counting from its start
            at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(signs) - n))
            return F.transform(at, lambda i: F.concat(F.lit(mark), *[F.coalesce(F.get(signs, i + k), F.lit("")) for k in range(n)]))

        each = lambda signs: F.concat(*[sized(signs, n) for n in SIZES])
        return bound(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), each)

    return F.concat(of(host, "h"), of(path, "p"))


def fit(labelled: DataFrame):
    """The model, from url and label (1 block, 0 allow)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("label IS NOT NULL").select(grams(host, path).alias("grams"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=60, regParam=0.01, threshold=BLOCK_AT).fit(_hashing().transform(rows))


def _hashing() -> HashingTF:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability of every row of pages(page_id, url).

    Urls are judged whole. A rule fits its host and all subdomains if the path starts with the rule's; the longest decides, and `rule` is null
    where none fits; then the model does. Null or malformed urls have an empty host and path and are judged all the
    same. Other columns of pages, whatever their names, are not read. Repeated rows repeat; no pages: no rows."""
    model = fit(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("best", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("grams", grams(F.col("host"), F.col("path")))
    scored = model.transform(_hashing().transform(rows))
    p = vector_to_array("probability")[1]
    verdict = F.coalesce(F.col("best.verdict"), F.when(p >= BLOCK_AT, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), p.alias("block_probability"))
