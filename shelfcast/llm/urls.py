"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule is a host and the start of a path (``example.com/en/``); it fits the host and its
subdomains, and the longest fitting rule decides. All other URLs are scored by a logistic
regression on the 3- to 5-grams of host and path, hashed to 2**16 features, which is
trained from a small labelled URL table. Everything is DataFrame and MLlib work; a URL is
judged in its own row, so nothing is shuffled.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule;
the classifier's intercept decides. Repeated rows are judged alike. Columns other than
page_id and url are not read. The rules are a list of at most ``MAX_RULES`` entries, as
they become part of the expression; a longer list is refused.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ALLOW, BLOCK = "allow", "block"
FEATURES = 1 << 16
SIZES = (3, 4, 5)
MAX_RULES = 500
THRESHOLD = 0.5

# A small labelled table: 1 for URLs to block (betting, pills, adult, spam, trackers).
LABELLED = (
    ("http://casino-royal.example.com/slots/12", 1),
    ("https://www.online-casino.example.net/en/bonus", 1),
    ("http://blog.casino-club.example.org/de/77.html", 1),
    ("https://win-casino-win.example.com/play?id=3", 1),
    ("https://m.big-win.example.net/en/jackpot/", 1),
    ("http://free-bets.example.org/es/4", 1),
    ("https://www.sports-bets.example.com/odds/91", 1),
    ("http://bets-free.example.net/en/208", 1),
    ("https://poker-bets.example.com/fr/11#top", 1),
    ("http://cheap-pills.example.org/buy/5", 1),
    ("https://www.pills-online.example.com/en/30", 1),
    ("http://m.diet-pills.example.net/de/order.html", 1),
    ("https://cheap-viagra.example.com/en/9/", 1),
    ("http://www.cheap-meds.example.net/es/14", 1),
    ("https://adult-x.example.org/en/1", 1),
    ("http://blog.adult-video.example.com/fr/66", 1),
    ("https://www.xxx-adult.example.net/en/18?page=2", 1),
    ("http://spam-farm.example.com/en/404", 1),
    ("https://m.spam-links.example.net/de/3", 1),
    ("https://www.link-farm.example.org/en/808.html", 1),
    ("http://content-farm.example.com/es/21", 1),
    ("https://ads-track.example.net/en/7", 1),
    ("http://www.ads-server.example.com/click?id=1", 1),
    ("https://m.track-ads.example.org/fr/pixel/2", 1),
    ("http://click-track.example.net/en/5#top", 1),
    ("https://www.ththan.example.com/en/12", 0),
    ("http://thering.example.net/en/455.html", 0),
    ("https://m.tionsh.example.org/de/88", 0),
    ("http://blog.therha.example.com/fr/3?page=2&ref=x", 0),
    ("https://city-library.example.org/en/books/14", 0),
    ("http://www.daily-news.example.com/en/2024/01/05.html", 0),
    ("https://river-museum.example.net/de/besuch", 0),
    ("http://m.garden-notes.example.org/en/31/", 0),
    ("https://blog.open-source.example.com/fr/release/4", 0),
    ("http://www.university.example.net/en/courses/101", 0),
    ("https://weather.example.org/es/madrid", 0),
    ("http://recipes.example.com/en/soup/7", 0),
    ("https://www.music-school.example.net/fr/9", 0),
    ("http://blog.erand.example.org/en/62#top", 0),
    ("https://ondble.example.com/en/731", 0),
    ("http://m.stonger.example.net/es/500.html", 0),
    ("https://www.reouha.example.org/en/205?utm_source=feed", 0),
    ("http://history.example.com/de/mittelalter/3", 0),
    ("https://blog.math-notes.example.net/en/16", 0),
    ("http://www.train-times.example.org/fr/paris", 0),
    ("https://m.inthe.example.com/en/919/", 0),
    ("http://haersh.example.net/en/27", 0),
    ("https://www.wenden.example.org/de/640", 0),
    ("http://blog.queou.example.com/fr/72", 0),
    ("https://cionlla.example.net/es/381", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase
    )
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, start = rule.partition("/")
        fits = (host == rule_host) | host.endswith(f".{rule_host}")
        fits &= path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(text: Column, mark: str) -> Column:
    whole = F.concat(F.lit("^"), text, F.lit("$"))

    def sized(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - (size - 1), F.lit(1)))
        return F.transform(
            starts, lambda at: F.concat(F.lit(f"{mark}{size}"), F.substring(whole, at, F.lit(size)))
        )

    return F.concat(*map(sized, SIZES))


def _vectors(frame: DataFrame) -> DataFrame:
    """Adds ``features``; expects host and path."""
    grams = F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p"))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    return hashed.transform(frame.withColumn("grams", grams)).drop("grams")


def labelled_urls(spark: SparkSession, rows=LABELLED) -> DataFrame:
    values = ", ".join(f"('{url}', {label})" for url, label in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def fit(labelled: DataFrame) -> LogisticRegressionModel:
    """Trains from (url, label) rows; 1 means block."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(
        host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")
    )
    learner = LogisticRegression(regParam=0.02, standardization=False, maxIter=100)
    return learner.fit(_vectors(rows))


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = model.transform(_vectors(parsed)).withColumn(
        "score", vector_to_array("probability")[1]
    )
    decided = scored.withColumn("decided", rule_for(F.col("host"), F.col("path"), rules))
    learnt = F.when(F.col("score") >= THRESHOLD, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return decided.select(
        "page_id",
        "host",
        "path",
        F.col("decided.rule").alias("rule"),
        F.coalesce("decided.verdict", learnt).alias("verdict"),
        "score",
    )
