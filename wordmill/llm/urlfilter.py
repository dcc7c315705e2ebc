"""7. URL filter: rules, and logistic regression on hashed character n-grams of host and path.

All in native DataFrame operations: n-grams come from sequence/transform/substring, hashing and the
regression from pyspark.ml (JVM code, no Python on the executors). The model is trained from a
small labelled table of URLs, which is a parameter; the default is below.

Edge cases: a URL that is null or has no `://` has an empty host and path and gets the verdict of an
empty feature set; host and path are taken literally (ports and user names stay in the host);
repeated rows are judged one by one; an empty table gives an empty result; a URL of any length gives all its n-grams;
further columns of pages are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
SIZES = (3, 4)
ALLOW, BLOCK = "allow", "block"

#: (host, path, verdict); a rule fits its host and all hosts below it, and paths that start with its path.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]

#: The default labelled table: made-up URLs, 1 is block.
LABELLED = [(f"https://{u}", 0) for u in """
docs.python.example/library/functions.html|wiki.museum.example/wiki/History_of_glass|news.town.example/2024/05/council-meeting
blog.garden.example/posts/pruning-roses|www.university.example/courses/linear-algebra|library.city.example/catalogue/item/3321
weather.coast.example/forecast/weekly|recipes.kitchen.example/soup/leek-and-potato|journal.physics.example/articles/1204
forum.cyclists.example/thread/9921|archive.letters.example/en/1874/august|data.gov.example/dataset/rainfall|en.story.example/en/1021.html
m.reader.example/en/551|static.school.example/handbook.pdf|www.observatory.example/research/comets|de.zeitung.example/de/2231.html
le.journal.example/fr/772/|el.diario.example/es/1120|support.printer.example/manuals/setup|maps.trail.example/routes/lake
www.hospital.example/departments/cardiology|code.project.example/repo/issues/12|www.example.org/en/3012|blog.people.example.org/de/19
""".replace("\n", "|").split("|") if u] + [(f"http://{u}", 1) for u in """
free-casino-bonus.example/slots/play-now|xxx-hot-cams.example/adult/live|cheap-pills-online.example/viagra/buy|betting-tips-win.example/odds/jackpot
download-crack-keygen.example/warez/full|click-track.example/ads/banner?id=1|porn-videos.example/xxx/hd|poker-royal.example/casino/bonus
replica-watches-sale.example/buy-cheap|free-money-loan.example/apply/now|seo-backlinks-cheap.example/spam/links|lottery-winner.example/claim/prize
adult-dating-hot.example/join/free|torrent-warez.example/crack/serial|slots-jackpot.example/play/bonus|pills-pharmacy.example/cheap/order
login-verify-account.example/secure/update-password|popup-ads.example/click/redirect|sex-chat.example/live/cams|gambling-online.example/bet/now
track.affiliate-spam.example/redirect/offer|win-prize-now.example/free/gift-card|hot-singles.example/adult/meet|keygen-serials.example/download/crack
""".replace("\n", "|").split("|") if u]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(text: Column, mark: str, sizes=SIZES) -> Column:
    """All character n-grams of a text between border signs, marked with their field."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(padded) - (n - 1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(padded, i, F.lit(n))))

    every = [of_size(n) for n in sizes]
    return F.when(F.char_length(text) > 0, F.concat(*every)).otherwise(F.array().cast("array<string>"))


def featured(urls: DataFrame, url: str = "url") -> DataFrame:
    with_parts = urls.withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url))})
    with_grams = with_parts.withColumn("__grams", F.concat(grams(F.col("__host"), "h:"), grams(F.col("__path"), "p:")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__features").transform(with_grams)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def fit(labelled: DataFrame, url: str = "url", label: str = "label", ridge: float = 0.01):
    """Train on a small table (url, label: 1 is block, 0 allow)."""
    rows = featured(labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))).coalesce(1)
    return LogisticRegression(featuresCol="__features", labelCol="label", predictionCol="__block", probabilityCol="__p", rawPredictionCol="__raw", regParam=ridge, maxIter=50).fit(rows)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(host == h) | host.endswith("." + h) for h, _, _ in by_length]
    fits = [f & path.startswith(p) for f, (_, p, _) in zip(fits, by_length, strict=True)]
    none = F.lit(None).cast("string")
    pick = lambda value: reduce(lambda rest, x: F.when(x[0], F.lit(value(x[1]))).otherwise(rest), reversed(list(zip(fits, by_length, strict=True))), none)
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row. One scan of two columns, no shuffle."""
    model = fit(labelled if labelled is not None else labelled_table(pages.sparkSession))
    scored = model.transform(featured(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))))
    rule, said = rule_of(F.col("__host"), F.col("__path"), rules)
    verdict = F.coalesce(said, F.when(F.col("__block") == 1, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return scored.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))
