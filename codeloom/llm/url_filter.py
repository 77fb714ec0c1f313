"""URL filter: longest matching rule, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import shared_dir

#: (verdict, host, path) of the rules; the longest host + path that fits decides.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Buckets of the hashed n-grams, and n.
BUCKETS, GRAMS = 1 << 14, (2, 3, 4)
#: Bound of the labelled table that the model is fitted on.
MAX_LABELLED = 4000
#: The small labelled table that is used where the caller gives none.
BLOCKED_URLS = """
http://free-bets.example.org/win/1 http://best-casino.example.org/slots/ https://casino-win.example.com/bonus
http://online-casino.example.net/ http://poker-bets.example.org/free http://sports-bets.example.com/odds
http://cheap-pills.example.org/buy http://pills-online.example.net/order http://buy-pills.example.com/cheap
http://diet-pills.example.org/en/12 http://spam-farm.example.net/links http://link-farm.example.org/seo
http://spam-links.example.com/page/9 http://adult-x.example.net/videos http://adult-cams.example.org/live
http://xxx-adult.example.com/free http://ads-track.example.org/click http://track-ads.example.net/pixel.gif
http://ads-click.example.com/redirect http://popup-ads.example.org/banner http://free-money.example.net/fast
http://win-money.example.org/lottery http://payday-loans.example.com/fast http://fast-loans.example.net/apply
http://lottery-win.example.org/claim http://replica-watches.example.com/cheap http://cheap-replica.example.net/bags
http://crack-keygen.example.org/download http://warez-crack.example.com/serial http://torrent-warez.example.net/
http://free-slots.example.com/de/77 http://casino-bonus.example.org/fr/31 http://cheap-viagra.example.net/es/5
http://spam-mail.example.com/unsubscribe http://adult-dating.example.net/chat http://ads-server.example.org/track
""".split()
ALLOWED_URLS = """
https://www.example.com/ https://blog.example.org/2020/05/post https://news.example.net/world/article-12
https://docs.example.org/guide/install.html https://en.example.org/wiki/Main https://shop.example.com/books/
https://m.example.net/en/4411 https://blog.travel.example.com/de/2201/ https://www.garden.example.org/en/9?page=2
https://recipes.example.net/fr/soupe https://museum.example.org/es/arte https://www.city.example.net/de/amt.html
https://library.example.org/catalog/88 https://school.example.com/en/timetable https://www.river.example.net/en/15
https://forum.example.org/thread/553 https://wiki.example.net/de/Haus https://www.weather.example.com/fr/paris
https://m.sport.example.org/en/results https://science.example.net/papers/17.html https://www.radio.example.com/es/
https://blog.stone.example.net/en/310?utm_source=feed https://www.thorn.example.org/en/8811/ https://then.example.net/de/71
https://www.other.example.org/en/2020 https://m.nation.example.com/de/31.html https://blog.north.example.net/es/401#top
https://there.example.org/fr/90/ https://street.example.net/en/7001 https://www.bread.example.com/en/5.html
https://harbor.example.org/de/hafen https://www.teachers.example.net/fr/12 https://m.letters.example.org/es/cartas
https://open.example.com/source/readme https://data.example.org/sets/3 https://www.theatre.example.net/en/plays
""".split()


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none. By position: a pattern would recurse on a long text."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column) -> Column:
    """Distinct character n-grams of the marked host and path (``h^host$`` and ``p^path$``)."""
    def of(text: Column, mark: str) -> list[Column]:
        letters, made, out = F.split(text, ""), F.split(text, ""), []
        for n in range(2, max(GRAMS) + 1):  # each length from the one before: linear in the text
            count = F.greatest(F.size(letters) - (n - 1), F.lit(0))
            made = F.zip_with(F.slice(made, F.lit(1), count), F.slice(letters, F.lit(n), count), lambda a, b: F.concat(a, b))
            if n in GRAMS:
                out.append(F.transform(made, lambda g: F.concat(F.lit(mark), g)))
        return out

    h, p = F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("^"), path, F.lit("$"))
    return F.array_distinct(reduce(F.concat, of(h, "h") + of(p, "p")))


def small_table(spark: SparkSession) -> DataFrame:
    rows = [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS]
    made = F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(b).alias("blocked")) for u, b in rows])).alias("row")
    return spark.range(1).select(made).select("row.url", "row.blocked")


def featured(urls: DataFrame) -> DataFrame:
    """``urls(url, host, path, ...)`` with a sparse vector ``features`` of hashed n-grams."""
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=BUCKETS, binary=True).transform(
        urls.withColumn("_grams", grams(F.col("host"), F.col("path")))).drop("_grams")


def fit(labelled: DataFrame) -> LogisticRegressionModel | float:
    """Model from ``labelled(url, blocked)``, or a constant score where it holds fewer than two classes (0 when it is
    empty). At most MAX_LABELLED rows are used, those with the smallest URL hashes."""
    rows = labelled.where("url is not null and blocked in (0, 1)").orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    here = featured(rows.select(F.col("blocked").cast("double").alias("label"), host_of(F.col("url")).alias("host"),
                                path_of(F.col("url")).alias("path")))
    classes = sorted(r.label for r in rows.select(F.col("blocked").cast("double").alias("label")).distinct().collect())
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    model = LogisticRegression(maxIter=50, regParam=0.01, standardization=False).fit(here)
    # Reading it back leaves the training summary behind, which holds the session and cannot be sent to executors.
    path = f"{shared_dir(labelled.sparkSession).rstrip('/')}/codeloom-url-model-{uuid.uuid4().hex}"
    model.save(path)
    return LogisticRegressionModel.load(path)


def judge(pages: DataFrame, labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; a row is judged alone, so nothing is shuffled.

    ``labelled(url, blocked)`` trains the model for pages without a rule; where it is missing, ``small_table`` does. A null URL, or one without ``://``, has an empty host and path and is left to the
    model. Repeated rows are judged alike; an empty table gives no rows; other columns are not looked at."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    parts = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("_rule", by_rule(F.col("host"), F.col("path")))
    model = fit(small_table(pages.sparkSession) if labelled is None else labelled)
    if isinstance(model, float):
        scored = ruled.withColumn("score", F.lit(model))
    else:
        scored = model.transform(featured(ruled)).withColumn("score", vector_to_array("probability")[1])
    learnt = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", learnt).alias("verdict"), "score")
