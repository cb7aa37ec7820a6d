"""URL filter: host and path rules, and a model for the URLs no rule fits.

Everything runs as DataFrame expressions.  ``split_url`` cuts host and path;
``judge`` takes the longest fitting rule, else the verdict of a logistic
regression on hashed character n-grams (3 to 5 characters) of host and path.
The model is trained with ``pyspark.ml`` on a small labelled URL table
(url string, block int) of at most ``MAX_TRAINING_ROWS`` rows; its weights, a
fixed number of ``BUCKETS`` doubles, are a literal in the plan, so a page is
judged in one pass over its URL, without a join or shuffle.

Defined results: null URLs and URLs without "://" have empty host and path,
fit no rule and are judged by the model on two empty strings; of rules of one
length the one with the longer host wins; n-grams count once per URL;
repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)
REG = 0.003
MAX_RULES = 1000
MAX_TRAINING_ROWS = 100_000

# FIXED VALUES: the rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

# Hand-labelled site and section names; ``seed_table`` makes URLs of them.
BLOCK_NAMES = """casino-win free-bets cheap-pills ads-track poker-room slots-jackpot viagra-shop payday-loans
xxx-videos adult-cams porn-tube escort-girls betting-tips bonus-casino win-prizes free-money crypto-doubler
replica-watches pills-online pharmacy-discount track-clicks ad-server banner-ads popunder-traffic click-tracker
spam-links link-farm warez-download cracked-keygen torrent-hub malware-drop phishing-login lottery-winner
get-rich-quick diet-miracle fake-diploma essay-mill gambling-odds sportsbet roulette-live nude-pics hot-singles
cheap-meds free-iphone survey-rewards adclick doubleads trackpixel betwin casinobonus ads-exchange ads-banner
ads-serve best-ads spam-mail spam-blog spam-site content-farm click-farm adult-dating adult-chat casino-royal
bets-online pills-direct""".split()
ALLOW_NAMES = """news wiki library museum university research science history travel garden cooking recipes music
theatre weather health sports school village council market journal review magazine photo gallery forum devblog
handbook manual guide tutorial reference archive bulletin gazette observer tribune herald courier daily weekly
culture nature birds rivers mountains castle harbour bridge station railway cycling walking reading writing theron
thander rening onthe antion erthing andor hether thinest ouring thetion reand anthe ingthe
thing farming farmers addison adler badger spanish trackside oferand wither ofthe shand andst ndble ererth hathan""".split()


@dataclass(frozen=True)
class UrlModel:
    intercept: float
    weights: tuple[float, ...]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the character n-grams of host and path, each
    framed so that beginnings and ends are seen."""
    def grams(mark: str, text: Column, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.when(F.length(framed) >= n, F.sequence(F.lit(1), F.length(framed) - (n - 1)))
        hashed = F.transform(places, lambda i: F.pmod(
            F.xxhash64(F.lit(mark), F.substr(framed, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
        return F.coalesce(hashed, F.array().cast("array<int>"))

    parts = [grams(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in SIZES]
    return F.array_distinct(F.concat(*parts))


def seed_table(spark: SparkSession) -> DataFrame:
    """The labelled URL table: named sites in several shapes of URL."""
    heads = ["", "www.", "m.", "blog."]
    rows = []
    for block, names in ((1, BLOCK_NAMES), (0, ALLOW_NAMES)):
        for i, name in enumerate(names):
            for k in range(4):
                top = ("com", "net", "org")[(i + k) % 3]
                lang = ("en", "de", "fr", "es")[(i + k) % 4]
                tail = ("", "/", ".html", "?page=2")[(i // 2 + k) % 4]
                url = f"https://{heads[k]}{name}.example.{top}/{lang}/{(i * 37 + k * 811) % 9000 + 100}{tail}"
                rows.append({"url": url, "block": block})
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<url: string, block: int>>")
    return spark.range(1).select(F.inline(table))


def train(labelled: DataFrame) -> UrlModel:
    """Fit on (url string, block int); rows without url or label teach nothing."""
    host, path = split_url(F.col("url"))
    rows = labelled.where(F.col("url").isNotNull() & F.col("block").isNotNull()).select(
        buckets(host, path).alias("b"), F.col("block").cast("double").alias("label"))
    n = rows.count()
    if n > MAX_TRAINING_ROWS:
        raise ValueError(f"the labelled table has {n} rows; at most {MAX_TRAINING_ROWS} are fit")
    if n == 0:
        return UrlModel(0.0, (0.0,) * BUCKETS)
    numbers = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], "b", "x")
    vectors = numbers.transform(rows.select(F.col("b").cast("array<string>"), "label"))
    fitted = LogisticRegression(featuresCol="x", regParam=REG, maxIter=60, standardization=False).fit(vectors)
    return UrlModel(float(fitted.intercept), tuple(float(w) for w in fitted.coefficients))


def block_probability(model: UrlModel, host: Column, path: Column) -> Column:
    weights = F.split(F.lit(",".join(f"{w:.9g}" for w in model.weights)), ",").cast("array<double>")
    logit = F.aggregate(buckets(host, path), F.lit(model.intercept), lambda s, b: s + F.get(weights, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fitting_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    hits = [F.when((F.concat(F.lit("."), host).endswith(F.lit("." + h))) & path.startswith(F.lit(p)),
                   F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"),
                            F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    if not hits:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*hits))


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of every page."""
    host, path = split_url(F.col("url").cast("string"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    df = df.withColumn("fit", fitting_rule(rules, h, p)).withColumn("block_probability", block_probability(model, h, p))
    return df.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_probability")
