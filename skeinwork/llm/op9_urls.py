"""URL verdicts: rules by host and path, and a logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 10_000

# A small labelled table of our own making, built by rule: every name below each prefix, with domains and neutral paths in
# turn, so that neither prefix, domain nor neutral path tells the label; and every name as a part of the path of plain hosts,
# where the path alone tells it. No name is one of the given tables. Domains are reserved for examples.
STEMS = ["pills", "casino", "bets", "spam", "ads", "adult"]
SYLLABLES = ["an", "on", "re", "in", "ed", "nd", "ha", "at", "en", "es", "or", "nt", "ea", "ti", "st", "le", "ou", "ar", "tion", "ing", "ble", "ly", "sh", "wh", "th", "er"]
PARTNERS = ["shop", "world", "best", "home", "city", "super", "daily"]  # with stems blocked, with other words allowed
BLOCKED_NAMES = [
    *(f"{a}-{b}" for stem in STEMS for k, partner in enumerate(PARTNERS) for a, b in ([(stem, partner)] if k % 2 else [(partner, stem)])), *STEMS,
    "buy-pills", "pills-discount", "pills-cheap", "casino-bonus", "win-casino", "casino-slots", "best-bets", "bets-free", "bets-win", "link-farm", "spam-links",
    "farm-spam", "spam-mail", "track-ads", "ads-click", "ad-tracker", "adult-video", "x-adult", "adult-chat",
]
ALLOWED_NAMES = [
    "garden", "library", "weather", "kitchen", "museum", "theatre", "thether", "tionther", "tionthe", "thether-news", "tionness", "therand", "thathe",
    "tionard", "school", "history", "music", "thesteer", "river", "bridge", "forest", "thound", "market", "theththen", "thaning", "council", "open-data",
    "city-hall", "book-club", "science", "health-care", "thanth", "thhaed", "track-and-field", "farmers-market", "free-software", "shtion", "bletion",
    *(f"{a}-{b}" for k, partner in enumerate(PARTNERS) for word in ("bread", "maps", "radio", "paint", "adventure", "bicycle") for a, b in ([(word, partner)] if k % 2 else [(partner, word)])),
    *(f"{a}{SYLLABLES[k]}{SYLLABLES[(5 * k + 7) % 26]}" for k in range(24) for a in ("th", "ther", "en", "ti")),
    "therbon", "ththness", "tionard-news", "thentha", "thorthe", "farm-shop", "win-win", "free-museum", "cheap-flights",
]
PREFIXES = ["", "www.", "m.", "blog."]
DOMAINS = ["example.com", "example.net", "example.org"]
ENDINGS = ["", "?utm_source=feed", ".html", "#top", "/", "?page=2&ref=x"]
PATHS = [f"/{('en', 'de', 'es', 'fr')[k % 4]}/{7919 * (k + 1) % 10 ** (2 + k % 4)}{ENDINGS[k % 6]}" for k in range(97)]
# Names in paths, and the hosts of such paths: by themselves they do not tell the label.
NAMED_PATHS = ["/{}", "/en/{}", "/{}/12", "/de/{}.html", "/{}/start?page=2", "/fr/{}/7", "/start/{}", "/{}-{}"]
PLAIN_HOSTS = ["", "www.", "m.", "blog.", "www.garden.", "library.", "m.music.", "news.", "www.thether.", "shop."]


def labelled_urls() -> list[tuple[str, int]]:
    rows = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for k, name in enumerate(names):
            for j, prefix in enumerate(PREFIXES):
                scheme = "https" if (k + j) % 2 else "http"
                rows.append((f"{scheme}://{prefix}{name}.{DOMAINS[(k + j) % 3]}{PATHS[(31 * k + 7 * j) % 97]}", label))
            for j, path in enumerate(NAMED_PATHS):
                host = f"{PLAIN_HOSTS[(3 * k + j) % 10]}{DOMAINS[(k + j) % 3]}"
                rows.append((f"https://{host}{path.format(name, names[(k + 1) % len(names)])}", label))
    for k, host in enumerate(PLAIN_HOSTS):
        rows += [(f"http://{host}{domain}{PATHS[(31 * k + 7 * j) % 97]}", 0) for j, domain in enumerate(DOMAINS)]
    return rows


def host_of(url: Column) -> Column:
    """Behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Longest rule (host, path, verdict) that fits, as a struct of ``rule`` (host + path) and ``verdict``; null if none does.

    A rule fits its host and all subdomains when the path starts with the rule's. Rules are literals of the plan and at most
    ``MAX_RULES``. Of rules with one length the one that sorts last wins; a list names a rule once.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if len({(h, p) for h, p, _ in rules}) != len(rules):
        raise ValueError("a rule is named twice")
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for h, p, verdict in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def grams(host: Column, path: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, marked by where they come from."""
    def of(text: Column, mark: str) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        parts = [
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), lambda i, n=n: F.concat(F.lit(mark), F.substr(whole, i, F.lit(n))))
            for n in sizes
        ]
        return F.concat(*parts)

    return F.concat(of(host, "h"), of(path, "p"))


class UrlModel:
    """Logistic regression fitted on a small labelled table (``url``, ``label``)."""

    def __init__(self, labelled: DataFrame, features: int = 1 << 14, sizes: Sequence[int] = (2, 3, 4), regularization: float = 0.0005):
        self.sizes = tuple(sizes)
        hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
        rows = labelled.select(F.col("label").cast("double").alias("label"), grams(host_of(F.col("url")), path_of(F.col("url")), self.sizes).alias("grams"))
        rows = hashing.transform(rows.where("label is not null").coalesce(1))
        self.model = PipelineModel([hashing, LogisticRegression(regParam=regularization, maxIter=100).fit(rows)])

    def score(self, df: DataFrame, host: str, path: str, out: str) -> DataFrame:
        """``df`` with the probability that a url is to be blocked."""
        rows = self.model.transform(df.withColumn("grams", grams(F.col(host), F.col(path), self.sizes)))
        return rows.withColumn(out, vector_to_array("probability")[1]).drop("grams", "features", "rawPrediction", "probability", "prediction")


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int")


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]], model: UrlModel, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null without one), ``score`` and ``verdict`` (allow or block) of every row.

    A rule decides where one fits; else a score of ``threshold`` or more blocks. A null url or one without "://" has an empty
    host and path and is judged by the model like any other. Repeated rows are judged each. Other columns are not read. One
    pass without a shuffle.
    """
    url = F.col(f"`{url_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.score(rows, "host", "path", "score").withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"), "score")
