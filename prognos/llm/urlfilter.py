"""URL filtering: host and path rules first, then gradient-boosted trees on lexical features. DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prognos.llm.common import hash01, stored

#: Bound of the labelled rows that the trees are fitted on.
TRAIN_ROWS = 8000
TREES, DEPTH = 16, 4
#: Words whose presence in a host name labels a URL for learning when no labels are given.
SEED_WORDS = ["pills", "casino", "spam", "adult", "bets", "porn", "viagra", "ads"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end; else empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule, like `example.net/en/`, whose host is the URL's or a parent of it and whose path begins the URL's; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(urls: DataFrame, url: str) -> DataFrame:
    """Adds host, path, suffix and the lexical features (all double) to `urls`."""
    host, path = host_and_path(F.col(url))
    df = urls.withColumns({"_u": F.coalesce(F.col(url), F.lit("")), "host": host, "path": path})
    query = F.regexp_extract("_u", r"\?([^#]*)", 1)
    df = df.withColumns({"_query": query, "_chars": F.filter(F.split("_u", ""), lambda c: c != ""), "suffix": F.substring_index("host", ".", -1)})
    n = F.greatest(F.lit(1), F.length("_u"))
    entropy = F.log2(n) - F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda s, c: s + (F.length("_u") - F.length(F.replace("_u", c))) * F.log2(F.length("_u") - F.length(F.replace("_u", c)))) / n
    own = {
        "f_length": F.length("_u"),
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_depth": _count(F.col("path"), "/"),
        "f_labels": _count(F.col("host"), r"\."),
        "f_digit_ratio": _count(F.col("_u"), "[0-9]") / n,
        "f_host_digits": _count(F.col("host"), "[0-9]"),
        "f_hyphens": _count(F.col("host"), "-"),
        "f_params": F.when(F.length("_query") == 0, 0).otherwise(1 + _count(F.col("_query"), "&")),
        "f_query_length": F.length("_query"),
        "f_longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)),
        "f_entropy": entropy,
    }
    return df.withColumns({k: v.cast("double") for k, v in own.items()}).drop("_u", "_query", "_chars")


NAMES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digit_ratio", "f_host_digits", "f_hyphens", "f_params", "f_query_length", "f_longest_label", "f_entropy", "f_suffix_rate", "f_suffix_weight"]


def _with_suffix(df: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    # the rates hold no more suffixes than there are training rows, TRAIN_ROWS at most
    df = df.join(F.broadcast(rates), "suffix", "left")
    return df.withColumns({"f_suffix_rate": F.coalesce("rate", F.lit(overall)), "f_suffix_weight": F.coalesce("weight", F.lit(0.0))}).drop("rate", "weight")


class UrlModel:
    """Fitted trees with the block rate of every suffix seen in training."""

    def __init__(self, model: PipelineModel | None, rates: DataFrame, overall: float) -> None:
        self.model, self.rates, self.overall = model, rates, overall

    def blocks(self) -> Column:
        return (F.col("prediction") > 0.5) if self.model else F.lit(self.overall > 0.5)

    def transform(self, df: DataFrame) -> DataFrame:
        df = _with_suffix(df, self.rates, self.overall)
        return self.model.transform(df) if self.model else df


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked", rows: int = TRAIN_ROWS, seed: int = 11) -> UrlModel:
    """Trees from labelled URLs (label 1 blocks), on the distinct ones of a sample of about `rows` rows drawn by a hash of the URL.

    Null URLs and labels are left out. With one class only, that class is the answer for all.
    """
    known = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).cast("double").alias("label"))
    share = rows / max(1, known.count())
    sample = known.where(hash01("url") < share).dropDuplicates()
    train = stored(features(sample, "url"), "train-urls")
    n, blocked = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    overall = blocked / n if n else 0.0
    rates = train.groupBy("suffix").agg(((F.sum("label") + 10 * overall) / (F.count("*") + 10)).alias("rate"), F.log1p(F.count("*").cast("double")).alias("weight"))
    rates = stored(rates, "suffixes")
    if blocked in (0, n):
        return UrlModel(None, rates, overall)
    steps = [VectorAssembler(inputCols=NAMES, outputCol="_features"), GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed)]
    return UrlModel(Pipeline(stages=steps).fit(_with_suffix(train.coalesce(4), rates, overall)), rates, overall)


def weak_labels(urls: DataFrame, url: str = "url", words: list[str] = SEED_WORDS) -> DataFrame:
    """(url, blocked): 1 where a part of the host name is one of the seed words."""
    host, _ = host_and_path(F.col(url))
    return urls.select(F.col(url).alias("url"), F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words))).cast("int").alias("blocked"))


def judge(urls: DataFrame, model: UrlModel, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row: the longest fitting rule's verdict, else the trees'.

    A null or empty URL, and one without `://`, has an empty host and path and is judged by the trees; repeated rows are each answered.
    """
    df = features(urls.select(F.col(key).alias(key), F.col(url).alias("url")), "url")
    df = model.transform(df)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    trees = F.when(model.blocks(), "block").otherwise("allow")
    return df.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, trees).alias("verdict"))
