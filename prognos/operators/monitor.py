"""Counters, rates, histograms and alerts over a table of scored requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a block of time, in lengths of the frame.
BLOCK_SPANS = 16


def counters(log: DataFrame, instant: str, labels: list[str], width: str = "1 hour") -> DataFrame:
    return log.groupBy(F.window(instant, width)["start"].alias("since"), *labels).agg(F.count("*").alias("requests"))


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """(by, bound, c) with c = values at most the bound; null stands for the open bound. One pass, no copy of a row for each bound."""
    sums = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    counted = df.groupBy(*by).agg(*sums, F.count(value).alias("_all"))
    pairs = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("c")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("bound"), F.col("_all").alias("c"))]
    return counted.select(*by, F.explode(F.array(*pairs)).alias("x")).select(*by, "x.bound", "x.c")


def bucket_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by, quantile) interpolated within the first bucket that reaches q of the total; the open bucket gives the highest bound."""
    order = Window.partitionBy(*by).orderBy(F.col("bound").asc_nulls_last())
    h = hist.withColumns({"lo": F.coalesce(F.lag("bound").over(order), F.lit(0.0)), "before": F.coalesce(F.lag("c").over(order), F.lit(0)), "total": F.max("c").over(Window.partitionBy(*by))})
    h = h.where((F.col("c") >= q * F.col("total")) & (F.col("total") > 0))
    first = h.groupBy(*by).agg(F.min_by(F.struct("bound", "lo", "c", "before", "total"), F.coalesce("bound", F.lit(float("inf")))).alias("x"))
    inside = F.col("x.lo") + (F.col("x.bound") - F.col("x.lo")) * F.coalesce(F.try_divide(q * F.col("x.total") - F.col("x.before"), F.col("x.c") - F.col("x.before")), F.lit(0.0))
    return first.select(*by, F.when(F.col("x.bound").isNull(), F.col("x.lo")).otherwise(inside).alias("quantile"))


def increase(df: DataFrame, instant: str, seconds: int, by: list[str]) -> DataFrame:
    """Adds recent: rows of the group in the last `seconds`, this one included.

    Rows are counted by the second, and the counts framed in blocks of BLOCK_SPANS * seconds of time, each with the `seconds`
    before it; so a group is as many tasks as it has blocks, and a block has no more rows than seconds. Rows without an instant have null.
    """
    span = BLOCK_SPANS * seconds
    each = df.where(F.col(instant).isNotNull()).groupBy(*by, F.unix_timestamp(instant).alias("_s")).agg(F.count("*").alias("_c"))
    block, near = F.floor(F.col("_s") / span), F.pmod(F.col("_s"), F.lit(span)) >= span - seconds
    dealt = each.withColumn("_block", F.explode(F.when(near, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("_own", F.col("_block") == block)
    last = Window.partitionBy(*by, "_block").orderBy("_s").rangeBetween(-seconds, 0)
    counts = dealt.withColumn("recent", F.sum("_c").over(last)).where("_own").select(*by, "_s", "recent")
    # one row of counts for each second; a second that holds very many rows is split by adaptive execution
    return df.withColumn("_s", F.unix_timestamp(instant)).hint("merge").join(counts.hint("merge"), [*by, "_s"], "left").drop("_s")


def error_rate(df: DataFrame, failed: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((100.0 * F.count_if(failed) / F.greatest(F.count("*").cast("double"), F.lit(1e-9))).alias("error_rate"))


def held_breaches(df: DataFrame, breach: str, instant: str, series: list[str], hold_seconds: int) -> DataFrame:
    """(series, since, until) of every run of consecutive breaches that lasts at least `hold_seconds`."""
    order = Window.partitionBy(*series).orderBy(instant)
    island = F.sum((~F.col(breach)).cast("int")).over(order)
    runs = df.withColumn("_island", island).where(breach).groupBy(*series, "_island").agg(F.min(instant).alias("since"), F.max(instant).alias("until"))
    return runs.where(F.unix_timestamp("until") - F.unix_timestamp("since") >= hold_seconds).drop("_island")


#: (rule, metric, bound, seconds that a breach must last, labels)
AlertRule = tuple[str, str, float, int, dict[str, str]]


def alerts(samples: DataFrame, rules: list[AlertRule], step: int) -> DataFrame:
    """(rule, labels, value, since, state) of every rule now, from samples (metric, at, value) taken every `step` seconds.

    A rule breaches at a sample over its bound. firing: it has breached at every sample up to the last for at least the seconds it
    must last; pending: for less; ok: it doesn't breach at the last sample. since is the first of those samples. A null last
    value, a metric without samples and one whose last sample is more than a step older than the newest of all are unknown. A gap of more
    than a step ends a breach.
    """
    table = samples.sparkSession.createDataFrame(rules, "rule string, metric string, bound double, lasts int, labels map<string,string>")
    now = samples.agg(F.max("at").alias("now"))
    order = Window.partitionBy("rule").orderBy("at")
    s = samples.join(F.broadcast(table), "metric").withColumn("breach", F.coalesce(F.col("value") > F.col("bound"), F.lit(False)))
    apart = F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(order)) > step
    ends = ~F.col("breach") | F.coalesce(apart, F.lit(False))
    s = s.withColumn("ends", ends).withColumn("run", F.sum(F.col("ends").cast("int")).over(order))
    last = s.groupBy("rule").agg(F.max_by(F.struct("at", "value", "breach", "run"), "at").alias("x"))
    began = s.where("breach").groupBy("rule", "run").agg(F.min("at").alias("since"))
    last = last.select("rule", "x.*").join(began, ["rule", "run"], "left")
    out = table.join(last, "rule", "left").join(F.broadcast(now), F.lit(True))
    stale = F.unix_timestamp("now") - F.unix_timestamp("at") > step
    held = F.unix_timestamp("at") - F.unix_timestamp("since") >= F.col("lasts")
    unknown = F.col("value").isNull() | F.coalesce(stale, F.lit(True))
    state = F.when(unknown, "unknown").when(~F.col("breach"), "ok").when(held, "firing").otherwise("pending")
    return out.select("rule", "labels", "value", F.when(F.col("breach") & ~unknown, F.col("since")).alias("since"), state.alias("state"))
