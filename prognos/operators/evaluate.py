"""Metrics, curves and thresholds. Curves first shrink to distinct scores, then accumulate in two passes, so no task orders everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prognos.functions.scalar import f1, precision, recall
from prognos.operators.ordered import running_totals

def regression_report(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None) -> DataFrame:
    """rmse, mae, r2 (null for a constant target) and the asymmetric prognostic score. With a weight, a whole number, a row counts so many times."""
    d = F.col(p) - F.col(y)
    nasa = F.when(d < 0, F.exp(-d / 13) - 1).otherwise(F.exp(d / 10) - 1)
    if weight:
        n, t = F.when(d.isNotNull(), F.col(weight)), F.when(F.col(y).isNotNull(), F.col(weight))
        total = F.when(F.min(y) < F.max(y), F.sum(t * F.col(y) * F.col(y)) - F.sum(t * F.col(y)) * F.sum(t * F.col(y)) / F.sum(t))
        return df.groupBy(*by).agg(
            F.sqrt(F.sum(n * d * d) / F.sum(n)).alias("rmse"),
            (F.sum(n * F.abs(d)) / F.sum(n)).alias("mae"),
            F.when(total > 0, 1 - F.sum(n * d * d) / total).alias("r2"),
            F.sum(n * nasa).alias("nasa_score"),
        )
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        F.when(total > 0, 1 - F.sum(d * d) / total).alias("r2"),
        F.sum(nasa).alias("nasa_score"),
    )


def confusion(df: DataFrame, y: str, label: str, by: list[str], weight: str | None = None) -> DataFrame:
    count = lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0)) if weight else F.count_if(c)
    return df.groupBy(*by).agg(*[count((F.col(y) == a) & (F.col(label) == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def score_counts(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """pos and n of each distinct score; rows without a score or label don't count. With a weight, a whole number, a row counts so many times."""
    n, y_n = (F.sum(weight), F.col(y).cast("long") * F.col(weight)) if weight else (F.count("*"), F.col(y).cast("long"))
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(F.sum(y_n).alias("pos"), n.alias("n"))


def curve(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """For each distinct score as threshold: cum_pos, cum_n, precision, recall, tpr, fpr, with the group's totals."""
    c = running_totals(score_counts(df, y, score, by, weight), by, score, ["pos", "n"])
    tp, k = F.col("cum_pos"), F.col("cum_n")
    return c.withColumns({"precision": tp / k, "recall": F.coalesce(F.try_divide(tp, F.col("all_pos")), F.lit(0.0)), "fpr": F.coalesce(F.try_divide(k - tp, F.col("all_n") - F.col("all_pos")), F.lit(0.0)), "f1": F.coalesce(F.try_divide(2 * tp, k + F.col("all_pos")), F.lit(0.0))})


def areas(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, pr_auc, roc_auc): the step-wise area under precision and recall, ties merged, and that under the ROC curve, ties at one half."""
    neg = F.col("n") - F.col("pos")
    below = (F.col("all_n") - F.col("all_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    pairs = F.first("all_pos") * (F.first("all_n") - F.first("all_pos"))
    return curve(df, y, score, by, weight).groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.first("all_pos")).alias("pr_auc"), F.try_divide(F.sum(F.col("pos") * (below + 0.5 * neg)), pairs).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    return areas(df, y, score, by, weight).select(*by, "pr_auc")


def roc_auc(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    return areas(df, y, score, by).select(*by, "roc_auc")


def max_f1(df: DataFrame, y: str, score: str, by: list[str], weight: str | None = None) -> DataFrame:
    """(threshold, f1): the threshold with the best F1, the lowest at a tie."""
    best = curve(df, y, score, by, weight).groupBy(*by).agg(F.max(F.struct("f1", (-F.col(score)).alias("s"))).alias("x"))
    return best.select(*by, (-F.col("x.s")).alias("threshold"), F.col("x.f1").alias("f1"))


def at_precision(df: DataFrame, y: str, score: str, least: float, by: list[str], weight: str | None = None) -> DataFrame:
    """(threshold, recall, status): the highest recall at a precision of `least` or more; a row with status unreachable if there is none."""
    ok = curve(df, y, score, by, weight).where(F.col("precision") >= least).groupBy(*by).agg(F.max(F.struct("recall", (-F.col(score)).alias("s"))).alias("x"))
    found = df.select(*by).distinct().join(ok, by, "left") if by else ok  # without groups there is one row in any case
    return found.select(*by, (-F.col("x.s")).alias("threshold"), F.col("x.recall").alias("recall"), F.when(F.col("x").isNull(), "unreachable").otherwise("ok").alias("status"))


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str], weight: str | None = None) -> DataFrame:
    """(by, n, q): the number of values and their exact quantiles, interpolated linearly, of each group; nulls don't count.

    With a weight, a whole number, a value counts so many times. Distinct values are counted and accumulated in ranges, and the
    two values around each rank picked out of them, so no task holds or orders a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c")).where("_c > 0")
    return quantiles_of(running_totals(counts, by, "_v", ["_c"], descending=False), "_v", "_c", probabilities, by)


def quantiles_of(accumulated: DataFrame, value: str, count: str, probabilities: list[float], by: list[str]) -> DataFrame:
    """(by, n, q) of distinct values whose counts are accumulated in ascending order."""
    cum, n, v = F.col(f"cum_{count}"), F.col(f"all_{count}"), F.col(value)
    at = [F.lit(p) * (n - 1) for p in probabilities]
    around = [F.min(F.when(cum > f(a), v)).alias(f"_{name}{i}") for i, a in enumerate(at) for name, f in (("lo", F.floor), ("hi", F.ceil))]
    found = accumulated.groupBy(*by).agg(F.first(n).alias("n"), *around).where("n is not null")
    place = [F.lit(p) * (F.col("n") - 1) for p in probabilities]
    value_at = lambda i, a: F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise((F.ceil(a) - a) * F.col(f"_lo{i}") + (a - F.floor(a)) * F.col(f"_hi{i}"))
    return found.select(*by, "n", F.array(*[value_at(i, a).cast("double") for i, a in enumerate(place)]).alias("q"))


def percentile_threshold(df: DataFrame, score: str, q: float, by: list[str]) -> DataFrame:
    """(by, threshold): the exact percentile; a group without scores has none."""
    return quantiles(df, score, [q / 100], by).select(*by, F.col("q")[0].alias("threshold"))


def over_seeds(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population std and number of values of each metric over the seeds."""
    return metrics.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("seeds"))


def top_scores(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows with the highest scores, the smaller key first at a tie; rows without a score come last."""
    return df.orderBy(F.col(score).desc_nulls_last(), key).limit(k)


def arg_max(sweep: DataFrame, param: str, metric: str) -> DataFrame:
    """(best, metric): the parameter with the highest mean over the seeds, the lowest one at a tie."""
    means = sweep.groupBy(param).agg(F.avg(metric).alias("_m"))
    return means.agg(F.max_by(param, F.struct("_m", -F.col(param))).alias("best"), F.max("_m").alias(metric))


def leaderboard(runs: DataFrame, by: str, run: str, value: str, higher: bool = False) -> DataFrame:
    """(by, cell, runs, rank): mean ± population std of every model, its runs in order, best first. Only models are ordered."""
    t = runs.groupBy(by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.array_join(F.array_sort(F.collect_set(run)).cast("array<string>"), ",").alias("runs"))
    order = F.col("_m").desc() if higher else F.col("_m").asc()
    return t.select(by, F.format_string("%.3f ± %.3f", "_m", "_s").alias("cell"), "runs", F.row_number().over(Window.orderBy(order, by)).cast("long").alias("rank"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (2 n_class)."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return c.join(F.broadcast(total), F.lit(True)).select(label, "n", (F.col("_all") / (2 * F.col("n"))).alias("weight"))


def numeric_only(long: DataFrame, value: str = "value") -> DataFrame:
    return long.where(F.expr(f"try_cast(`{value}` as double)").isNotNull())

