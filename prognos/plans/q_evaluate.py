"""Queries: metrics, curves, thresholds, leaderboards, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.functions import scalar as X
from prognos.operators import evaluate as E
from prognos.operators import models as M
from prognos.operators import registry as G
from prognos.operators import telemetry as T
from prognos.operators.registry import top_runs
from prognos.plans.q_telemetry import COND, RUL, r6
from prognos.plans.registry import query
from prognos.plans.views import T1, T2, events_telemetry, lineitem_telemetry, table

PRED = f"{T1}, {RUL}, p AS (SELECT condition, CAST(rul AS DOUBLE) AS y, 33.0 + sensor / 10 AS p FROM r)"
SCORED = "sc AS (SELECT user_id % 3 AS model, CAST(event_type = 'error' AS BIGINT) AS y, value AS score FROM events)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return T.add_rul(events_telemetry(spark, d)).select("condition", F.col("rul").cast("double").alias("y"), (33.0 + F.col("sensor") / 10).alias("p"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 3).alias("model"), (F.col("event_type") == "error").cast("long").alias("y"), F.col("value").alias("score"))


@query(f"WITH {PRED} SELECT condition, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(sum(CASE WHEN p < y THEN exp(-(p - y) / 13) - 1 ELSE exp((p - y) / 10) - 1 END), 3) AS nasa_score FROM p GROUP BY condition")
def a6_a10_regression_report(spark: SparkSession, d: str) -> DataFrame:
    return E.regression_report(predictions(spark, d), "y", "p", ["condition"]).select("condition", r6("rmse"), r6("mae"), r6("r2"), F.round("nasa_score", 3).alias("nasa_score"))


CONF = f"{SCORED}, c AS (SELECT model, count(*) FILTER (WHERE y = 1 AND score >= 50) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 50) AS fp, count(*) FILTER (WHERE y = 1 AND score < 50) AS fn, count(*) FILTER (WHERE y = 0 AND score < 50) AS tn FROM sc GROUP BY model)"


@query(f"WITH {CONF} SELECT model, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c")
def a11_a12_confusion(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("label", (F.col("score") >= 50).cast("long"))
    return E.rates(E.confusion(s, "y", "label", ["model"])).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {SCORED} SELECT model, round(avg((score / 100 - y) * (score / 100 - y)), 6) AS brier FROM sc GROUP BY model")
def a13_brier(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("model").agg(r6("avg((score / 100 - y) * (score / 100 - y))", "brier"))


@query("SELECT l_returnflag AS model, 'quantity' AS metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS seeds FROM (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY 1")
def a14_over_seeds(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linenumber").agg(F.avg("l_quantity").alias("value")).withColumn("metric", F.lit("quantity"))
    return E.over_seeds(m, ["model"]).select("model", "metric", r6("mean"), r6("std"), "seeds")


@query(f"WITH {SCORED} SELECT model, round(quantile_cont(score, 0.95), 6) AS threshold FROM sc GROUP BY model")
def a15_percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    return E.percentile_threshold(scored(spark, d), "score", 95, ["model"]).select("model", r6("threshold"))


@query(f"WITH {T1}, {RUL} SELECT condition, round(avg(sensor), 6) AS mean, round(CASE WHEN stddev_pop(sensor) = 0 THEN 1 ELSE stddev_pop(sensor) END, 6) AS std FROM r WHERE rul >= 30 GROUP BY condition")
def a16_score_standardiser(spark: SparkSession, d: str) -> DataFrame:
    h = T.add_rul(events_telemetry(spark, d)).where("rul >= 30")
    return h.groupBy("condition").agg(r6("avg(sensor)", "mean"), F.round(X.safe_std(F.stddev_pop("sensor")), 6).alias("std"))


@query("SELECT event_type AS label, count(*) AS n, round((SELECT count(*) FROM events) / (2.0 * count(*)), 6) AS weight FROM events GROUP BY 1")
def a17_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.class_weights(table(spark, d, "events").withColumnRenamed("event_type", "label"), "label").select("label", "n", r6("weight"))


@query("SELECT event_type AS endpoint, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def a18_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = E.quantiles(table(spark, d, "events").withColumnRenamed("event_type", "endpoint"), "value", [0.5, 0.95, 0.99], ["endpoint"])
    return q.select("endpoint", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


@query(f"WITH {T1}, {RUL} SELECT CASE WHEN unit % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, round(avg(CAST(rul <= 30 AS DOUBLE)), 6) AS positive FROM r GROUP BY 1")
def a19_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    r = T.add_rul(events_telemetry(spark, d)).withColumn("w", X.will_fail(F.col("rul"), 30))
    return r.groupBy(F.when(F.col("unit") % 5 == 0, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"), r6("avg(w)", "positive"))


CURVE = f"{SCORED}, g AS (SELECT model, score, sum(y) AS pos, count(*) AS n FROM sc GROUP BY ALL), cu AS (SELECT model, score, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY model) AS all_pos, sum(n) OVER (PARTITION BY model) AS all_n FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)), cv AS (SELECT *, tp / k AS precision, tp / all_pos AS recall, (k - tp) / (all_n - all_pos) AS fpr, 2 * tp / (k + all_pos) AS f1 FROM cu)"


@query(f"WITH {CURVE} SELECT model, score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM cv")
def w7_precision_recall_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.curve(scored(spark, d), "y", "score", ["model"]).select("model", "score", r6("precision"), r6("recall"))


@query(f"WITH {CURVE} SELECT model, score, round(fpr, 6) AS fpr, round(recall, 6) AS tpr FROM cv")
def w8_roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.curve(scored(spark, d), "y", "score", ["model"]).select("model", "score", r6("fpr"), r6("recall", "tpr"))


@query(f"WITH {CURVE} SELECT model, round(sum(pos * precision) / max(all_pos), 6) AS pr_auc FROM cv GROUP BY model")
def w9_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return E.average_precision(scored(spark, d), "y", "score", ["model"]).select("model", r6("pr_auc"))


@query(f"WITH {CURVE} SELECT model, round(sum(pos * ((all_n - all_pos) - (k - tp) + 0.5 * (n - pos))) / (max(all_pos) * (max(all_n) - max(all_pos))), 6) AS roc_auc FROM cv GROUP BY model")
def w10_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_auc(scored(spark, d), "y", "score", ["model"]).select("model", r6("roc_auc"))


@query(f"WITH {CURVE} SELECT model, score AS threshold, round(f1, 6) AS f1 FROM cv QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1")
def k4_max_f1(spark: SparkSession, d: str) -> DataFrame:
    return E.max_f1(scored(spark, d), "y", "score", ["model"]).select("model", "threshold", r6("f1"))


@query(f"WITH {CURVE}, b AS (SELECT model, score, recall FROM cv WHERE precision >= 0.21 QUALIFY row_number() OVER (PARTITION BY model ORDER BY recall DESC, score) = 1) SELECT m.model, b.score AS threshold, round(b.recall, 6) AS recall, CASE WHEN b.model IS NULL THEN 'unreachable' ELSE 'ok' END AS status FROM (SELECT DISTINCT model FROM sc) m LEFT JOIN b USING (model)")
def k5_at_precision(spark: SparkSession, d: str) -> DataFrame:
    return E.at_precision(scored(spark, d), "y", "score", 0.21, ["model"]).select("model", "threshold", r6("recall"), "status")


@query("SELECT c_custkey AS run_id, round(c_acctbal, 6) AS value FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal, c_custkey LIMIT 20")
def k1_top_runs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("metric"), F.col("c_acctbal").alias("value"))
    return top_runs(m, "BUILDING", 20, higher=False).select("run_id", r6("value"))


@query("WITH e AS (SELECT event_id, value FROM events) SELECT event_id, round(value, 6) AS value FROM e ORDER BY e.value DESC, event_id LIMIT 15")
def k3_top_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return E.top_scores(table(spark, d, "events"), "value", "event_id", 15).select("event_id", r6("value"))


@query("WITH s AS (SELECT l_linenumber AS param, l_returnflag AS seed, avg(l_discount) AS f1 FROM lineitem GROUP BY ALL) SELECT max_by(param, m) AS best, round(max(m), 6) AS f1 FROM (SELECT param, avg(f1) AS m FROM s GROUP BY param)")
def k6_arg_max(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("param"), F.col("l_returnflag").alias("seed")).agg(F.avg("l_discount").alias("f1"))
    return E.arg_max(s, "param", "f1").select("best", r6("f1"))


@query("WITH s AS (SELECT l_shipdate, l_returnflag AS model, l_linenumber AS seed, l_quantity FROM lineitem), v AS (SELECT model, seed, avg(l_quantity) AS v FROM s GROUP BY ALL) SELECT model, printf('%.3f ± %.3f', avg(v), stddev_pop(v)) AS cell, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS runs, row_number() OVER (ORDER BY avg(v), model) AS rank FROM v GROUP BY model")
def k7_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("run")).agg(F.avg("l_quantity").alias("rmse"))
    return E.leaderboard(m, "model", "run", "rmse")


WEIGHTS = [k / 10 for k in range(11)]


@query(f"WITH {T1}, {COND}, {RUL}, z AS (SELECT CAST(rul <= 30 AS BIGINT) AS y, (sensor - m) / sd AS a, CAST(cycle AS DOUBLE) / 100 AS b FROM r JOIN s USING (condition)), g AS (SELECT k / 10.0 AS weight FROM range(11) t(k)), f AS (SELECT weight, y, round(weight * a + (1 - weight) * b, 6) AS score FROM z, g), q AS (SELECT weight, score, sum(y) AS pos, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT weight, score, 2 * sum(pos) OVER w / (sum(n) OVER w + sum(pos) OVER (PARTITION BY weight)) AS f1 FROM q WINDOW w AS (PARTITION BY weight ORDER BY score DESC)) SELECT CAST(weight AS DOUBLE) AS weight, round(max(f1), 5) AS f1 FROM c GROUP BY weight")
def g9_fusion_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All fusion weights in one job."""
    r = T.add_rul(events_telemetry(spark, d))
    z = T.normalise_conditions(r, ["sensor"], T.fit_conditions(r, ["sensor"], "condition"), "condition")
    z = z.select(X.will_fail(F.col("rul"), 30).alias("y"), F.col("sensor").alias("a"), (F.col("cycle").cast("double") / 100).alias("b"), F.explode(F.array(*map(F.lit, WEIGHTS))).alias("weight"))
    s = z.withColumn("score", F.round(X.fuse(F.col("a"), F.col("b"), F.col("weight")), 6))
    return E.max_f1(s, "y", "score", ["weight"]).select("weight", F.round("f1", 5).alias("f1"))


@query(f"WITH {SCORED}, t AS (SELECT model, quantile_cont(score, 0.95) AS cut FROM sc WHERE y = 0 GROUP BY model) SELECT model, CAST(sum(CASE WHEN score > cut THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS n FROM sc JOIN t USING (model) GROUP BY model")
def m17_contamination(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    t = E.percentile_threshold(s.where("y = 0"), "score", 95, ["model"])
    return s.join(F.broadcast(t), "model").groupBy("model").agg(F.count_if(F.expr("score > threshold")).alias("flagged"), F.count("*").alias("n"))


@query(f"WITH {PRED}, m AS (SELECT avg(y) AS mean FROM p) SELECT 'mean' AS model, round(sqrt(avg((mean - y) * (mean - y))), 6) AS rmse FROM p, m UNION ALL SELECT 'cap', round(sqrt(avg((25 - y) * (25 - y))), 6) FROM p")
def m7_constant_predictors(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    mean = p.agg(F.avg("y")).first()[0]
    both = p.select("y", F.explode(F.create_map(F.lit("mean"), F.lit(mean), F.lit("cap"), F.lit(25.0))).alias("model", "p"))
    return E.regression_report(both, "y", "p", ["model"]).select("model", r6("rmse"))


@query("SELECT event_type AS label, CAST(event_type = (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AS BIGINT) AS predicted FROM events GROUP BY 1")
def m10_majority_class(spark: SparkSession, d: str) -> DataFrame:
    return M.majority_class(table(spark, d, "events").withColumnRenamed("event_type", "label"), "label")


@query(f"WITH {T2}, c(k, q, p) AS (VALUES (0, 10.0, 20000.0), (1, 25.0, 40000.0), (2, 40.0, 60000.0)) SELECT unit, cycle, CAST(arg_min(k, (quantity - q) * (quantity - q) + (price - p) * (price - p) / 1000000) AS BIGINT) AS condition FROM t2, c GROUP BY unit, cycle, quantity, price")
def m2_assign_condition(spark: SparkSession, d: str) -> DataFrame:
    centres = [(10.0, 20000.0), (25.0, 40000.0), (40.0, 60000.0)]
    return M.assign_condition(lineitem_telemetry(spark, d), centres, ["quantity", "price"], [1.0, 1000.0]).select("unit", "cycle", "condition")


@query("SELECT event_type AS label, CAST(greatest(0, least(floor(value / 10), 9)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL")
def g13_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Ten bins, the first and the last one open."""
    bin_ = F.greatest(F.lit(0), F.least(F.floor(F.col("value") / 10), F.lit(9))).cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("label"), bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {PRED} SELECT condition, CAST(floor(y / 10) AS BIGINT) AS bin, count(*) AS n, round(avg(p - y), 6) AS residual FROM p GROUP BY ALL")
def g13_residuals(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("condition", F.floor(F.col("y") / 10).alias("bin")).agg(F.count("*").alias("n"), r6("avg(p - y)", "residual"))


@query("SELECT event_id, CASE WHEN value > 30 THEN 'none' WHEN value <= 15 THEN 'critical' ELSE 'warning' END AS severity, round(1 / (1 + exp(-value / 50)), 6) AS p FROM events")
def x7_x10_severity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.severity(F.col("value"), 30).alias("severity"), F.round(X.sigmoid(F.col("value") / 50), 6).alias("p"))


ERF_SQL = "x AS (SELECT event_id, (30 - value) / (15 * sqrt(2.0)) AS x FROM events), t AS (SELECT event_id, x, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(x)) AS t FROM x)"


@query(f"WITH {ERF_SQL} SELECT event_id, round(0.5 * (1 + sign(x) * (1 - ((((CAST(1.061405429 AS DOUBLE) * t - CAST(1.453152027 AS DOUBLE)) * t + CAST(1.421413741 AS DOUBLE)) * t - CAST(0.284496736 AS DOUBLE)) * t + CAST(0.254829592 AS DOUBLE)) * t * exp(-x * x))), 6) AS p FROM t")
def x8_failure_probability(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(X.failure_probability(F.col("value"), 30, 15), 6).alias("p"))


@query("SELECT metric, regexp_replace(metric, '^(val|test|train)_', '') NOT IN ('rmse', 'mae', 'nasa_score', 'loss', 'brier') AS higher, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'test_rmse' WHEN 'click' THEN 'val_f1' WHEN 'view' THEN 'train_loss' ELSE 'pr_auc' END AS metric FROM events) GROUP BY ALL")
def x11_metric_direction(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("event_type") == "error", "test_rmse").when(F.col("event_type") == "click", "val_f1").when(F.col("event_type") == "view", "train_loss").otherwise("pr_auc")
    return table(spark, d, "events").select(m.alias("metric")).groupBy("metric", X.higher_is_better(F.col("metric")).alias("higher")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, 'model.name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'data.region', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey, 'data.path', '/x' FROM nation")
def x12_flatten_params(spark: SparkSession, d: str) -> DataFrame:
    """Dotted keys of nested configuration, secret-looking ones dropped."""
    n = table(spark, d, "nation")
    conf = F.create_map(F.lit("model"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("api_key"), F.lit("x")), F.lit("data"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("path"), F.lit("/x")))
    return G.flatten_params(n.select("n_nationkey", conf.alias("config")), "n_nationkey", "config")


@query("SELECT o_orderkey, greatest(0, 86400 * 30 - CAST(epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) AS BIGINT)) AS remaining FROM orders")
def x15_cooldown(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.cooldown_remaining(F.lit("1998-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp"), 86400 * 30).cast("long").alias("remaining"))


@query("SELECT event_id, round(value * 0.25 + 100 * 0.75, 6) AS fused FROM events")
def x4_fuse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(X.fuse(F.col("value"), F.lit(100.0), 0.25), 6).alias("fused"))
