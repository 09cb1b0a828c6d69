"""Queries: drift, registry, monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.functions import scalar as X
from prognos.operators import drift as D
from prognos.operators import evaluate as E
from prognos.operators import monitor as O
from prognos.operators import registry as G
from prognos.operators import telemetry as T
from prognos.plans.q_telemetry import r6
from prognos.plans.registry import query
from prognos.plans.views import LONG2, SENSORS, T1, T2, events_telemetry, lineitem_telemetry, table
from prognos.storage import scratch, stored


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Even units as reference; odd units, price shifted, as production: long tables."""
    t = lineitem_telemetry(spark, d)
    shifted = t.where("unit % 2 = 1").withColumn("price", F.col("price") * 1.5 + 3)
    return T.long(t.where("unit % 2 = 0"), [], SENSORS), T.long(shifted, [], SENSORS)


def frozen(ref: DataFrame) -> DataFrame:
    """The frozen reference as a stored table: statistics are computed once, checks read them."""
    return stored(D.freeze(ref), "frozen")


EDGES = ", ".join(f"quantile_cont(value, {k / 10})" for k in range(1, 10))
BASE = f"{T2}, {LONG2}, ref AS (SELECT feature, value FROM l2 WHERE unit % 2 = 0), prod AS (SELECT feature, CASE WHEN feature = 'price' THEN value * 1.5 + 3 ELSE value END AS value FROM l2 WHERE unit % 2 = 1), ed AS (SELECT feature, [{EDGES}] AS edges FROM ref GROUP BY feature), bins AS (SELECT feature, b AS bin FROM ed, range(10) t(b))"
HIST = "{0}h AS (SELECT bins.feature, bins.bin, count(x.value) AS c FROM bins LEFT JOIN (SELECT s.feature, len(list_filter(edges, lambda e: e <= s.value)) AS bin, s.value FROM {1} s JOIN ed USING (feature)) x ON x.feature = bins.feature AND x.bin = bins.bin GROUP BY ALL)"
PSI = f"{BASE}, {HIST.format('r', 'ref')}, {HIST.format('p', 'prod')}, sh AS (SELECT r.feature, greatest(r.c / sum(r.c) OVER (PARTITION BY r.feature), 1e-4) AS q, greatest(p.c / sum(p.c) OVER (PARTITION BY r.feature), 1e-4) AS p FROM rh r JOIN ph p ON r.feature = p.feature AND r.bin = p.bin), psi AS (SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM sh GROUP BY feature)"
KS = "b AS (SELECT feature, value, 1 AS a, 0 AS b FROM ref UNION ALL SELECT feature, value, 0, 1 FROM prod), g AS (SELECT feature, value, sum(a) AS a, sum(b) AS b FROM b GROUP BY ALL), nn AS (SELECT feature, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb FROM b GROUP BY feature), cu AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g WINDOW w AS (PARTITION BY feature ORDER BY value)), kd AS (SELECT feature, max(abs(ca / na - cb / nb)) AS statistic, any_value(na) AS na, any_value(nb) AS nb FROM cu JOIN nn USING (feature) GROUP BY feature), kl AS (SELECT *, statistic * sqrt(na * nb / (na + nb)) AS lam FROM kd), ks AS (SELECT feature, statistic, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (SELECT 2 * sum((CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS p_value FROM kl)"


@query(f"WITH {BASE} SELECT feature, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max, round(quantile_cont(value, 0.01), 5) AS q01, round(quantile_cont(value, 0.5), 5) AS q50, round(quantile_cont(value, 0.99), 5) AS q99 FROM ref GROUP BY feature")
def a3_reference_moments(spark: SparkSession, d: str) -> DataFrame:
    ref, _ = sides(spark, d)
    return frozen(ref).select("feature", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max", "q01", "q50", "q99")])


@query(f"WITH {BASE} SELECT feature, CAST(generate_subscripts(edges, 1) - 1 AS BIGINT) AS i, round(unnest(edges), 5) AS edge FROM ed")
def a4_bin_edges(spark: SparkSession, d: str) -> DataFrame:
    return frozen(sides(spark, d)[0]).select("feature", F.posexplode("edges").alias("i", "e")).select("feature", F.col("i").cast("long").alias("i"), r6("round(e, 5)", "edge"))


@query(f"WITH {BASE}, {HIST.format('p', 'prod')} SELECT feature, bin, c FROM ph")
def a5_histogram(spark: SparkSession, d: str) -> DataFrame:
    ref, prod = sides(spark, d)
    return D.histogram(prod, frozen(ref).select("feature", "edges")).select("feature", F.col("bin").cast("long").alias("bin"), "c")


@query(f"WITH {PSI} SELECT feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS band FROM psi")
def d_3_psi(spark: SparkSession, d: str) -> DataFrame:
    ref, prod = sides(spark, d)
    return D.psi(frozen(ref), prod).select("feature", r6("psi"), X.psi_band(F.col("psi")).alias("band"))


@query(f"WITH {BASE}, {KS} SELECT feature, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM ks")
def w11_kolmogorov_smirnov(spark: SparkSession, d: str) -> DataFrame:
    return D.ks(*sides(spark, d)).select("feature", r6("statistic"), r6("p_value"))


PV = "pv AS (SELECT p_brand AS feature, avg(p_size) / 1000 AS p_value FROM part GROUP BY 1)"


def p_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_size") / 1000).alias("p_value"))


@query(f"WITH {PV} SELECT feature, p_value <= 0.6 / count(*) OVER () AS reject FROM pv")
def w12_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return D.bonferroni(p_values(spark, d), alpha=0.6).select("feature", "reject")


@query(f"WITH {PV}, r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM pv), m AS (SELECT *, max(CASE WHEN p_value <= k / n * 0.026 THEN k END) OVER () AS top FROM r) SELECT feature, coalesce(k <= top, false) AS reject FROM m")
def w13_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return D.benjamini_hochberg(p_values(spark, d), alpha=0.026).select("feature", "reject")


REPORT = f"{PSI}, {KS}, mo AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM ref GROUP BY feature), mp AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM prod GROUP BY feature), j AS (SELECT feature, psi, statistic, p_value, mp.m - mo.m AS mean_shift, mp.s / nullif(mo.s, 0) AS std_ratio FROM psi JOIN ks USING (feature) JOIN mo USING (feature) JOIN mp USING (feature)), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM j), rep AS (SELECT *, coalesce(k <= max(CASE WHEN p_value <= k / n * 0.05 THEN k END) OVER (), false) AS reject FROM r)"


def report(spark: SparkSession, d: str) -> DataFrame:
    ref, prod = map(D.tallied, sides(spark, d))
    return D.input_drift(frozen(ref), ref, prod)


@query(f"WITH {REPORT} SELECT feature, round(psi, 6) AS psi, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, reject, round(mean_shift, 5) AS mean_shift, round(std_ratio, 5) AS std_ratio FROM rep")
def d_4_input_drift(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).select("feature", r6("psi"), r6("statistic"), r6("p_value"), "reject", F.round("mean_shift", 5).alias("mean_shift"), F.round("std_ratio", 5).alias("std_ratio"))


@query(f"WITH {REPORT} SELECT round(avg(psi), 6) AS mean_psi, round(max(psi), 6) AS max_psi, arg_max(feature, psi) AS max_feature, count(*) FILTER (WHERE psi >= 0.25) AS significant, count(*) FILTER (WHERE psi >= 0.1 AND psi < 0.25) AS moderate, count(*) FILTER (WHERE reject) AS rejected FROM rep")
def d_5_drift_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.summary(report(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_psi", "max_psi")})


@query(f"WITH {T1}, t AS (SELECT 'prediction' AS feature, unit, 0.5 * sensor + cycle AS value FROM t1), ref AS (SELECT feature, value FROM t WHERE unit % 2 = 0), prod AS (SELECT feature, value FROM t WHERE unit % 2 = 1), ed AS (SELECT feature, [{EDGES}] AS edges FROM ref GROUP BY feature), bins AS (SELECT feature, b AS bin FROM ed, range(10) t(b)), {HIST.format('r', 'ref')}, {HIST.format('p', 'prod')}, sh AS (SELECT greatest(r.c / sum(r.c) OVER (), 1e-4) AS q, greatest(p.c / sum(p.c) OVER (), 1e-4) AS p FROM rh r JOIN ph p ON r.bin = p.bin), {KS} SELECT (SELECT round(sum((p - q) * ln(p / q)), 6) FROM sh) AS psi, round(statistic, 6) AS statistic FROM ks")
def d_6_prediction_drift(spark: SparkSession, d: str) -> DataFrame:
    t = events_telemetry(spark, d).select("unit", F.lit("prediction").alias("feature"), (0.5 * F.col("sensor") + F.col("cycle")).alias("value"))
    ref, prod = D.tallied(t.where("unit % 2 = 0")), D.tallied(t.where("unit % 2 = 1"))
    return D.input_drift(frozen(ref), ref, prod).select(r6("psi"), r6("statistic"))


STATE = [("FD001", "2024-01-01 00:00:00"), ("FD002", "2024-01-02 11:00:00")]


def state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE, "target string, last_trigger string").withColumn("last_trigger", F.to_timestamp("last_trigger"))


@query(f"WITH {PSI}, sc AS (SELECT t.target, (SELECT avg(psi) FROM psi) * t.f AS score FROM (VALUES ('FD001', 1.0), ('FD002', 1.0), ('FD003', 0.001)) t(target, f)), st(target, last) AS (VALUES ('FD001', TIMESTAMP '2024-01-01'), ('FD002', TIMESTAMP '2024-01-02 11:00:00')), r AS (SELECT sc.target, score, coalesce(greatest(0, 86400 - CAST(epoch(TIMESTAMP '2024-01-02 12:00:00') - epoch(last) AS BIGINT)), 0) AS remaining FROM sc LEFT JOIN st USING (target)) SELECT target, score >= 0.05 AND remaining = 0 AS triggered, remaining > 0 AS cooldown_active, remaining, CASE WHEN score < 0.05 THEN 'below_threshold' WHEN remaining > 0 THEN 'cooldown' ELSE 'triggered' END AS reason FROM r")
def d_8_trigger_decision(spark: SparkSession, d: str) -> DataFrame:
    ref, prod = sides(spark, d)
    mean = D.psi(frozen(ref), prod).agg(F.avg("psi").alias("psi"))
    scores = mean.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("f")) for t, f in (("FD001", 1.0), ("FD002", 1.0), ("FD003", 0.001))])).alias("x"), "psi").select("x.target", (F.col("psi") * F.col("x.f")).alias("score"))
    return D.decide(scores, state(spark), 0.05, 86400, F.lit("2024-01-02 12:00:00").cast("timestamp")).drop("score")


@query(f"WITH {REPORT}, m AS (SELECT avg(psi) AS psi FROM rep) SELECT target, '2024-01-02 12:00:00' AS last_trigger, 'staging' AS candidate_stage FROM (VALUES ('FD001'), ('FD003')) t(target), m WHERE psi >= 0.01")
def d_9_check_and_record(spark: SparkSession, d: str) -> DataFrame:
    """Check, decide, and the state rows to append: one for each target that triggered."""
    mean = D.summary(report(spark, d)).select(F.explode(F.array(F.lit("FD001"), F.lit("FD003"))).alias("target"), F.col("mean_psi").alias("score"))
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    rows = D.state_rows(D.decide(mean, state(spark), 0.01, 86400, now), now)
    return rows.select("target", F.date_format("last_trigger", "yyyy-MM-dd HH:mm:ss").alias("last_trigger"), F.lit("staging").alias("candidate_stage"))


F30 = "OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
CHECK = f"WITH {T1}, kept AS (SELECT unit, cycle, sensor FROM t1 WHERE unit % 2 = 0 OR ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 >= 0.1), win AS (SELECT unit, round(avg(sensor) {F30}, 6) AS mean, round(max(sensor) {F30}, 6) AS top FROM kept QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cycle) >= 30), sc AS (SELECT avg(mean) AS m1, stddev_pop(mean) AS s1, avg(top) AS m2, stddev_pop(top) AS s2 FROM win WHERE unit % 2 = 0), z AS (SELECT unit, 'mean' AS feature, (mean - m1) / s1 AS value FROM win, sc UNION ALL SELECT unit, 'top', (top - m2) / s2 FROM win, sc), ref AS (SELECT feature, value FROM z WHERE unit % 2 = 0), prod AS (SELECT feature, value FROM z WHERE unit % 2 = 1), ed AS (SELECT feature, [{EDGES}] AS edges FROM ref GROUP BY feature), bins AS (SELECT feature, b AS bin FROM ed, range(10) t(b)), {HIST.format('r', 'ref')}, {HIST.format('p', 'prod')}, sh AS (SELECT r.feature, greatest(r.c / sum(r.c) OVER (PARTITION BY r.feature), 1e-4) AS q, greatest(p.c / sum(p.c) OVER (PARTITION BY r.feature), 1e-4) AS p FROM rh r JOIN ph p ON r.feature = p.feature AND r.bin = p.bin), psi AS (SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM sh GROUP BY feature), {KS}, rep AS (SELECT feature, psi, statistic, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS band FROM psi JOIN ks USING (feature)), hd AS (SELECT avg(psi) AS mean_psi FROM rep)"


@query(CHECK + " SELECT 'features' AS part, feature AS name, round(psi, 6) AS value, band AS note FROM rep UNION ALL SELECT 'summary', 'mean_psi', round(mean_psi, 6), NULL FROM hd UNION ALL SELECT 'decision', 'FD003', round(mean_psi, 6), CASE WHEN mean_psi >= 0.001 THEN 'triggered' ELSE 'below_threshold' END FROM hd UNION ALL SELECT 'state', 'FD003', NULL, '2024-01-02 12:00:00' FROM hd WHERE mean_psi >= 0.001 UNION ALL SELECT 'lines', 'drift_ks{target=\"FD003\",feature=\"' || feature || '\"} ' || printf('%.6f', statistic), NULL, NULL FROM rep UNION ALL SELECT 'lines', 'drift_psi{target=\"FD003\",feature=\"' || feature || '\"} ' || printf('%.6f', psi), NULL, NULL FROM rep UNION ALL SELECT 'lines', 'drift_triggered{target=\"FD003\"} ' || CASE WHEN mean_psi >= 0.001 THEN '1' ELSE '0' END, NULL, NULL FROM hd UNION ALL SELECT 'lines', 'drift_cooldown_active{target=\"FD003\"} 0', NULL, NULL UNION ALL SELECT 'report', feature, row_number() OVER (ORDER BY psi DESC, feature), band FROM rep UNION ALL SELECT 'report', 'verdict', 0, CASE WHEN mean_psi >= 0.25 THEN 'significant' WHEN mean_psi >= 0.1 THEN 'moderate' ELSE 'none' END FROM hd")
def d_10_drift_check(spark: SparkSession, d: str) -> DataFrame:
    """Production windows of perturbed odd units, scaled as the even units' are, against these: report, decision, state, gauges and text."""
    t = events_telemetry(spark, d)
    t = t.where("unit % 2 = 0").unionByName(T.perturb(t.where("unit % 2 = 1"), [], ["event_id"], 0.0, 0.1))
    w = T.window_features(t, ["sensor"], 30).select("unit", F.round("sensor_mean", 6).alias("mean"), F.round("sensor_max", 6).alias("top"))
    w = stored(w, "windows")
    z = T.scale(w, ["mean", "top"], T.fit_scaler(w.where("unit % 2 = 0"), ["mean", "top"]))
    ref, prod = (D.tallied(T.long(z.where(f"unit % 2 = {k}"), [], ["mean", "top"])) for k in (0, 1))
    got = D.check(frozen(ref), ref, prod, "FD003", state(spark), 0.001, 86400, F.lit("2024-01-02 12:00:00").cast("timestamp"))
    none = F.lit(None).cast("string")
    parts = [
        got["features"].select(F.lit("features").alias("part"), F.col("feature").alias("name"), r6("psi", "value"), F.col("band").alias("note")),
        got["summary"].select(F.lit("summary").alias("part"), F.lit("mean_psi").alias("name"), r6("mean_psi", "value"), none.alias("note")),
        got["decision"].select(F.lit("decision").alias("part"), F.col("target").alias("name"), r6("score", "value"), F.col("reason").alias("note")),
        got["state"].select(F.lit("state").alias("part"), F.col("target").alias("name"), F.lit(None).cast("double").alias("value"), F.date_format("last_trigger", "yyyy-MM-dd HH:mm:ss").alias("note")),
        got["lines"].select(F.lit("lines").alias("part"), F.col("line").alias("name"), F.lit(None).cast("double").alias("value"), none.alias("note")),
        got["report"].select(F.lit("report").alias("part"), "name", F.col("rank").cast("double").alias("value"), F.col("verdict").alias("note")),
    ]
    return reduce(DataFrame.unionByName, parts)


WINDOWED = f"{T2}, wn AS (SELECT unit, cycle, count(*) OVER (PARTITION BY unit) AS n, quantity, price FROM t2), ws AS (SELECT unit, least(cycle, 10, n - cycle + 1, n - 9) AS times, quantity, price FROM wn WHERE n >= 10)"


@query(f"WITH {WINDOWED} SELECT unit % 2 AS side, feature, CAST(sum(times) AS BIGINT) AS n, round(sum(times * value) / sum(times), 5) AS mean FROM (SELECT * FROM ws UNPIVOT (value FOR feature IN (quantity, price))) GROUP BY ALL")
def d_1_window_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of windows of 10 rows, by side: a row counts once for each window that holds it."""
    s = D.window_samples(lineitem_telemetry(spark, d), ["quantity", "price"], 10)
    weighed = F.sum(F.col("times") * F.col("value")) / F.sum("times")
    return s.groupBy((F.col("unit") % 2).alias("side"), "feature").agg(F.sum("times").alias("n"), F.round(weighed, 5).alias("mean"))


SAMPLES = f"{WINDOWED}, s AS (SELECT unit, feature, value, unnest(range(times)) AS i FROM (SELECT * FROM ws UNPIVOT (value FOR feature IN (quantity, price)))), ref AS (SELECT feature, value FROM s WHERE unit % 2 = 0), prod AS (SELECT feature, CASE WHEN feature = 'price' THEN value * 1.5 + 3 ELSE value END AS value FROM s WHERE unit % 2 = 1), ed AS (SELECT feature, [{EDGES}] AS edges FROM ref GROUP BY feature), bins AS (SELECT feature, b AS bin FROM ed, range(10) t(b)), {HIST.format('r', 'ref')}, {HIST.format('p', 'prod')}, sh AS (SELECT r.feature, greatest(r.c / sum(r.c) OVER (PARTITION BY r.feature), 1e-4) AS q, greatest(p.c / sum(p.c) OVER (PARTITION BY r.feature), 1e-4) AS p FROM rh r JOIN ph p ON r.feature = p.feature AND r.bin = p.bin), psi AS (SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM sh GROUP BY feature), {KS}, mm AS (SELECT feature, quantile_cont(value, 0.5) AS q50 FROM ref GROUP BY feature)"


@query(f"WITH {SAMPLES} SELECT feature, round(psi, 6) AS psi, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, round(q50, 5) AS q50 FROM psi JOIN ks USING (feature) JOIN mm USING (feature)")
def d_1_window_drift(spark: SparkSession, d: str) -> DataFrame:
    """Drift of the samples of windows of 10 rows: every statistic weighs a row by the windows that hold it, and no window is built."""
    s = D.window_samples(lineitem_telemetry(spark, d), ["quantity", "price"], 10)
    shifted = F.when(F.col("feature") == "price", F.col("value") * 1.5 + 3).otherwise(F.col("value"))
    ref, prod = D.tallied(s.where("unit % 2 = 0"), "times"), D.tallied(s.where("unit % 2 = 1").withColumn("value", shifted), "times")
    base = frozen(ref)
    return D.input_drift(base, ref, prod).join(F.broadcast(base.select("feature", "q50")), "feature").select("feature", r6("psi"), r6("statistic"), r6("p_value"), F.round("q50", 5).alias("q50"))


@query()
def a4_sketched_edges(spark: SparkSession, d: str) -> DataFrame:
    """Approximate edges of the reference from a stored sketch of each day, merged; with the exact share of values up to each edge."""
    e = table(spark, d, "events").where("user_id % 2 = 0").select(F.to_date("ts").alias("day"), F.lit("value").alias("feature"), "value")
    daily = stored(D.sketched(e, ["day"]), "sketches")
    edges = D.freeze_sketches(daily).select("feature", F.posexplode("edges").alias("i", "edge"))
    counted = D.tallied(e.select("feature", "value"))
    return counted.join(F.broadcast(edges), "feature").groupBy("feature", "i", "edge").agg((F.sum(F.when(F.col("value") <= F.col("edge"), F.col("c")).otherwise(0)) / F.first("all_c")).alias("share"))


@query("SELECT event_id, event_type AS feature, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS r FROM events) WHERE r <= 2000")
def d_2_frozen_sample(spark: SparkSession, d: str) -> DataFrame:
    return D.frozen_sample(table(spark, d, "events").withColumnRenamed("event_type", "feature"), ["event_id"])


@query(f"WITH {BASE}, s AS (SELECT 'reference' AS side, value FROM ref WHERE feature = 'price' UNION ALL SELECT 'production', value FROM prod WHERE feature = 'price'), n AS (SELECT side, count(*) AS n FROM s GROUP BY side) SELECT side, CAST(least(floor(value / 6000), 29) AS BIGINT) AS bin, round(count(*) / any_value(n) / 6000, 9) AS density FROM s JOIN n USING (side) GROUP BY ALL")
def d_12_density(spark: SparkSession, d: str) -> DataFrame:
    ref, prod = sides(spark, d)
    one = lambda df, side: df.where("feature = 'price'").select(F.lit(side).alias("side"), "value")
    return D.density(one(ref, "reference").unionByName(one(prod, "production")), 0.0, 180000.0).withColumn("density", F.round("density", 9))


@query(f"WITH {REPORT} SELECT 'drift_psi{{target=\"FD002\",feature=\"' || feature || '\"}} ' || printf('%.6f', psi) AS line FROM rep UNION ALL SELECT 'drift_ks{{target=\"FD002\",feature=\"' || feature || '\"}} ' || printf('%.6f', statistic) FROM rep UNION ALL SELECT 'drift_triggered{{target=\"FD002\"}} 1' UNION ALL SELECT 'drift_cooldown_active{{target=\"FD002\"}} 0'")
def s11_drift_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "gauges")
    D.metric_lines(report(spark, d), "FD002", True, False).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH {REPORT} SELECT feature, round(psi, 6) AS psi FROM rep ORDER BY rep.psi DESC, feature LIMIT 3")
def k2_top_drift(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).orderBy(F.desc("psi"), "feature").limit(3).select("feature", r6("psi"))


@query(f"WITH {REPORT} SELECT row_number() OVER (ORDER BY psi DESC, feature) AS rank, feature AS name, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS verdict FROM rep UNION ALL SELECT 0, 'verdict', CASE WHEN avg(psi) >= 0.25 THEN 'significant' WHEN avg(psi) >= 0.1 THEN 'moderate' ELSE 'none' END FROM rep")
def k8_drift_report(spark: SparkSession, d: str) -> DataFrame:
    """From the stored result, without computing the drift again."""
    from pyspark.sql import Window

    path = scratch(spark, "drift")
    report(spark, d).write.parquet(path)
    rep = spark.read.parquet(path)
    rows = rep.select(F.row_number().over(Window.orderBy(F.desc("psi"), "feature")).cast("long").alias("rank"), F.col("feature").alias("name"), F.col("band").alias("verdict"))
    return rows.unionByName(rep.agg(F.lit(0).cast("long").alias("rank"), F.lit("verdict").alias("name"), X.psi_band(F.avg("psi")).alias("verdict")))


@query("SELECT metric, count(*) AS n FROM (SELECT 'rmse' AS metric FROM orders UNION ALL SELECT 'mae' FROM customer) GROUP BY 1")
def u2_metric_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, t).select(F.lit(m).alias("metric")) for t, m in (("orders", "rmse"), ("customer", "mae")))
    return a.unionByName(b).groupBy("metric").agg(F.count("*").alias("n"))


# ---- registry ----------------------------------------------------------------------------------------------------------

VERSIONS_SQL = "v AS (SELECT o_orderpriority AS model, CAST(o_custkey % 50 AS BIGINT) AS version, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'staging' WHEN 'O' THEN 'production' ELSE 'archived' END AS stage, o_orderdate + to_seconds(CAST(o_orderkey AS BIGINT)) AS changed_at FROM orders), cur AS (SELECT model, version, arg_max(run_id, changed_at) AS run_id, arg_max(stage, changed_at) AS stage FROM v GROUP BY ALL)"


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Stage changes: one row for each order, model by priority, version by customer, latest row of a version counts."""
    stage = F.when(F.col("o_orderstatus") == "F", "staging").when(F.col("o_orderstatus") == "O", "production").otherwise("archived")
    at = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 50).alias("version"), F.col("o_orderkey").alias("run_id"), stage.alias("stage"), at.alias("changed_at"))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("run_id"), F.lit("test_rmse").alias("metric"), F.col("o_totalprice").alias("value"))


@query(f"WITH {VERSIONS_SQL} SELECT cur.model, version, stage, next_version FROM cur JOIN (SELECT model, max(version) + 1 AS next_version FROM v GROUP BY 1) n USING (model)")
def r_2_versions(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    return G.current_stages(v).join(F.broadcast(G.next_version(v)), "model").select("model", "version", "stage", "next_version")


GATE_SQL = VERSIONS_SQL + ", m AS (SELECT o_orderkey AS run_id, o_totalprice AS value FROM orders WHERE o_orderkey % 10 <> 0), best AS (SELECT model, version, value FROM cur LEFT JOIN m USING (run_id) WHERE stage = 'production' QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC) = 1), cand AS (SELECT cur.model, cur.version, m.value AS candidate, best.version IS NOT NULL AS has, best.value AS incumbent FROM cur LEFT JOIN m USING (run_id) LEFT JOIN best USING (model) WHERE stage = 'staging'), gt AS (SELECT model, version, CASE WHEN candidate IS NULL THEN 'candidate_metric_missing' WHEN NOT has THEN 'no_incumbent' WHEN incumbent IS NULL THEN 'incumbent_metric_missing' WHEN incumbent - candidate >= 0.02 * abs(incumbent) - 1e-9 THEN 'improved' ELSE 'not_enough' END AS reason FROM cand)"


@query("WITH " + GATE_SQL + " SELECT model, version, reason IN ('no_incumbent', 'improved') AS passes, reason FROM gt")
def r_4_gate(spark: SparkSession, d: str) -> DataFrame:
    return G.gate(G.candidates(single_production(versions(spark, d)), run_metrics(spark, d), "test_rmse"))


def single_production(v: DataFrame) -> DataFrame:
    """Only the highest production version of a model stays in production; the others count as archived."""
    now = G.current_stages(v)
    top = now.where("stage = 'production'").groupBy("model").agg(F.max("version").alias("top"))
    stage = F.when((F.col("stage") == "production") & (F.col("version") < F.col("top")), "archived").otherwise(F.col("stage"))
    return now.join(F.broadcast(top), "model", "left").select("model", "version", "run_id", stage.alias("stage"), F.lit(0).alias("changed_at"))


@query("WITH " + GATE_SQL + ", up AS (SELECT model, max(version) AS version FROM gt WHERE reason IN ('no_incumbent', 'improved') GROUP BY 1) SELECT model, version, 'production' AS stage FROM up UNION ALL SELECT model, version, 'archived' FROM best WHERE model IN (SELECT model FROM up)")
def r_5_promote(spark: SparkSession, d: str) -> DataFrame:
    return G.promote(single_production(versions(spark, d)), run_metrics(spark, d), "test_rmse", "2024-01-01 00:00:00").select("model", "version", "stage")


@query("WITH " + GATE_SQL + " SELECT model, version, round(candidate, 4) AS candidate, round(incumbent, 4) AS incumbent, has AS has_incumbent FROM cand")
def j5_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = G.candidates(single_production(versions(spark, d)), run_metrics(spark, d), "test_rmse")
    return c.select("model", "version", F.round("candidate", 4).alias("candidate"), F.round("incumbent", 4).alias("incumbent"), "has_incumbent")


@query("SELECT 'spark' AS framework, 'loss' AS metric, count(*) AS n, max(l_linenumber) AS last_step FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def r_1_log_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs with tags, and their metrics by step, appended to tables and read back."""
    runs, metrics = scratch(spark, "runs"), scratch(spark, "run-metrics")
    o = table(spark, d, "orders")
    o.select(F.col("o_orderkey").alias("run_id"), F.create_map(F.lit("seed"), F.col("o_custkey").cast("string"), F.lit("framework"), F.lit("spark")).alias("tags")).write.parquet(runs)
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.lit("loss").alias("metric"), F.col("l_discount").alias("value"), F.col("l_linenumber").alias("step"))
    li.write.mode("append").parquet(metrics)
    return spark.read.parquet(runs).join(spark.read.parquet(metrics), "run_id").groupBy(F.col("tags")["framework"].alias("framework"), "metric").agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


# ---- monitoring --------------------------------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS since, event_type, count(*) AS requests FROM events GROUP BY ALL")
def o5_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return O.counters(e, "ts", ["event_type"]).select(F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "event_type", "requests")


BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0]
HISTO = "b AS (SELECT unnest([5.0, 10.0, 25.0, 50.0, 75.0, NULL]::DOUBLE[]) AS bound), h AS (SELECT event_type, bound, count(*) FILTER (WHERE bound IS NULL OR value <= bound) AS c FROM events, b GROUP BY ALL)"


@query(f"WITH {HISTO} SELECT * FROM h")
def o6_histogram(spark: SparkSession, d: str) -> DataFrame:
    return O.cumulative_histogram(table(spark, d, "events"), "value", BOUNDS, ["event_type"])


@query(f"WITH {HISTO}, o AS (SELECT *, coalesce(lag(bound) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS before, max(c) OVER (PARTITION BY event_type) AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bound NULLS LAST)), f AS (SELECT * FROM o WHERE c >= 0.6 * total QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY bound NULLS LAST) = 1) SELECT event_type, round(CASE WHEN bound IS NULL THEN lo ELSE lo + (bound - lo) * (0.6 * total - before) / (c - before) END, 6) AS quantile FROM f")
def o7_bucket_quantile(spark: SparkSession, d: str) -> DataFrame:
    h = O.cumulative_histogram(table(spark, d, "events"), "value", BOUNDS, ["event_type"])
    return O.bucket_quantile(h, 0.6, ["event_type"]).select("event_type", r6("quantile"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS recent FROM events")
def o8_increase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return O.increase(e, "ts", 600, ["event_type"]).select("event_id", "recent")


@query("SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / greatest(count(*), 1e-9), 6) AS error_rate FROM events GROUP BY 1")
def o9_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return O.error_rate(table(spark, d, "events"), F.col("event_type") == "error", ["user_id"]).select("user_id", r6("error_rate"))


HELD = "h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) > 50 AS breach FROM events GROUP BY ALL), i AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY hour) AS island FROM h), held AS (SELECT event_type, min(hour) AS since, max(hour) AS until FROM i WHERE breach GROUP BY event_type, island HAVING epoch(max(hour)) - epoch(min(hour)) >= 7200)"


def held(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg((F.avg("value") > 50).alias("breach"))
    return O.held_breaches(hourly, "breach", "hour", ["event_type"], 7200)


@query(f"WITH {HELD} SELECT event_type, strftime(since, '%Y-%m-%d %H') AS since, strftime(until, '%Y-%m-%d %H') AS until FROM held")
def w14_held_breaches(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d).select("event_type", F.date_format("since", "yyyy-MM-dd HH").alias("since"), F.date_format("until", "yyyy-MM-dd HH").alias("until"))


ALERTS = f"""WITH {PSI}, hr AS (SELECT date_trunc('hour', ts) AS tm, 100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1),
sm AS (SELECT 'error_rate' AS metric, tm, error_rate AS value FROM hr UNION ALL SELECT 'p95', tm, p95 FROM hr UNION ALL SELECT 'drift', (SELECT max(tm) FROM hr), (SELECT avg(psi) FROM psi)),
ru(rule, metric, bound, lasts, severity) AS (VALUES ('high_error_rate', 'error_rate', 5.0, 600, 'warning'), ('drift', 'drift', 0.25, 0, 'warning'), ('latency', 'p95', 50.0, 300, 'critical'), ('slow_burn', 'p95', 50.0, 36000000, 'info'), ('model_age', 'age', 30.0, 0, 'warning')),
s AS (SELECT rule, lasts, tm, value, value > bound AS breach, epoch(tm) - epoch(lag(tm) OVER (PARTITION BY rule ORDER BY tm)) > 3600 AS apart FROM sm JOIN ru USING (metric)),
i AS (SELECT *, sum(CASE WHEN NOT breach OR coalesce(apart, false) THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY tm) AS run FROM s),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY rule ORDER BY tm DESC) = 1),
f AS (SELECT l.rule, l.lasts, l.tm, l.value, l.breach, (SELECT min(i.tm) FROM i WHERE i.rule = l.rule AND i.run = l.run AND i.breach) AS since FROM l)
SELECT ru.rule, severity, round(f.value, 5) AS value, strftime(CASE WHEN f.breach THEN f.since END, '%Y-%m-%d %H') AS since, CASE WHEN f.value IS NULL THEN 'unknown' WHEN NOT f.breach THEN 'ok' WHEN epoch(f.tm) - epoch(f.since) >= f.lasts THEN 'firing' ELSE 'pending' END AS state FROM ru LEFT JOIN f USING (rule)"""


@query(ALERTS)
def o10_alert_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules over hourly samples, each with labels and the time that a breach must last; one has no samples."""
    e = table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")
    rate = O.error_rate(e, F.col("event_type") == "error", ["at"]).select(F.lit("error_rate").alias("metric"), "at", F.col("error_rate").alias("value"))
    p95 = E.quantiles(e, "value", [0.95], ["at"]).select(F.lit("p95").alias("metric"), "at", F.col("q")[0].alias("value"))
    ref, prod = sides(spark, d)
    drift = D.psi(frozen(ref), prod).agg(F.avg("psi").alias("value")).join(e.agg(F.max("at").alias("at")), F.lit(True)).select(F.lit("drift").alias("metric"), "at", "value")
    warn = lambda s: {"severity": s}
    rules = [("high_error_rate", "error_rate", 5.0, 600, warn("warning")), ("drift", "drift", 0.25, 0, warn("warning")), ("latency", "p95", 50.0, 300, warn("critical")), ("slow_burn", "p95", 50.0, 36_000_000, warn("info")), ("model_age", "age", 30.0, 0, warn("warning"))]
    samples = stored(rate.unionByName(p95).unionByName(drift), "samples")
    return O.alerts(samples, rules, 3600).select("rule", F.col("labels")["severity"].alias("severity"), F.round("value", 5).alias("value"), F.date_format("since", "yyyy-MM-dd HH").alias("since"), "state")


@query("SELECT o_orderpriority AS model, CAST(epoch(TIMESTAMP '2020-01-01') - epoch(max(o_orderdate)) AS BIGINT) AS age FROM orders GROUP BY 1")
def o11_model_age(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.max("o_orderdate").cast("timestamp").alias("t"))
    return last.select("model", X.seconds_since(F.lit("2020-01-01").cast("timestamp"), F.col("t")).cast("long").alias("age"))
