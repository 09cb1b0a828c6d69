"""Queries: sources, quality, profiling, projections, joins, labels, windows, splits and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.functions import scalar as X
from prognos.operators import quality as V
from prognos.operators import registry as G
from prognos.operators import telemetry as T
from prognos.plans.registry import query
from prognos.plans.views import LONG2, SENSORS, T1, T2, events_telemetry, lineitem_telemetry, spread, table
from prognos.sources import readers as S

R = "round({0}, 6)".format


def r6(c: str, alias: str | None = None):  # noqa: ANN201
    return F.round(F.expr(c), 6).alias(alias or c)


# ---- sources and sinks -------------------------------------------------------------------------------------------------


@query(f"WITH {T2} SELECT unit, count(*) AS n, max(cycle) AS last, round(sum(price), 2) AS price FROM t2 GROUP BY unit")
def s1_run_text(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch(spark, "runs")
    lineitem_telemetry(spark, d).select(F.concat(F.lit(" "), F.concat_ws("  ", "unit", "cycle", *SENSORS), F.lit("  ")).alias("value")).write.text(path)
    runs = S.read_run_text(spark, path, {"unit": "long", "cycle": "long", **{s: "double" for s in SENSORS}})
    return runs.groupBy("unit").agg(F.count("*").alias("n"), F.max("cycle").alias("last"), F.round(F.sum("price"), 2).alias("price"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS pos, (s_suppkey * 7) % 50 AS value FROM supplier")
def s2_labels(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch(spark, "labels")
    sup = table(spark, d, "supplier")
    sup.orderBy("s_suppkey").select(((F.col("s_suppkey") * 7) % 50).cast("string").alias("value")).coalesce(1).write.option("lineSep", " ").text(path)
    return S.read_labels(spark, path).select(F.col("pos").cast("long").alias("pos"), "value")


@query("SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s3_series_csv(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch(spark, "series")
    table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "value").write.option("header", True).csv(path)
    return S.read_series_csv(spark, path).groupBy(F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_mktsegment AS market_segment, count(*) AS customers FROM customer GROUP BY 1")
def s4_renames(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_mktsegment").count().toDF("Market Segment [x]", "N")
    return S.snake_case(c, {"Market Segment [x]": "Market-Segment", "N": "Customers"})


INTERVALS = [("2024-01-05 00:00:00", "2024-01-05 12:00:00"), ("2024-01-10 06:00:00", "2024-01-12 18:00:00")]
INTERVAL_SQL = "w(\"start\", \"end\") AS (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in INTERVALS) + ")"


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "start string, end string").select(F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"))


@query(f"WITH {INTERVAL_SQL} SELECT CAST(count(*) AS BIGINT) AS n FROM events e WHERE EXISTS (SELECT 1 FROM w WHERE e.ts BETWEEN w.\"start\" AND w.\"end\")")
def s5_intervals_json(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch(spark, "intervals")
    text = F.to_json(F.create_map(F.lit("series"), F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in INTERVALS])))
    spark.range(1).select(text.alias("value")).write.text(path)
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return T.label_intervals(e, S.read_intervals(spark, path, "series")).agg(F.count_if("is_anomaly").alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def s6_scan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {T1} SELECT condition, CASE WHEN unit % 2 = 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM t1 GROUP BY ALL")
def s7_partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch(spark, "runs")
    S.write_partitioned(events_telemetry(spark, d).withColumn("split", F.when(F.col("unit") % 2 == 0, "train").otherwise("test")), path, ["condition", "split"])
    return spark.read.parquet(path).groupBy("condition", "split").agg(F.count("*").alias("n"))


def customer_files(spark: SparkSession, d: str) -> str:
    path = S.scratch(spark, "files")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("value"), "c_nationkey", "c_custkey")
    c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("value", "c_nationkey").write.partitionBy("c_nationkey").text(path)
    return path


FILES = "f AS (SELECT c_nationkey, sha256(string_agg(c_custkey || chr(10), '' ORDER BY c_custkey)) AS digest, CAST(sum(len(CAST(c_custkey AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1)"


@query(f"WITH {FILES} SELECT digest, bytes FROM f")
def s9_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digest and size of every file of customers, one file of sorted keys for each nation; nothing is unchanged against an empty manifest."""
    now = S.manifest(spark, customer_files(spark, d))
    return S.changed_files(now, now.where("false")).select("digest", "bytes")


@query(f"WITH {FILES} SELECT sha256(string_agg(digest, '' ORDER BY digest)) AS fingerprint FROM f")
def s10_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return S.fingerprint(S.manifest(spark, customer_files(spark, d)))


@query(f"WITH {T2}, m AS (SELECT unit, count(*) AS n, max(cycle) AS last FROM t2 GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY unit) * 7 % 50 AS label FROM m) SELECT CAST(unit % 4 AS INTEGER) AS subset, CAST(sum(n) AS BIGINT) AS n, count(*) AS units, max(last - 1 + label) AS longest, (SELECT count(*) FROM t2) AS written FROM l GROUP BY unit % 4")
def s12_convert_runs(spark: SparkSession, d: str) -> DataFrame:
    """Read text, check, attach labels by position, write by subset, profile: one job over a subset column; the write tells failures apart."""
    raw, file, out = S.scratch(spark, "raw"), S.scratch(spark, "labels"), S.scratch(spark, "converted")
    t = lineitem_telemetry(spark, d)
    t.select(F.concat_ws(" ", "unit", "cycle", *SENSORS).alias("value")).write.text(raw)
    T.positions(t.select("unit").distinct(), ["unit"]).sort("pos").select((F.col("pos") * 7 % 50).cast("string").alias("value")).coalesce(1).write.text(file)
    runs = S.read_run_text(spark, raw, {"unit": "long", "cycle": "long", **{s: "double" for s in SENSORS}}).withColumn("subset", F.col("unit") % 4)
    labels = S.read_labels(spark, file).withColumnRenamed("value", "true_rul")
    V.require_clean(V.violations("runs", V.label_count(runs, labels)))
    dealt = spread(runs, "unit", table(spark, d, "lineitem").count())
    checked, order = V.in_runs(T.add_rul_truncated(T.attach_by_position(dealt, labels, "true_rul")))
    rules = [V.typed(c, "double", "unit") for c in ("unit", "cycle", *SENSORS)] + [V.above_zero("cycle", "unit"), V.within("subset", [0, 1, 2, 3], "unit"), order]
    V.write_checked(checked, out, ["subset"], "runs", rules)
    done = spark.read.parquet(out)
    profile = done.groupBy("subset").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"), F.max("rul").alias("longest"))
    return profile.join(F.broadcast(done.agg(F.count("*").alias("written"))), F.lit(True))  # one row


RECORDS = f"{T2}, rec AS (SELECT unit || '-' || cycle AS id, kind, quantity, price, discount, tax, CAST(quantity > 40 AS BIGINT) AS machine_failure, CAST(quantity > 40 AS BIGINT) AS twf, CAST(quantity > 41 AS BIGINT) AS hdf, CAST(quantity > 42 AS BIGINT) AS pwf, CAST(quantity > 43 AS BIGINT) AS osf, CAST(quantity > 44 AS BIGINT) AS rnf FROM t2)"


@query(f"WITH {RECORDS} SELECT kind AS type, count(*) AS n, round(avg(machine_failure), 6) AS failure_rate FROM rec GROUP BY 1")
def s13_convert_records(spark: SparkSession, d: str) -> DataFrame:
    out = S.scratch(spark, "records")
    recs = S.snake_case(machine_records(spark, d).withColumnRenamed("kind", "Type"))
    flags = ["machine_failure", "twf", "hdf", "pwf", "osf", "rnf"]
    V.write_checked(recs, out, ["type"], "records", [V.within("type", ["A", "N", "R"], "id"), *[V.typed(c, "double", "id") for c in SENSORS], *[V.within(c, [0, 1], "id") for c in flags]])
    return spark.read.parquet(out).groupBy("type").agg(F.count("*").alias("n"), r6("avg(machine_failure)", "failure_rate"))


@query(f"WITH {INTERVAL_SQL}, l AS (SELECT event_type AS condition, EXISTS (SELECT 1 FROM w WHERE e.ts BETWEEN w.\"start\" AND w.\"end\") AS a FROM events e) SELECT condition, count(*) AS n, count(*) FILTER (WHERE a) AS anomalous FROM l GROUP BY 1")
def s14_convert_series(spark: SparkSession, d: str) -> DataFrame:
    out = S.scratch(spark, "series")
    e = events_telemetry(spark, d).select("condition", "ts", "sensor", "event_id")
    V.require_clean(V.violations("series", V.monotonic(e, "condition", "event_id", "ts")))  # in the order of arrival
    T.label_intervals(e, intervals(spark)).write.partitionBy("condition").parquet(out)
    return spark.read.parquet(out).groupBy("condition").agg(F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalous"))


# ---- quality -----------------------------------------------------------------------------------------------------------


def machine_records(spark: SparkSession, d: str) -> DataFrame:
    flags = {n: (F.col("quantity") > 40 + i).cast("long") for i, n in enumerate(["twf", "hdf", "pwf", "osf", "rnf"])}
    df = lineitem_telemetry(spark, d).withColumn("id", F.concat_ws("-", "unit", "cycle"))
    return df.select("id", "kind", *SENSORS, (F.col("quantity") > 40).cast("long").alias("machine_failure"), *[c.alias(n) for n, c in flags.items()])




@query("SELECT 'type_or_null' AS \"check\", 'props' AS \"column\", CAST(event_id AS VARCHAR) AS key, CAST(props AS VARCHAR) AS value FROM events WHERE try_cast(props AS DOUBLE) IS NULL UNION ALL SELECT 'missing', 'absent', NULL, NULL UNION ALL SELECT 'surplus', c, NULL, NULL FROM (VALUES ('ts'), ('user_id'), ('event_type')) t(c)")
def v1_schema_contract(spark: SparkSession, d: str) -> DataFrame:
    return V.schema_contract(table(spark, d, "events"), {"event_id": "long", "value": "double", "props": "double", "absent": "int"}, "event_id")


@query(f"WITH {T2} SELECT 'positive' AS \"check\", 'discount' AS \"column\", CAST(unit AS VARCHAR) AS key, count(*) AS n FROM t2 WHERE NOT discount > 0 GROUP BY unit")
def v2_positive(spark: SparkSession, d: str) -> DataFrame:
    return V.positive(lineitem_telemetry(spark, d), "discount", "unit").groupBy("check", "column", "key").agg(F.count("*").alias("n"))


@query(f"WITH {T2} SELECT 'domain' AS \"check\", 'kind' AS \"column\", kind AS value, count(*) AS n FROM t2 WHERE kind NOT IN ('A', 'R') GROUP BY kind")
def v3_domain(spark: SparkSession, d: str) -> DataFrame:
    return V.domain(lineitem_telemetry(spark, d), "kind", ["A", "R"], "unit").groupBy("check", "column", "value").agg(F.count("*").alias("n"))


@query(f"WITH {T1}, g AS (SELECT unit, cycle FROM t1 WHERE NOT (unit % 10 = 0 AND cycle = 3)) SELECT 'contiguous' AS \"check\", 'cycle' AS \"column\", CAST(unit AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value FROM g GROUP BY unit HAVING min(cycle) <> 1 OR max(cycle) <> count(*) OR count(DISTINCT cycle) <> count(*)")
def v4_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return V.contiguous(events_telemetry(spark, d).where("not (unit % 10 = 0 and cycle = 3)"))


@query("SELECT event_type AS series, count(*) AS n FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events) WHERE b > ts GROUP BY 1")
def v5_monotonic(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    found = V.monotonic(e, "event_type", "event_id", "ts").withColumnRenamed("key", "k")
    return found.join(e.select(F.col("event_id").cast("string").alias("k"), F.col("event_type").alias("series")), "k").groupBy("series").agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) SELECT strftime(l_shipdate, '%Y') AS year, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM o WHERE b > l_shipdate GROUP BY 1")
def v5_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines that were shipped before the line in front of them, of three long series in blocks of 5,000 rows."""
    li = table(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    found = V.monotonic(li, "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_shipdate", block=5000)
    return found.groupBy(F.substring("value", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("orders"))


@query(f"WITH {T2} SELECT 'runs' AS dataset, 'positive' AS \"check\", 'discount' AS \"column\", count(*) AS n FROM t2 WHERE NOT discount > 0 UNION ALL SELECT 'runs', 'domain', 'kind', count(*) FROM t2 WHERE kind NOT IN ('A', 'R')")
def v6_all_failures(spark: SparkSession, d: str) -> DataFrame:
    t, order = V.in_runs(lineitem_telemetry(spark, d))
    found = V.failures(t, [*[V.typed(c, "double", "unit") for c in SENSORS], V.above_zero("discount", "unit"), V.within("kind", ["A", "R"], "unit"), order])
    return V.violations("runs", found).groupBy("dataset", "check", "column").agg(F.count("*").alias("n"))


@query("SELECT 'events' AS dataset, CASE WHEN count(*) FILTER (WHERE value IS NULL OR event_type NOT IN ('click', 'error')) > 0 THEN 'invalid' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE event_type NOT IN ('click', 'error')) AS failed FROM events UNION ALL SELECT 'orders', 'ok', count(*), 0 FROM orders UNION ALL SELECT 'absent', 'missing', 0, 0")
def v7_verify_stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored sets read again under their rules: one is invalid, one is fine, one isn't there."""
    events = [V.typed("value", "double", "event_id"), V.within("event_type", ["click", "error"], "event_id")]
    orders = [V.typed("o_orderdate", "timestamp", "o_orderkey"), V.above_zero("o_totalprice", "o_orderkey")]
    return V.verify_stored(spark, [("events", f"{d}/events.parquet", events), ("orders", f"{d}/orders.parquet", orders), ("absent", f"{d}/absent.parquet", [])])


@query(f"WITH {T1} SELECT 'label_count' AS \"check\", 'unit' AS \"column\", CAST((SELECT count(DISTINCT unit) FROM t1) AS VARCHAR) AS key, CAST((SELECT count(*) FROM supplier) AS VARCHAR) AS value")
def v8_label_count(spark: SparkSession, d: str) -> DataFrame:
    return V.label_count(events_telemetry(spark, d), table(spark, d, "supplier"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three cycles and two values that follow one another in each unit, with faults planted by unit number."""
    t = lineitem_telemetry(spark, d).withColumns({"block": F.floor((F.col("cycle") - 1) / 3), "cycle": (F.col("cycle") - 1) % 3 + 1})
    row = F.when((F.col("unit") % 11 == 0) & (F.col("cycle") == 2), F.array("discount")).when((F.col("unit") % 7 == 0) & (F.col("cycle") == 3), F.array("discount", F.lit(float("nan")))).otherwise(F.array("discount", "tax"))
    win = F.transform(F.array_sort(F.collect_list(F.struct("cycle", row.alias("r")))), lambda x: x["r"])
    g = t.where("not (unit % 5 = 0 and cycle = 1)").groupBy("unit", "block").agg(win.alias("win"))
    return g.withColumn("names", F.when(F.col("unit") % 13 == 0, F.array(F.lit("tax"), F.lit("discount"))).otherwise(F.array(F.lit("discount"), F.lit("tax"))))


@query(f"WITH {T2} SELECT unit, cycle // 3 - 1 AS block, CAST(CASE WHEN unit % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS row, CAST(1 AS BIGINT) AS col FROM t2 WHERE unit % 7 = 0 AND cycle % 3 = 0")
def v11_bad_cells(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).withColumn("id", F.struct("unit", "block"))
    return V.bad_cells(r, "id", "win").select("id.unit", "id.block", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query(f"WITH {T2} , b AS (SELECT unit, (cycle - 1) // 3 AS block, count(*) AS n FROM t2 WHERE NOT (unit % 5 = 0 AND cycle % 3 = 1) GROUP BY ALL) SELECT unit, block, CASE WHEN unit % 13 = 0 THEN 'features' WHEN n <> 3 THEN 'length' WHEN unit % 11 = 0 THEN 'ragged' WHEN unit % 7 = 0 THEN 'value' ELSE 'accepted' END AS reason FROM b")
def v12_request_contract(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("unit", "block", F.coalesce(V.request_problem(F.col("names"), F.col("win"), ["discount", "tax"], 3), F.lit("accepted")).alias("reason"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def v14_test_once(spark: SparkSession, d: str) -> DataFrame:
    """Runs that may still be scored on the test split: those without a test row in the evaluations."""
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"))
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "test").otherwise("val").alias("split"))
    return G.untested(runs, done)


@query(f"WITH {T1}, s AS (SELECT *, ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 AS val FROM t1) SELECT unit FROM s WHERE val INTERSECT SELECT unit FROM s WHERE NOT val")
def v16_leakage_audit(spark: SparkSession, d: str) -> DataFrame:
    s = T.split_rows(events_telemetry(spark, d), ["event_id"])
    return V.disjoint(s.where("split = 'train'"), s.where("split = 'val'"))


# ---- profiling and projections -----------------------------------------------------------------------------------------


@query(f"WITH {T2}, c AS (SELECT unit, count(*) AS n FROM t2 GROUP BY unit) SELECT (SELECT count(*) FROM t2) AS n, count(*) AS units, min(n) AS shortest, CAST(median(n) AS DOUBLE) AS middle, max(n) AS longest, (SELECT round(stddev_samp(quantity), 6) FROM t2) AS quantity_std, (SELECT round(stddev_samp(tax), 6) FROM t2) AS tax_std FROM c")
def p1_profile_runs(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem_telemetry(spark, d)
    per = t.groupBy("unit").agg(F.count("*").alias("n"))
    std = t.agg(r6("stddev_samp(quantity)", "quantity_std"), r6("stddev_samp(tax)", "tax_std"))
    return per.agg(F.sum("n").alias("n_"), F.count("*").alias("units"), F.min("n").alias("shortest"), F.median("n").alias("middle"), F.max("n").alias("longest")).withColumnRenamed("n_", "n").join(std, F.lit(True))


@query(f"WITH {RECORDS} SELECT kind, count(*) AS n, CAST(sum(machine_failure) AS BIGINT) AS failures, round(avg(machine_failure), 6) AS rate FROM rec GROUP BY kind")
def p2_profile_records(spark: SparkSession, d: str) -> DataFrame:
    return machine_records(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("machine_failure").alias("failures"), r6("coalesce(avg(machine_failure), 0.0)", "rate"))


@query(f"WITH {INTERVAL_SQL} SELECT event_type AS series, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, CAST(2 AS BIGINT) AS intervals, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM w WHERE e.ts BETWEEN w.\"start\" AND w.\"end\") THEN 1 ELSE 0 END) AS BIGINT) AS anomalous FROM events e GROUP BY 1")
def p3_profile_series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    n = intervals(spark).agg(F.count("*").alias("intervals"))
    day = "yyyy-MM-dd HH:mm:ss"
    return T.label_intervals(e, intervals(spark)).groupBy("series").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), day).alias("first"), F.date_format(F.max("ts"), day).alias("last"), F.count_if("is_anomaly").alias("anomalous")).join(F.broadcast(n), F.lit(True))


@query("SELECT 'const' AS feature, CAST(0 AS DOUBLE) AS std")
def p4_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    return T.constant_columns(lineitem_telemetry(spark, d).withColumn("const", F.lit(100.0)), [*SENSORS, "const"])


@query(f"WITH {T2} SELECT unit, cycle, quantity FROM t2")
def f1_drop_constant(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem_telemetry(spark, d).withColumn("const", F.lit(100.0))
    gone = [r.feature for r in T.constant_columns(t, ["quantity", "const"]).collect()]
    return t.drop(*gone, "absent").drop("price", "discount", "tax", "kind")


@query(f"WITH {RECORDS} SELECT kind, CAST(sum(CASE WHEN (twf + hdf + pwf + osf + rnf > 0) = (machine_failure = 1) THEN 1 ELSE 0 END) AS BIGINT) AS agree, count(*) AS n FROM rec GROUP BY kind")
def f2_leak_flags(spark: SparkSession, d: str) -> DataFrame:
    rec = machine_records(spark, d)
    agree = rec.groupBy("kind").agg(F.count_if(F.expr("(twf = 1 or hdf = 1 or pwf = 1 or osf = 1 or rnf = 1) = (machine_failure = 1)")).alias("agree"))
    return rec.drop("twf", "hdf", "pwf", "osf", "rnf").groupBy("kind").agg(F.count("*").alias("n")).join(agree, "kind")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def f3_prefix_selection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select([c for c in o.columns if c.startswith(("o_order", "o_cust")) and c != "o_orderdate"])


@query(f"WITH {T1}, r AS (SELECT *, max(cycle) OVER (PARTITION BY unit) - cycle AS rul FROM t1) SELECT unit, cycle, CAST(rul < 60 AS BIGINT) AS is_anomaly FROM r")
def f4_healthy_mask(spark: SparkSession, d: str) -> DataFrame:
    return T.add_rul(events_telemetry(spark, d)).select("unit", "cycle", (F.col("rul") < 60).cast("long").alias("is_anomaly"))


@query(f"WITH {INTERVAL_SQL}, l AS (SELECT event_type AS series, ts, EXISTS (SELECT 1 FROM w WHERE e.ts BETWEEN w.\"start\" AND w.\"end\") AS a FROM events e), f AS (SELECT series, min(ts) FILTER (WHERE a) AS first FROM l GROUP BY series), m AS (SELECT l.series, max(ts) AS last FROM l JOIN f USING (series) WHERE ts < first GROUP BY l.series) SELECT l.series, CAST(sum(CASE WHEN ts < first THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN ts > last THEN 1 ELSE 0 END) AS BIGINT) AS test FROM l JOIN f USING (series) JOIN m USING (series) GROUP BY l.series")
def f5_healthy_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = T.label_intervals(table(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "event_id"), intervals(spark))
    return T.healthy_prefix(e, "series", "ts", "is_anomaly").groupBy("series").agg(F.count_if("in_train").alias("train"), F.count_if("in_test").alias("test"))


@query(f"WITH {T1} SELECT condition, CAST(sum(CASE WHEN sensor >= 75 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS n FROM t1 GROUP BY condition")
def f6_score_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return events_telemetry(spark, d).withColumn("flag", (F.col("sensor") >= 75).cast("long")).groupBy("condition").agg(F.sum("flag").alias("flagged"), F.count("*").alias("n"))


@query("SELECT 'p_size' AS metric, count(*) AS n FROM part UNION ALL SELECT 'p_retailprice', count(*) FROM part")
def f7_numeric_metrics(spark: SparkSession, d: str) -> DataFrame:
    from prognos.operators.evaluate import numeric_only

    p = table(spark, d, "part").select("p_partkey", F.col("p_brand"), F.col("p_size").cast("string").alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"))
    return numeric_only(p.unpivot(["p_partkey"], ["p_brand", "p_size", "p_retailprice"], "metric", "value")).groupBy("metric").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS run_id, 'name=' || n_name AS tags FROM nation")
def f8_hide_internal_tags(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("run_id"), F.create_map(F.lit("mlflow.user"), F.lit("x"), F.lit("name"), F.col("n_name")).alias("t"))
    return n.select("run_id", G.shown_tags("t", "mlflow.").alias("tags"))


# ---- joins -------------------------------------------------------------------------------------------------------------


@query(f"WITH {T1}, u AS (SELECT unit, row_number() OVER (ORDER BY unit) AS pos FROM (SELECT DISTINCT unit FROM t1)) SELECT t1.unit, count(*) AS n, max(u.pos * 7 % 50) AS true_rul FROM t1 JOIN u USING (unit) GROUP BY t1.unit")
def j1_positional_join(spark: SparkSession, d: str) -> DataFrame:
    t = events_telemetry(spark, d)
    labels = T.positions(t.select("unit").distinct(), ["unit"]).select("pos", (F.col("pos") * 7 % 50).alias("true_rul"))
    return T.attach_by_position(t, labels, "true_rul").groupBy("unit").agg(F.count("*").alias("n"), F.max("true_rul").alias("true_rul"))


@query(f"WITH {INTERVAL_SQL} SELECT event_id, EXISTS (SELECT 1 FROM w WHERE e.ts BETWEEN w.\"start\" AND w.\"end\") AS is_anomaly FROM events e")
def j2_interval_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return T.label_intervals(e, intervals(spark)).select("event_id", "is_anomaly")


COND = "s AS (SELECT condition, avg(sensor) AS m, CASE WHEN stddev_pop(sensor) = 0 THEN 1.0 ELSE stddev_pop(sensor) END AS sd FROM t1 GROUP BY condition)"


@query(f"WITH {T1}, {COND} SELECT unit, cycle, round((sensor - m) / sd, 6) AS z FROM t1 JOIN s USING (condition)")
def j3_condition_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = events_telemetry(spark, d)
    return T.normalise_conditions(t, ["sensor"], T.fit_conditions(t, ["sensor"], "condition"), "condition").select("unit", "cycle", r6("sensor", "z"))


@query(f"WITH {T1}, v AS (SELECT DISTINCT unit FROM t1 WHERE condition = 'error' AND sensor > 95) SELECT 'in' AS side, count(*) AS n FROM t1 WHERE unit IN (SELECT unit FROM v) UNION ALL SELECT 'out', count(*) FROM t1 WHERE unit NOT IN (SELECT unit FROM v)")
def j4_membership_split(spark: SparkSession, d: str) -> DataFrame:
    t = events_telemetry(spark, d)
    v = t.where("condition = 'error' and sensor > 95").select("unit").distinct()
    side = lambda how, name: t.join(v, "unit", how).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side("left_semi", "in").unionByName(side("left_anti", "out"))


@query(f"WITH {T1} SELECT a.unit, a.cycle, round(a.sensor * 0.3 + b.price * 0.7, 6) AS fused FROM t1 a JOIN (SELECT l_suppkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS cycle, l_extendedprice AS price FROM lineitem) b ON a.unit = b.unit AND a.cycle = b.cycle")
def j7_align_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = events_telemetry(spark, d), lineitem_telemetry(spark, d)
    return a.join(b, ["unit", "cycle"]).select("unit", "cycle", F.round(X.fuse(F.col("sensor"), F.col("price"), 0.3), 6).alias("fused"))


# ---- labels, windows, splits, scaling ----------------------------------------------------------------------------------

RUL = "r AS (SELECT *, max(cycle) OVER (PARTITION BY unit) - cycle AS rul FROM t1)"


@query(f"WITH {T1}, {RUL} SELECT unit, cycle, rul FROM r")
def w1_rul(spark: SparkSession, d: str) -> DataFrame:
    return T.add_rul(events_telemetry(spark, d)).select("unit", "cycle", "rul")


@query(f"WITH {T1}, {RUL} SELECT unit, cycle, rul + unit * 7 % 50 AS rul FROM r")
def w2_rul_truncated(spark: SparkSession, d: str) -> DataFrame:
    return T.add_rul_truncated(events_telemetry(spark, d).withColumn("true_rul", F.col("unit") * 7 % 50)).select("unit", "cycle", "rul")


@query(f"WITH {T1}, {RUL} SELECT unit, cycle, least(rul, 25) AS rul, CAST(rul <= 30 AS BIGINT) AS will_fail FROM r")
def x1_x2_labels(spark: SparkSession, d: str) -> DataFrame:
    r = T.add_rul(events_telemetry(spark, d))
    return r.select("unit", "cycle", X.cap_rul(F.col("rul"), 25).alias("rul"), X.will_fail(F.col("rul"), 30).alias("will_fail"))


FRAME30 = "OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query(f"WITH {T1}, f AS (SELECT unit, cycle, first_value(sensor) {FRAME30} AS first, sensor AS last, sum(sensor) {FRAME30} AS total FROM t1) SELECT unit, cycle AS end_cycle, CAST(30 AS BIGINT) AS size, round(first, 6) AS first, round(last, 6) AS last, round(total, 6) AS total FROM f WHERE cycle >= 30 AND (cycle - 30) % 5 = 0")
def w3_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = T.sliding_windows(events_telemetry(spark, d), ["sensor"], 30, 5)
    total = F.aggregate("win", F.lit(0.0), lambda s, x: s + x["sensor"])
    return w.select("unit", "end_cycle", F.size("win").cast("long").alias("size"), F.round(F.col("win")[0]["sensor"], 6).alias("first"), F.round(F.element_at("win", -1)["sensor"], 6).alias("last"), F.round(total, 6).alias("total"))


@query(f"WITH {T1}, n AS (SELECT unit, count(*) AS n, sum(sensor) AS s, min_by(sensor, cycle) AS first, max_by(sensor, cycle) AS last FROM t1 GROUP BY unit) SELECT unit, n AS end_cycle, CAST(60 AS BIGINT) AS size, round(s + (60 - n) * first, 4) AS total FROM n WHERE n < 60 UNION ALL SELECT unit, cycle, 60, round(sum(sensor) OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 4) FROM t1 QUALIFY cycle >= 60")
def w4_padded_windows(spark: SparkSession, d: str) -> DataFrame:
    w = T.sliding_windows(events_telemetry(spark, d), ["sensor"], 60, 1, pad=True)
    return w.select("unit", "end_cycle", F.size("win").cast("long").alias("size"), F.round(F.aggregate("win", F.lit(0.0), lambda s, x: s + x["sensor"]), 4).alias("total"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Remaining life, failure label and summary features of every 30-cycle window."""
    r = T.add_rul(events_telemetry(spark, d)).withColumn("will_fail", X.will_fail(F.col("rul"), 30)).withColumn("rul", X.cap_rul(F.col("rul"), 125))
    return T.window_features(r, ["sensor"], 30, 1).select("unit", "end_cycle", "rul", "will_fail", *[F.round(f"sensor_{s}", 6).alias(s) for s in ("mean", "std", "min", "max", "slope")])


@query(f"WITH {T1}, {RUL}, f AS (SELECT unit, cycle, rul, avg(sensor) {FRAME30} AS mean, stddev_pop(sensor) {FRAME30} AS std, min(sensor) {FRAME30} AS min, max(sensor) {FRAME30} AS max, regr_slope(sensor, cycle) {FRAME30} AS slope FROM r) SELECT unit, cycle AS end_cycle, least(rul, 125) AS rul, CAST(rul <= 30 AS BIGINT) AS will_fail, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(slope, 6) AS slope FROM f WHERE cycle >= 30")
def w5_window_features(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query("SELECT event_type AS series, event_id, CAST(0 AS BIGINT) AS unit, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS cycle FROM events")
def w6_series_as_unit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), "event_id", "ts")
    return T.positions(e, ["ts", "event_id"], ["series"], "cycle").select("series", "event_id", F.lit(0).cast("long").alias("unit"), (F.col("cycle") - 1).alias("cycle"))


SPLIT = "u AS (SELECT unit, row_number() OVER (ORDER BY md5('42:' || unit), unit) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM t1)), sp AS (SELECT unit, CASE WHEN r <= greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) THEN 'val' ELSE 'train' END AS split FROM u)"


@query(f"WITH {T1}, {SPLIT} SELECT split, count(*) AS n, count(DISTINCT unit) AS units FROM t1 JOIN sp USING (unit) GROUP BY split")
def z1_split_by_unit(spark: SparkSession, d: str) -> DataFrame:
    return T.split_by_unit(events_telemetry(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"))


@query("SELECT event_id, CASE WHEN ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM events")
def z2_split_rows(spark: SparkSession, d: str) -> DataFrame:
    return T.split_rows(table(spark, d, "events"), ["event_id"]).select("event_id", "split")


@query("WITH h AS (SELECT event_type, ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 AS h FROM events), c AS (SELECT event_type, quantile_cont(h, 0.2) AS cut FROM h GROUP BY 1) SELECT event_type, CASE WHEN h < cut THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM h JOIN c USING (event_type) GROUP BY ALL")
def z3_split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return T.split_stratified(table(spark, d, "events"), "event_type", ["event_id"]).groupBy("event_type", "split").agg(F.count("*").alias("n"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS r FROM events) WHERE r <= 50")
def z4_fixed_sample(spark: SparkSession, d: str) -> DataFrame:
    return T.fixed_sample(table(spark, d, "events"), ["event_type"], ["event_id"], 50).select("event_type", "event_id")


Z5 = "SELECT event_id, round(value + 2.0 * sqrt(-2 * ln(1 - ('0x' || substr(md5('43:' || event_id || ':value'), 1, 8))::BIGINT / 4294967296.0)) * cos(2 * pi() * ('0x' || substr(md5('44:' || event_id || ':value'), 1, 8))::BIGINT / 4294967296.0), 6) AS value FROM events WHERE ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 >= 0.1"


@query(Z5)
def z5_perturb(spark: SparkSession, d: str) -> DataFrame:
    return T.perturb(table(spark, d, "events"), ["value"], ["event_id"], 2.0, 0.1).select("event_id", r6("value"))


@query(f"WITH {T1}, w AS (SELECT unit, cycle FROM t1 WHERE cycle >= 30) SELECT CASE WHEN ('0x' || substr(md5('42:' || unit || ':' || cycle), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM w GROUP BY 1")
def z6_split_windows(spark: SparkSession, d: str) -> DataFrame:
    w = T.sliding_windows(events_telemetry(spark, d), ["sensor"], 30)
    return T.split_rows(w, ["unit", "end_cycle"]).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {T1} SELECT condition, 'sensor' AS feature, round(avg(sensor), 6) AS mean, round(CASE WHEN stddev_pop(sensor) = 0 THEN 1.0 ELSE stddev_pop(sensor) END, 6) AS std FROM t1 GROUP BY condition")
def a1_condition_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.fit_conditions(events_telemetry(spark, d), ["sensor"], "condition").select("condition", "feature", r6("mean"), r6("std"))


@query(f"WITH {T2}, {LONG2} SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM l2 GROUP BY feature")
def a2_scaler(spark: SparkSession, d: str) -> DataFrame:
    return T.fit_scaler(lineitem_telemetry(spark, d), SENSORS).select("feature", r6("mean"), r6("std"))


@query(f"WITH {T2} SELECT unit, cycle, round((quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER (), 6) AS z, round(quantity, 6) AS back FROM t2")
def x3_zscore(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem_telemetry(spark, d)
    s = T.fit_scaler(t, ["quantity"])
    z = T.scale(t, ["quantity"], s).join(F.broadcast(s), F.col("feature") == "quantity")  # one row
    return z.select("unit", "cycle", r6("quantity", "z"), F.round(X.unscale(F.col("quantity"), F.col("mean"), F.col("std")), 6).alias("back"))


M4 = f"WITH {T1}, {RUL}, {SPLIT}, j AS (SELECT r.*, split FROM r JOIN sp USING (unit)), c AS (SELECT condition, avg(sensor) AS m, stddev_pop(sensor) AS sd FROM j WHERE split = 'train' GROUP BY condition), z AS (SELECT unit, cycle, split, rul, (sensor - m) / sd AS v FROM j JOIN c USING (condition)), g AS (SELECT avg(v) AS gm, stddev_pop(v) AS gs FROM z WHERE split = 'train'), y AS (SELECT unit, cycle, split, rul, (v - gm) / gs AS v FROM z, g)"


@query(M4 + f" SELECT split, unit, cycle AS end_cycle, least(rul, 125) AS rul, CAST(rul <= 30 AS BIGINT) AS will_fail, round(avg(v) {FRAME30}, 5) AS mean FROM y QUALIFY cycle >= 30")
def m4_prepare_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Label, split, condition-normalise, scale and window, all parameters from the train split."""
    t = T.split_by_unit(T.add_rul(events_telemetry(spark, d)))
    t = t.withColumn("will_fail", X.will_fail(F.col("rul"), 30)).withColumn("rul", X.cap_rul(F.col("rul"), 125))
    t = T.normalise_conditions(t, ["sensor"], T.fit_conditions(t.where("split = 'train'"), ["sensor"], "condition"), "condition")
    t = T.scale(t, ["sensor"], T.fit_scaler(t.where("split = 'train'"), ["sensor"]))
    w = T.sliding_windows(t, ["sensor"], 30)
    return w.select("split", "unit", "end_cycle", "rul", "will_fail", F.round(F.aggregate("win", F.lit(0.0), lambda s, x: s + x["sensor"]) / 30, 5).alias("mean"))


@query(f"WITH {T1}, p AS (SELECT unit, cycle, sensor FROM t1 WHERE ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT / 4294967296.0 >= 0.1), q AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY cycle) AS rn, cycle, avg(sensor) {FRAME30} AS mean FROM p) SELECT unit, cycle AS end_cycle, round(mean, 6) AS mean FROM q WHERE rn >= 30")
def m5_production_windows(spark: SparkSession, d: str) -> DataFrame:
    t = T.perturb(events_telemetry(spark, d), [], ["event_id"], 0.0, 0.1)
    return T.window_features(t, ["sensor"], 30).select("unit", "end_cycle", F.round("sensor_mean", 6).alias("mean"))


@query("WITH s AS (SELECT event_type AS series, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS cycle FROM events), z AS (SELECT series, cycle, (value - avg(value) OVER (PARTITION BY series)) / stddev_pop(value) OVER (PARTITION BY series) AS v FROM s) SELECT series, cycle AS end_cycle, round(avg(v) OVER (PARTITION BY series ORDER BY cycle ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 5) AS mean FROM z QUALIFY cycle >= 11 AND (cycle - 11) % 4 = 0")
def m6_series_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), "ts", "event_id", "value")
    s = T.positions(e, ["ts", "event_id"], ["series"], "cycle").select("series", "value", (F.col("cycle") - 1).alias("cycle"))
    s = T.normalise_conditions(s, ["value"], T.fit_conditions(s, ["value"], "series"), "series")
    return T.window_features(s, ["value"], 12, 4, unit="series", block=5000).select("series", "end_cycle", F.round("value_mean", 5).alias("mean"))


@query(f"WITH {T2} SELECT unit, cycle AS end_cycle, round(sum(quantity * quantity) OVER (PARTITION BY unit ORDER BY cycle ROWS 9 PRECEDING) / 10, 4) AS error, CAST(10 AS BIGINT) AS size FROM t2 QUALIFY cycle >= 10")
def x16_x17_window_vector(spark: SparkSession, d: str) -> DataFrame:
    w = T.sliding_windows(lineitem_telemetry(spark, d), ["quantity"], 10)
    v = w.withColumn("v", X.flatten_window(F.col("win"), ["quantity"]))
    return v.select("unit", "end_cycle", F.round(X.squared_error(F.col("v"), F.transform("v", lambda x: x * 0)), 4).alias("error"), F.size("v").cast("long").alias("size"))


@query("SELECT o_orderkey, lower(replace(o_orderpriority, '-', '_')) AS priority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def x18_text_helpers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))).alias("priority"), F.date_format(F.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd")), "yyyy-MM-dd").alias("day"))


@query("SELECT n_nationkey, 'https://host/' || n_name AS uri, 'spark-' || n_nationkey || '-' || CASE WHEN n_nationkey % 3 = 0 THEN 'nogit' ELSE substr(md5(n_name), 1, 8) END AS version FROM nation")
def x13_x14_labels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    sha = F.when(F.col("n_nationkey") % 3 != 0, F.md5("n_name"))
    return n.select("n_nationkey", X.scrub_uri(F.concat(F.lit("https://user:secret@host/"), "n_name")).alias("uri"), X.version_label(F.lit("spark"), F.col("n_nationkey"), sha).alias("version"))
