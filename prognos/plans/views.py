"""The telemetry views that the registered queries run on, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENSORS = ["quantity", "price", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task at most, as far as keys allow.
TASK_ROWS = 500_000


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Rows dealt by a key to as many partitions as there are cores, and more of a table of more rows, so that what a task orders does not grow with the table.

    Adaptive execution leaves these partitions as they are: by bytes it would give a small table's windows, and the fits on them, to one task.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), key)


def events_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, cycle, sensor, condition, ts, event_id: one unit for each user, cycles in the order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spread(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type"), "user_id")
    return e.select(F.col("user_id").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"), F.col("value").alias("sensor"), F.col("event_type").alias("condition"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def lineitem_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, cycle, four sensors and the return flag: one unit for each supplier."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    li = spread(li, "l_suppkey")
    return li.select(F.col("l_suppkey").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("kind"))


T1 = "t1 AS (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, value AS sensor, event_type AS condition, ts, event_id FROM events)"
T2 = "t2 AS (SELECT l_suppkey AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS cycle, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_returnflag AS kind FROM lineitem)"
LONG2 = "l2 AS (SELECT unit, cycle, kind, feature, value FROM (SELECT unit, cycle, kind, quantity, price, discount, tax FROM t2) UNPIVOT (value FOR feature IN (quantity, price, discount, tax)))"
