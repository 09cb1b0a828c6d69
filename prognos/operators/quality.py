"""Data quality: every check returns violation rows (check, column, key, value), so all failures are seen at once."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prognos.operators.ordered import positions, with_border
from prognos.storage import exists, move, remove


#: (check, column, when it fails, key of the row, value to show)
Rule = tuple[str, str, Column, Column, Column]


def typed(column: str, kind: str, key: str) -> Rule:
    """Fails on a null and on a value that doesn't cast to the type."""
    return "type_or_null", column, F.expr(f"try_cast(`{column}` as {kind}) is null"), F.col(key), F.col(column)


def above_zero(column: str, key: str) -> Rule:
    return "positive", column, ~(F.col(column) > 0), F.col(key), F.col(column)


def within(column: str, allowed: list, key: str) -> Rule:
    return "domain", column, ~F.col(column).isin(allowed), F.col(key), F.col(column)


def in_runs(df: DataFrame, unit: str = "unit", cycle: str = "cycle") -> tuple[DataFrame, Rule]:
    """df with a mark on one row of every unit whose cycles aren't exactly 1..N, and the rule on it; the frame is that of labels and windows."""
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(unit).orderBy(cycle)))
    whole = Window.partitionBy(unit)
    wrong = F.max(~F.col(cycle).eqNullSafe(F.col("_place"))).over(whole)
    placed = placed.withColumns({"_broken": wrong & (F.col("_place") == 1), "_rows": F.count("*").over(whole)})
    return placed, ("contiguous", cycle, F.col("_broken"), F.col(unit), F.col("_rows"))


def failures(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(check, column, key, value) of all failures of all rules, from one scan: each row lists its own. A comparison with null fails no rule."""
    listed = [F.when(bad, F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), key.cast("string").alias("key"), value.cast("string").alias("value"))) for check, column, bad, key, value in rules]
    return df.select(F.explode(F.filter(F.array(*listed), lambda x: x.isNotNull())).alias("x")).select("x.*")


def schema_contract(df: DataFrame, schema: dict[str, str], key: str, strict: bool = True) -> DataFrame:
    """Missing and surplus columns, values that don't cast to the type, and nulls."""
    found = [("missing", c) for c in schema if c not in df.columns] + [("surplus", c) for c in df.columns if strict and c not in schema]
    named = df.sparkSession.createDataFrame([(k, c, None, None) for k, c in found], "check string, column string, key string, value string")
    rules = [typed(c, t, key) for c, t in schema.items() if c in df.columns]
    return named.unionByName(failures(df, rules)) if rules else named


def positive(df: DataFrame, column: str, key: str) -> DataFrame:
    return failures(df, [above_zero(column, key)])


def domain(df: DataFrame, column: str, allowed: list, key: str) -> DataFrame:
    return failures(df, [within(column, allowed, key)])


def contiguous(df: DataFrame, unit: str = "unit", cycle: str = "cycle") -> DataFrame:
    """Units whose cycles aren't exactly 1..N."""
    s = df.groupBy(unit).agg(F.min(cycle).alias("lo"), F.max(cycle).alias("hi"), F.count("*").alias("n"), F.countDistinct(cycle).alias("d"))
    return failures(s, [("contiguous", cycle, F.expr("lo <> 1 or hi <> n or d <> n"), F.col(unit), F.col("n"))])


def monotonic(df: DataFrame, series: str, position: str | list[str], instant: str, block: int | None = None) -> DataFrame:
    """Rows whose instant lies before that of the row in front of them in the order of the position; the key is the (first) position.

    Series may be long: rows are placed in two passes and looked at in blocks of positions with the row in front of each block.
    """
    order = [position] if isinstance(position, str) else position
    rows = with_border(positions(df.select(series, instant, *order), order, [series], "_pos"), "_pos", 1, block)
    before = F.lag(instant).over(Window.partitionBy(series, "_block").orderBy("_pos"))
    rows = rows.withColumn("_before", before).where("_own")
    return failures(rows, [("monotonic", instant, F.col("_before") > F.col(instant), F.col(order[0]), F.date_format(instant, "yyyy-MM-dd HH:mm:ss"))])


def write_checked(df: DataFrame, path: str, by: list[str], dataset: str, rules: list[Rule]) -> None:
    """Writes the table by partitions if no row fails a rule; else nothing stays, and the first failures are named.

    One pass tells rows apart while it writes: those that fail would go to a folder of their own, so that whether it is there is
    all that has to be looked at. What was written is then moved to its place. Columns that begin with an underscore serve the rules and
    aren't written.
    """
    spark, staged = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    kept = [c for c in df.columns if not c.startswith("_")]
    fails = reduce(Column.__or__, [F.coalesce(bad, F.lit(False)) for _, _, bad, _, _ in rules], F.lit(False))
    df.withColumn("_ok", ~fails).select("_ok", *kept).write.partitionBy("_ok", *by).parquet(staged)
    try:
        if exists(spark, f"{staged}/_ok=false"):
            require_clean(violations(dataset, failures(df, rules)))
        if exists(spark, f"{staged}/_ok=true"):
            move(spark, f"{staged}/_ok=true", path)
        else:
            df.select(*kept).where("false").write.partitionBy(*by).parquet(path)
    finally:
        remove(spark, staged)


def verify_stored(spark: SparkSession, sets: list[tuple[str, str, list[Rule]]]) -> DataFrame:
    """(dataset, status, n, failed) of stored sets (name, path, rules): ok, invalid with the number of failures, or missing where nothing is stored."""
    parts = []
    for name, path, rules in sets:
        if exists(spark, path):
            failed = reduce(Column.__add__, [F.when(bad, 1).otherwise(0) for _, _, bad, _, _ in rules], F.lit(0))
            got = spark.read.parquet(path).agg(F.count("*").alias("n"), F.coalesce(F.sum(failed), F.lit(0)).cast("long").alias("failed"))
        else:
            got = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("failed")).withColumn("status", F.lit("missing"))
        status = F.when(F.col("failed") > 0, "invalid").otherwise("ok")
        parts.append(got.select(F.lit(name).alias("dataset"), (F.col("status") if "status" in got.columns else status).alias("status"), "n", "failed"))
    return reduce(DataFrame.unionByName, parts)


def label_count(units: DataFrame, labels: DataFrame, unit: str = "unit") -> DataFrame:
    """One row if the number of labels isn't the number of units."""
    a = units.agg(F.countDistinct(unit).alias("units")).join(labels.agg(F.count("*").alias("labels")), F.lit(True))
    return failures(a, [("label_count", unit, F.expr("units <> labels"), F.col("units"), F.col("labels"))])


def violations(dataset: str, *parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select(F.lit(dataset).alias("dataset"), "*")


def require_clean(found: DataFrame) -> None:
    """Raises with the first failures if there are any."""
    if some := found.limit(20).collect():
        raise ValueError("; ".join(f"{r.dataset}: {r.check} {r.column} {r.key}={r.value}" for r in some))


def disjoint(train: DataFrame, held: DataFrame, unit: str = "unit") -> DataFrame:
    """Units that both splits hold; none if the split doesn't leak."""
    return train.select(unit).intersect(held.select(unit))


def request_problem(names: Column, win: Column, expected: list[str], length: int) -> Column:
    """Why a scoring request is refused, or null: feature order, window length, ragged rows, or a bad cell."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        F.when(F.coalesce(F.size(win), F.lit(0)) <= 0, "empty")
        .when(~(names == F.array(*map(F.lit, expected))), "features")
        .when(F.size(win) != length, "length")
        .when(F.exists(win, lambda r: F.size(r) != len(expected)), "ragged")
        .when(F.exists(win, lambda r: F.exists(r, bad)), "value")
    )


def bad_cells(requests: DataFrame, key: str, win: str) -> DataFrame:
    """(key, row, col) of every cell that is null, NaN or infinite."""
    cells = requests.select(key, F.posexplode(win).alias("row", "_r")).select(key, "row", F.posexplode("_r").alias("col", "_v"))
    return cells.where(F.col("_v").isNull() | F.isnan("_v") | (F.abs("_v") == float("inf"))).select(key, "row", "col")
