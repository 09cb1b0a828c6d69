"""Order over whole tables and long groups: ranges, positions and running totals in two passes, frames over blocks with a border.

No task orders a whole table or group. Rows are dealt to ranges by Spark's own range partitioning and stored with the number of
their range; the ranges' totals, one row for each range and group in it, give the offsets of the rows inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prognos.storage import stored

#: Ranges at least; else the session's shuffle partitions.
RANGES = 8
#: Positions of a group that are one block of a framed window.
BLOCK = 65_536
#: Hexadecimal digits of a hash that name its bucket when rows are ranked by hash.
DIGITS = 3


def dealt(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """df, stored, with _range: the number of the row's range in the ascending order of the columns (nulls first); equal rows are in one range."""
    ranges = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = True, ranges: int | None = None) -> DataFrame:
    """Adds cum_<s>, the total of s over the group's rows up to this one in the order of a column without ties, and all_<s>, that of the group."""
    rows = dealt(df, [*by, order], ranges)
    return _totals(rows, by, F.col(order).desc() if descending else F.col(order).asc(), sums, descending).drop("_range")


def _totals(rows: DataFrame, by: list[str], inside, sums: list[str], descending: bool) -> DataFrame:  # noqa: ANN001
    group = Window.partitionBy(*(by or [F.lit(0)]))  # holds a row for each range that the group lies in
    before = group.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *[F.sum(f"_t_{s}").over(group).alias(f"all_{s}") for s in sums])
    order = Window.partitionBy(*by, "_range").orderBy(inside).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(totals if by else F.broadcast(totals), [*by, "_range"])  # without groups, one row for each range
    return out.withColumns({f"cum_{s}": F.sum(s).over(order) + F.col(f"_b_{s}") for s in sums}).drop(*[f"_b_{s}" for s in sums])


def positions(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "pos", ranges: int | None = None) -> DataFrame:
    """Adds the row's position, from 1, in the ascending order of its group (of the table, without `by`); groups are equal or both null."""
    by = by or []
    rows = dealt(df, [*by, *order], ranges)
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_range"])], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_range"])]
    found = rows.join(counts if by else F.broadcast(counts), same)
    at = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return found.withColumn(name, (at + F.col("_before")).cast("long")).drop("_range", "_before", *[f"_k{i}" for i in range(len(by) + 1)])


def with_border(df: DataFrame, pos: str, before: int, block: int | None = None) -> DataFrame:
    """Rows dealt to blocks of positions of their group, each block with the `before` rows in front of it.

    Adds _block, and _own, which is false for those rows. A frame of the last before + 1 rows by (group, _block) is that of the whole group.
    """
    block = max(block or BLOCK, before, 1)
    at, place = F.floor((F.col(pos) - 1) / block), (F.col(pos) - 1) % block
    blocks = F.when(place >= block - before, F.array(at, at + 1)).otherwise(F.array(at)) if before else F.array(at)
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == at)


def hash_ranks(df: DataFrame, digest: str, ties: list[str], name: str) -> DataFrame:
    """Adds the row's rank, from 1, by (digest, ties) over the whole table; the digest is a hexadecimal text whose values spread evenly.

    The first digits name a bucket, and the buckets' counts (16 ** DIGITS rows at most) give the offsets.
    """
    rows = df.withColumn("_bucket", F.substring(digest, 1, DIGITS))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_c")).select("_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(digest, *ties))
    return rows.join(F.broadcast(counts), "_bucket").withColumn(name, at + F.col("_before")).drop("_bucket", "_before")
