"""Sources and sinks: header-less run text, label files, series CSV, interval JSON, partitioned parquet, file manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prognos.storage import scratch  # noqa: F401  where sources are written to be read back


def read_run_text(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Header-less text; runs of blanks and blanks at the ends are one separator. columns: name -> type, in order."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).try_cast(t).alias(c) for i, (c, t) in enumerate(columns.items())])


def _placed_lines(spark: SparkSession, lines: DataFrame, size: Column) -> DataFrame:
    """lines (with _f, _b, _l, their file, split and place in the order of reading) with _before: the sum of size over all lines of the file in front.

    The lines of each split are summed, the sums in front of a split are its offset, and a line's own place in its split follows from the
    order in which it was read. No task holds a file, only a split.
    """
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("_f", "_b").agg(F.sum(size).alias("_n")).select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # a row for each split
    inside = Window.partitionBy("_f", "_b").orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return placed.join(splits, ["_f", "_b"]).withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")


def _lines(df: DataFrame) -> DataFrame:
    return df.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_l"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of the white-space separated integers of a file, pos from 1 in file order; of several files, each begins at 1."""
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    lines = _lines(spark.read.text(path)).withColumn("w", words).where(F.size("w") > 0)
    each = _placed_lines(spark, lines, F.size("w")).select("_before", F.posexplode("w").alias("i", "v"))
    return each.select((F.col("_before") + F.col("i") + 1).alias("pos"), F.col("v").cast("long").alias("value"))


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, value); the order is a matter of the query."""
    return spark.read.schema("timestamp string, value double").option("header", True).csv(path).withColumn("timestamp", F.to_timestamp("timestamp"))


def read_intervals(spark: SparkSession, path: str, series: str) -> DataFrame:
    """(start, end) of one key of a JSON map of interval lists; no rows for a missing key."""
    text = spark.read.text(path, wholetext=True)
    windows = F.from_json("value", "map<string, array<array<string>>>")
    pair = text.select(F.explode(F.coalesce(F.try_element_at(windows, F.lit(series)), F.array().cast("array<array<string>>"))).alias("w"))
    return pair.select(F.to_timestamp(F.col("w")[0]).alias("start"), F.to_timestamp(F.col("w")[1]).alias("end"))


def snake_case(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    df = df.withColumnsRenamed(renames or {})
    return df.toDF(*[re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", c.lower())).strip("_") for c in df.columns])


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.partitionBy(*by).parquet(path)


#: Bytes up to which a file is digested whole; lines of a piece of a larger file.
WHOLE, PIECE_LINES = 64 << 20, 4096


def piece_digests(spark: SparkSession, path: str, above: int = WHOLE, lines: int = PIECE_LINES) -> DataFrame:
    """(file, piece, digest, bytes) of every piece of so many lines of every file of more than `above` bytes under a path, with the file's size.

    Lines are what line feeds part, of any bytes; a piece's digest is of its lines' digests in order. A file is read in splits, so none
    has to fit in a row; a single line has to.
    """
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).where(F.col("_metadata.file_size") > above)
    rows = text.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_l"), F.col("_metadata.file_size").alias("bytes"))
    rows = rows.select("_f", "_b", "_l", "bytes", F.sha2(F.col("value").cast("binary"), 256).alias("h"))
    placed = _placed_lines(spark, rows, F.lit(1).cast("long"))
    piece = F.floor(F.col("_before") / lines)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_before", "h"))), lambda x: x["h"]))
    return placed.groupBy(F.col("_f").alias("file"), piece.alias("piece"), "bytes").agg(F.sha2(joined, 256).alias("digest"))


def manifest(spark: SparkSession, path: str, whole: int = WHOLE, lines: int = PIECE_LINES) -> DataFrame:
    """(name, digest, bytes) of every file under a path.

    The digest of a file of at most `whole` bytes is of its content; that of a larger one is of its size and its pieces' digests in order.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("name")
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= whole)
    small = small.select(name("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"))
    pieces = F.concat_ws("", F.col("bytes").cast("string"), F.transform(F.array_sort(F.collect_list(F.struct("piece", "digest"))), lambda x: x["digest"]))
    large = piece_digests(spark, path, whole, lines).groupBy("file", "bytes").agg(F.sha2(pieces, 256).alias("digest"))
    return small.unionByName(large.select(name("file"), "digest", "bytes"))


def changed_pieces(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(before, ["file", "piece", "digest"], "left_anti")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.join(before, ["name", "digest"], "left_anti")


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a set of files, whatever their order: the digest of the sorted digests."""
    return files.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("digest"))), 256).alias("fingerprint"))
