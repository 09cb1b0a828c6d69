"""Tables written to the folder that driver and executors share, so that a lineage ends there and the planner knows their true size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="prognos-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/prognos/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; a lost executor costs only the tasks it held."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored there, in any store that Spark reads."""
    system, place = _place(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Gives what is stored another path in the same store, at which nothing may be."""
    system, place = _place(spark, path)
    if exists(spark, to) or not system.rename(place, _place(spark, to)[1]):
        raise FileExistsError(to)


def forget(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote, once all that was made of it is itself stored."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            remove(df.sparkSession, path)
