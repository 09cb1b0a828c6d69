"""Helpers shared by the training-data operators: tables, durable intermediates, Arrow text buffers, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.storage import forget, stored  # noqa: F401  durable intermediates

#: Rows of one Arrow batch between the JVM and Python; bounds what a task holds of long texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def integer_vectors(df: DataFrame, column: str, scale: int) -> DataFrame:
    """The rows whose vector is there and has finite entries only, each entry as the long floor(scale * entry)."""
    valid = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.coalesce(valid, F.lit(False))).withColumn(column, F.transform(column, lambda e: F.floor(scale * e.cast("double"))))


def hash01(col: Column | str) -> Column:
    """A repeatable number in [0, 1) from a key, the same on every run and plan."""
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) / float(1 << 30)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch behind one another, and where each begins (one more entry than texts); null is empty."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if arr.offset:
        arr = pa.concat_arrays([arr])
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cuts a batch into runs of rows with about `most` bytes of text, at least a row each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(size):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if len(size) > begin:
        yield batch.slice(begin)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge, the smallest node it reaches.

    Each round every remaining vertex points to its smallest neighbour if that is smaller, two jumps along the pointers
    follow, and the edges are contracted to the pointers' ends. Only grouped minima and equi-joins are used; neither
    edges nor labels reach the driver. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*pair(F.col(a), F.col(b)))
    e = stored(e.distinct(), "edges")
    labels = stored(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")), "labels")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = p0 = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("up")), "parents")
        for _ in range(2):
            q = p.select(F.col("v").alias("w"), F.col("up").alias("further"))
            p = p.hint("merge").join(q.hint("merge"), p.up == q.w, "left").select("v", F.coalesce("further", "up").alias("up"))
        first, p = p0, stored(p, "parents")
        old, labels = labels, stored(labels.join(p, labels.component == p.v, "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        l, r = p.select(F.col("v").alias("a"), F.col("up").alias("ua")), p.select(F.col("v").alias("b"), F.col("up").alias("ub"))
        before, e = e, e.join(l, "a").join(r, "b").where("ua <> ub")
        e = stored(e.select(*pair(F.col("ua"), F.col("ub"))).distinct(), "edges")
        forget(before, first, p, old)
    forget(e)
    return labels
