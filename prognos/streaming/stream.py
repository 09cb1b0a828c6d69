"""Telemetry streams: source, rolling windows per unit, perturbation, counters under a watermark, alert holds, drift checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from prognos.operators.telemetry import perturb
from prognos.storage import exists, forget, stored


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream under a declared schema; TIMESTAMP_NTZ columns become TIMESTAMP, which watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which processors with timers need; a checkpoint remembers it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


class _Rolling(StatefulProcessor):
    """The units of a bucket: rows wait until the watermark has passed them, and each unit's last w - 1 released rows are kept.

    State is read, sorted and written for the bucket at once, as tables in Arrow's stream format, so that a batch costs a call for each
    bucket and not for each unit.
    """

    def __init__(self, unit: str, order: list[str], w: int) -> None:
        self.unit, self.order, self.w = unit, order, w

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for part in rows:
            self.waiting.appendList([(_packed(part[["unit", "micros", "value", *self.order]]),)])
            latest = max(int(part["micros"].max()), latest if latest is not None else int(part["micros"].max()))
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield from self._release(timerValues)

    def handleExpiredTimer(self, key: tuple[Any], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._release(timerValues)

    def _release(self, timer: Any) -> Iterator[pd.DataFrame]:
        mark = timer.getCurrentWatermarkInMs() * 1000
        parts = [_unpacked(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat(parts, ignore_index=True) if parts else None
        if rows is None or not (ready := rows["micros"] <= mark).any():
            return
        rest = rows[~ready]
        self.waiting.put([(_packed(rest),)]) if len(rest) else self.waiting.clear()
        new = rows[ready].sort_values(["micros", *self.order], kind="stable")[["unit", "micros", "value"]].assign(seq=0)
        old = _unpacked(self.held.get()[0]) if self.held.exists() else new[:0]
        both = pd.concat([old, new], ignore_index=True)
        # a unit's kept rows come before its new ones, these in order
        unit = pd.factorize(both["unit"], use_na_sentinel=False)[0]
        by = np.argsort(unit, kind="stable")
        both, unit, fresh = both.iloc[by].reset_index(drop=True), unit[by], by >= len(old)
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        size = np.diff(np.r_[first, len(unit)])
        place = np.arange(len(unit)) - np.repeat(first, size)
        both["seq"] = np.repeat(np.maximum(both["seq"].to_numpy()[first], 1), size) + place
        self.held.update((_packed(both[place >= np.repeat(size, size) - max(1, self.w - 1)]),))
        ends = np.flatnonzero(fresh & (place >= self.w - 1))
        values = both["value"].to_numpy("float64", na_value=np.nan)
        for i in range(0, len(ends), 10_000):
            at = ends[i : i + 10_000]
            out = both.iloc[at]
            win = np.lib.stride_tricks.sliding_window_view(values, self.w)[at - self.w + 1]
            yield pd.DataFrame({self.unit: out["unit"].to_numpy(), "seq": out["seq"].to_numpy(), "at": out["micros"].to_numpy(), "win": list(win)})

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    table, to = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(to, table.schema) as writer:
        writer.write_table(table)
    return to.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def rolling_windows(stream: DataFrame, unit: str, instant: str, value: str, w: int, late: str, order: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """(unit, seq, at, win): the last w values of each unit, at each row once there are so many, in the order of time whatever the order of arrival.

    A row waits until the watermark, `late` behind the newest row, has passed it, and is released then, also by a timer if its
    bucket falls silent; rows behind the watermark are dropped. Rows of one instant are ordered by `order`. Units are dealt to so many
    buckets by hash, whose state is their units' waiting rows, last w - 1 values and counters. A task holds one bucket's state, so their
    number goes with that of the rows; it can't change under one checkpoint.
    """
    names = [f"order_{i}" for i in range(len(order or []))]
    kind = stream.schema[unit].dataType.simpleString()
    bucket = F.pmod(F.xxhash64(unit), F.lit(buckets)).alias("bucket")
    rows = stream.withWatermark(instant, late).select(bucket, F.col(unit).alias("unit"), F.col(instant).alias("instant"), F.unix_micros(instant).alias("micros"), F.col(value).cast("double").alias("value"), *[F.col(c).alias(n) for c, n in zip(order or [], names, strict=True)])
    out = rows.groupBy("bucket").transformWithStateInPandas(_Rolling(unit, names, w), f"`{unit}` {kind}, seq long, at long, win array<double>", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def counters(stream: DataFrame, instant: str, labels: list[str], width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Requests by window and labels; rows later than the watermark are dropped."""
    w = F.window(instant, width, slide) if slide else F.window(instant, width)
    return stream.withWatermark(instant, late).groupBy(w.alias("w"), *labels).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("since"), *labels, "requests")


def dropped_rows(stream: DataFrame, instant: str, labels: list[str], width: str, late: int, slide: str, out: str, state: str, checkpoint: str) -> None:
    """Writes (since, labels, dropped): what `counters` drops of every micro-batch of the same source, to `out`.

    The engine drops a row from a window that ended at or before the watermark with which the batch before it closed windows, which is `late`
    seconds behind the newest row of the batches in front of that one. That is what is told here: each batch's newest instant is kept in the table `state`, by batch, so that a repeated
    batch gives the same rows.
    """

    def account(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        rows = stored(df, "batch")
        known = [r.newest for r in spark.read.parquet(state).where(F.col("batch") < i - 1).select("newest").collect() if r.newest] if exists(spark, state) else []
        mark = F.timestamp_millis(F.unix_millis(F.lit(max(known)).cast("timestamp")) - 1000 * late) if known else F.lit(None).cast("timestamp")
        w = rows.select(F.window(instant, width, slide).alias("w"), *labels)
        w.where(F.col("w.end") <= mark).groupBy(F.col("w.start").alias("since"), *labels).agg(F.count("*").alias("dropped")).write.mode("overwrite").parquet(f"{out}/batch={i}")
        rows.agg(F.max(instant).alias("newest")).write.mode("overwrite").parquet(f"{state}/batch={i}")
        forget(rows)

    each_batch(stream, account, checkpoint)


class _Hold(StatefulProcessor):
    """Begin of the series' breach, its last window, and whether the alert has fired; a timer for the alert, and one for a silent series."""

    def __init__(self, series: str, instant: str, breach: str, hold: int, silence: int) -> None:
        self.series, self.instant, self.breach, self.hold, self.silence = series, instant, breach, hold, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "breach boolean")
        self.run = handle.getValueState("run", "since long, fired boolean")

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = 0
        for part in rows:
            for at, bad in zip(part[self.instant].astype("datetime64[ms]").astype("int64"), part[self.breach], strict=True):
                self.waiting.updateValue((int(at),), (bool(bad),))
                self.handle.registerTimer(int(at) + 1)
                latest = max(latest, int(at))
        self.handle.registerTimer(latest + 1000 * self.silence)
        return iter(())

    def handleExpiredTimer(self, key: tuple[Any], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        since, fired = self.run.get() if self.run.exists() else (None, False)
        due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= mark) if self.waiting.exists() else []

        def fire(until: float) -> None:
            nonlocal fired
            if since is not None and not fired and since + 1000 * self.hold < until:
                out.append((key[0], pd.Timestamp(since, unit="ms"), pd.Timestamp(since + 1000 * self.hold, unit="ms")))
                fired = True

        for at, bad in due:
            fire(at)  # the breach has lasted up to this window
            self.waiting.removeKey((at,))
            if not bad:
                since, fired = None, False
            elif since is None:
                since, fired = at, False
                self.handle.registerTimer(at + 1000 * self.hold + 1)
        fire(mark)  # and up to the watermark: no window before it can still come
        quiet = not any(True for _ in self.waiting.keys()) and not [t for t in self.handle.listTimers() if t > mark and t != expiredTimerInfo.getExpiryTimeInMs()]
        if since is None or quiet:
            self.run.clear()
        else:
            self.run.update((since, fired))
        if out:
            yield pd.DataFrame(out, columns=[self.series, "since", "at"])

    def close(self) -> None:
        pass


def held_alerts(windows: DataFrame, series: str, instant: str, breach: str, hold: int, late: str, silence: int = 86_400) -> DataFrame:
    """(series, since, at): the alert of every breach that no window has ended within `hold` seconds of its begin; at is since + hold.

    Windows are taken in the order of time once the watermark, `late` behind the newest window, has passed them. The alert fires by a timer
    when the watermark passes its time, whether or not another window of the series comes. A series that sends nothing for `silence`
    seconds, at least `hold`, is forgotten: its next breach begins anew. State is a breach's begin and the windows that wait.
    """
    kind = windows.schema[series].dataType.simpleString()
    rows = windows.select(series, instant, breach).withWatermark(instant, late)
    return rows.groupBy(series).transformWithStateInPandas(_Hold(series, instant, breach, hold, max(silence, hold + 1)), f"`{series}` {kind}, since timestamp, at timestamp", "Append", "EventTime")


def commit(out: str, batch: int, sinks: dict[str, DataFrame]) -> None:
    """Writes one micro-batch to several sinks and then marks it: a batch counts in all of them or in none, and once however often it runs."""
    for name, df in sinks.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    spark = next(iter(sinks.values())).sparkSession
    spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{out}/committed/batch_{batch}")


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A sink's rows of the marked batches."""
    done = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/committed").select("batch").distinct()
    return spark.read.parquet(f"{out}/{name}").withColumn("batch", F.col("batch").cast("long")).join(F.broadcast(done), "batch", "left_semi")  # one row a batch


def perturbed(stream: DataFrame, columns: list[str], keys: list[str], noise: float, drop: float) -> DataFrame:
    """The batch perturbation, which is stateless."""
    return perturb(stream, columns, keys, noise, drop)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and ends."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a batch job on every micro-batch; the batch number makes it repeatable."""
    df.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def latest(updates: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Of what update mode has written, the last row of every key."""
    rest = [c for c in updates.columns if c not in {*keys, batch}]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), batch).alias("x")).select(*keys, "x.*")
