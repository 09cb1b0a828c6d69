"""Labels, sliding windows, window features, splits and scaling of run-to-failure telemetry."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prognos.functions.scalar import md5_01, md5_rank, safe_std
from prognos.operators.evaluate import quantiles_of
from prognos.operators.ordered import hash_ranks, positions, with_border
from prognos.storage import stored

#: Buckets of a hash between 0 and 1, by whose counts a quantile is found.
BUCKETS = 65_536


def add_rul(df: DataFrame, unit: str = "unit", cycle: str = "cycle") -> DataFrame:
    """Remaining life of units that ran to failure: last cycle minus cycle."""
    return df.withColumn("rul", F.max(cycle).over(Window.partitionBy(unit)) - F.col(cycle))


def add_rul_truncated(df: DataFrame, true_rul: str = "true_rul", unit: str = "unit", cycle: str = "cycle") -> DataFrame:
    """As add_rul, for units cut off `true_rul` cycles before failure."""
    if true_rul not in df.columns:
        raise ValueError(f"{true_rul} is missing")
    return add_rul(df, unit, cycle).withColumn("rul", F.col("rul") + F.col(true_rul))


def attach_by_position(df: DataFrame, labels: DataFrame, value: str, unit: str = "unit") -> DataFrame:
    """The i-th label goes to the i-th unit in ascending order. labels: pos (from 1), value. Units are placed in two passes, not in one task."""
    ranked = positions(df.select(unit).distinct(), [unit])
    return df.join(ranked.hint("merge").join(labels.hint("merge"), "pos").select(unit, value), unit)


def label_intervals(df: DataFrame, intervals: DataFrame, instant: str = "ts") -> DataFrame:
    """is_anomaly: whether the instant lies in any interval (start, end), both ends included.

    Intervals are gathered by the days they touch, so rows meet only their day's, in one equi-join that copies no row. The join
    merges; a day that many rows share is split by adaptive execution, as the interval side has one row for it.
    """
    days = intervals.select(F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_day"), F.struct("start", "end").alias("i"))
    days = days.groupBy("_day").agg(F.collect_set("i").alias("_within"))
    hit = F.exists("_within", lambda i: F.col(instant).between(i["start"], i["end"]))
    return df.withColumn("_day", F.to_date(instant)).hint("merge").join(days.hint("merge"), "_day", "left").withColumn("is_anomaly", F.coalesce(hit, F.lit(False))).drop("_day", "_within")


def framed(df: DataFrame, w: int, unit: str, cycle: str, block: int | None) -> tuple:
    """(rows, ordered window, frame of the last w rows): rows have _rn, their place in the unit, and _own, whether they are to be kept.

    Units that a task can order are framed whole. With `block`, for series too long for that, rows are placed in two passes
    and framed in blocks of so many, each with the w - 1 rows in front of it, so that a series is as many tasks as it has blocks.
    """
    if block is None:
        order = Window.partitionBy(unit).orderBy(cycle)
        rows = df.withColumns({"_rn": F.row_number().over(order), "_own": F.lit(True)})
    else:
        rows = with_border(positions(df, [cycle], [unit], "_rn"), "_rn", w - 1, block)
        order = Window.partitionBy(unit, "_block").orderBy("_rn")
    return rows, order, order.rowsBetween(-(w - 1), 0)


def sliding_windows(df: DataFrame, features: list[str], w: int, stride: int = 1, pad: bool = False, unit: str = "unit", cycle: str = "cycle", require_contiguous: bool = False, block: int | None = None) -> DataFrame:
    """Windows of w rows that never cross units, one at every stride-th row, the last row's columns kept; `win` is an array of structs.

    With pad, a unit of fewer rows gives one window at its last row, filled on the left with its first row; otherwise none. With
    require_contiguous, a unit whose cycles leave a gap is an error that names it, as its windows would span the gap unseen. With
    block, a unit is cut into blocks of so many rows, and pad has no meaning.
    """
    if pad and block:
        raise ValueError("pad is for units shorter than a window, block for long ones")
    rows, order, last = framed(df, w, unit, cycle, block)
    rows = rows.withColumn("win", F.collect_list(F.struct(*features)).over(last))
    full = (F.col("_rn") >= w) & ((F.col("_rn") - w) % stride == 0)
    if require_contiguous:
        gap = F.col(cycle) - F.lag(cycle).over(order) > 1
        rows = rows.withColumn("_own", F.when(gap, F.raise_error(F.concat(F.lit("gap in unit "), F.col(unit).cast("string"))).cast("boolean")).otherwise(F.col("_own")))
    if pad:
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(unit)))
        short = (F.col("_n") < w) & (F.col("_rn") == F.col("_n"))
        rows = rows.where(full | short).withColumn("win", F.when(short, F.concat(F.array_repeat(F.col("win")[0], (w - F.size("win")).cast("int")), "win")).otherwise(F.col("win")))
    else:
        rows = rows.where("_own").where(full)
    return rows.withColumnRenamed(cycle, "end_cycle").drop("_rn", "_n", "_own", "_block")


def flat_windows(df: DataFrame, features: list[str], w: int, unit: str = "unit", cycle: str = "cycle", block: int | None = None) -> DataFrame:
    """As sliding_windows at every row, but `v` is the time-major vector of the window, made of lags: no list of structs is gathered."""
    rows, order, _ = framed(df, w, unit, cycle, block)
    lags = {f"_l{i}_{j}": F.lag(F.col(f), i).over(order) if i else F.col(f) for i in range(w - 1, -1, -1) for j, f in enumerate(features)}
    kept = rows.select("*", *[c.cast("double").alias(n) for n, c in lags.items()]).where(F.col("_own") & (F.col("_rn") >= w))
    return kept.withColumn("v", F.array(*lags)).withColumnRenamed(cycle, "end_cycle").drop("_rn", "_own", "_block", *lags)


def window_features(df: DataFrame, features: list[str], w: int, stride: int = 1, unit: str = "unit", cycle: str = "cycle", block: int | None = None) -> DataFrame:
    """Mean, population std, min, max and slope of every feature over each window, as framed aggregates: no array is built.

    With block, a unit is cut into blocks of so many rows (`framed`).
    """
    rows, _, last = framed(df, w, unit, cycle, block)
    stats: dict[str, Column] = {}
    for f in features:
        v = F.col(f)
        stats |= {f"{f}_mean": F.avg(v).over(last), f"{f}_std": F.stddev_pop(v).over(last), f"{f}_min": F.min(v).over(last), f"{f}_max": F.max(v).over(last), f"{f}_slope": F.coalesce(F.regr_slope(v, F.col("_rn").cast("double")).over(last), F.lit(0.0))}
    rows = rows.withColumns(stats).where(F.col("_own") & (F.col("_rn") >= w) & ((F.col("_rn") - w) % stride == 0))
    return rows.withColumnRenamed(cycle, "end_cycle").drop("_rn", "_own", "_block")


def window_features_of_sizes(df: DataFrame, features: list[str], sizes: list[int], unit: str = "unit", cycle: str = "cycle") -> DataFrame:
    """As window_features at every row, of several sizes side by side: a unit is ordered once, and its rows pass through Arrow batches in
    that order. A batch takes the last rows of the one before along, so a task holds a batch and not a unit.

    `place` is the row's place in its unit; the columns that end in _w are null where it is under w.
    """
    rows, _, _ = framed(df, max(sizes), unit, cycle, None)
    names = [c for c in df.columns if c != cycle]
    held = [f"_x{i}" for i in range(len(features))]
    rows = rows.where("_own").sortWithinPartitions(unit, "_rn")  # the frame's own order
    rows = rows.select(*names, F.col(cycle).alias("end_cycle"), F.col("_rn").alias("place"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, held, strict=True)])
    stats = [f"{f}_{s}_{w}" for f in features for w in sizes for s in ("mean", "std", "min", "max", "slope")]
    plain, back, least = rows.drop(*held).schema, max(sizes) - 1, min(sizes)
    passed = plain.names

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.full((len(features), back), np.nan), np.zeros((len(features), back), bool)
        for b in filter(len, parts):
            v = np.array([b.column(x).to_numpy(zero_copy_only=False) for x in held], dtype=float)
            known = np.array([b.column(x).is_valid().to_numpy(zero_copy_only=False) for x in held])
            v, known = np.hstack([before[0], v]), np.hstack([before[1], known])
            place = b.column("place").to_numpy()
            own = np.flatnonzero(place >= least)
            out = [c.take(pa.array(own)) for c in b.select(passed).columns]
            for i in range(len(features)):
                for w in sizes:
                    at, short = own + back - w + 1, place[own] < w
                    frame = lambda a, w=w, at=at: np.lib.stride_tricks.sliding_window_view(a, w)[at]
                    out += [pa.array(x, mask=short | none) for x, none in window_statistics(frame(v[i]), frame(known[i]))]
            yield pa.RecordBatch.from_arrays(out, [*passed, *stats])
            before = v[:, len(v[0]) - back :], known[:, len(v[0]) - back :]

    return rows.mapInArrow(batches, StructType([*plain.fields, *[StructField(s, DoubleType()) for s in stats]]))


def window_statistics(v: np.ndarray, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, whether missing) of mean, population std, min, max and slope of each row of v, over what is known of it; as in SQL, NaN is the greatest number."""
    n = known.sum(1)
    none = n == 0
    many, blank = np.maximum(n, 1), np.where(known, v, np.nan)
    with np.errstate(all="ignore"):
        mean = np.where(known, v, 0.0).sum(1) / many
        off = np.where(known, v - mean[:, None], 0.0)
        t = np.arange(v.shape[1], dtype=float)
        t = np.where(known, t - (known * t).sum(1)[:, None] / many[:, None], 0.0)
        tt = (t * t).sum(1)
        slope = np.where(tt > 0, (t * off).sum(1) / np.where(tt > 0, tt, 1.0), 0.0)
        high = np.where((known & np.isnan(v)).any(1), np.nan, np.fmax.reduce(blank, 1))
        return [(mean, none), (np.sqrt((off * off).sum(1) / many), none), (np.fmin.reduce(blank, 1), none), (high, none), (slope, np.zeros(len(n), bool))]


def healthy_prefix(df: DataFrame, series: str, instant: str, flag: str, overlap: bool = False) -> DataFrame:
    """Adds in_train and in_test: train is what lies before a series' first flagged instant, test what lies after train's last one.

    With overlap, train's last instant is in test too. Series without a flagged row, or that begin with one, have neither and
    are left out.
    """
    first = df.where(flag).groupBy(series).agg(F.min(instant).alias("_first"))
    df = df.join(first, series)
    last = df.where(F.col(instant) < F.col("_first")).groupBy(series).agg(F.max(instant).alias("_last"))
    after = F.col(instant) >= F.col("_last") if overlap else F.col(instant) > F.col("_last")
    return df.join(last, series).withColumns({"in_train": F.col(instant) < F.col("_first"), "in_test": after}).drop("_first", "_last")


def _ranked_units(df: DataFrame, unit: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(units with _r, their rank by hash; units); the ranks come from the counts of hash buckets, so no task orders all units."""
    units = df.select(unit).distinct()
    return hash_ranks(units.withColumn("_h", md5_rank(unit, seed=seed)), "_h", [unit], "_r"), units


def _share(f: float) -> Column:
    return F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(float(f)), 0).cast("int"))


def split_by_unit(df: DataFrame, fraction: float = 0.2, seed: int = 42, unit: str = "unit") -> DataFrame:
    """Adds `split`: max(1, round half even(units * fraction)) units are val, chosen by a hash."""
    ranked, units = _ranked_units(df, unit, seed)
    n_val = units.agg(_share(fraction).alias("_k"))
    marked = ranked.join(F.broadcast(n_val), F.lit(True)).select(unit, F.when(F.col("_r") <= F.col("_k"), "val").otherwise("train").alias("split"))
    return df.join(marked, unit)


def split_three(df: DataFrame, val: float = 0.2, test: float = 0.2, seed: int = 42, unit: str = "unit") -> DataFrame:
    """Adds `split`: train, val or test by unit, the parts of val and test rounded half even, at least one unit each."""
    ranked, units = _ranked_units(df, unit, seed)
    sizes = units.agg(_share(val).alias("_v"), _share(test).alias("_t"))
    part = F.when(F.col("_r") <= F.col("_v"), "val").when(F.col("_r") <= F.col("_v") + F.col("_t"), "test").otherwise("train")
    return df.join(ranked.join(F.broadcast(sizes), F.lit(True)).select(unit, part.alias("split")), unit)


def split_rows(df: DataFrame, keys: list[str], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Row-wise split by a hash threshold; it leaks units between the splits and exists to show that."""
    return df.withColumn("split", F.when(md5_01(*keys, seed=seed) < fraction, "val").otherwise("train"))


def split_stratified(df: DataFrame, label: str, keys: list[str], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """A split with the fraction in every class: each class has its own hash cut-off, an exact quantile. The rows are stored once.

    Counts of the hash's buckets tell in which of them a class's cut-off lies, and only the rows there are ordered.
    """
    hashed = stored(df.withColumn("_h", md5_01(*keys, seed=seed)), "hashed")
    bucket = F.floor(F.col("_h") * BUCKETS).cast("int").alias("_b")
    counts = hashed.where("_h is not null").groupBy(label, bucket).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(label)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.lit(fraction) * (F.col("all__n") - 1)
    around = counts.withColumns({"_before": before, "all__n": F.sum("_c").over(group)}).where((F.col("_before") <= F.ceil(at)) & (F.col("_before") + F.col("_c") > F.floor(at)))
    around = stored(around.drop("_c"), "buckets")  # one or two rows for each class
    near = hashed.select(label, "_h", bucket).join(around, [label, "_b"]).groupBy(label, "_b", "_before", "all__n", "_h").agg(F.count("*").alias("_n"))
    up_to = F.col("_before") + F.sum("_n").over(Window.partitionBy(label, "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    cut = quantiles_of(near.withColumn("cum__n", up_to), "_h", "_n", [fraction], [label]).select(label, F.col("q")[0].alias("_cut"))
    return hashed.join(stored(cut, "cut"), label).withColumn("split", F.when(F.col("_h") < F.col("_cut"), "val").otherwise("train")).drop("_h", "_cut")


def fixed_sample(df: DataFrame, by: list[str], keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """k rows of every group without replacement, those with the smallest hashes."""
    order = Window.partitionBy(*by).orderBy(md5_rank(*keys, seed=seed), *keys)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def perturb(df: DataFrame, columns: list[str], keys: list[str], noise: float, drop: float, seed: int = 42) -> DataFrame:
    """Gaussian noise of the given std on the float columns and a random drop of rows, both from hashes; the same on a stream.

    Two hashes of a row make a normal number (Box and Muller).
    """
    kept = df.where(md5_01(*keys, seed=seed) >= drop)
    normal = lambda c: F.sqrt(-2 * F.log(1 - md5_01(*keys, F.lit(c), seed=seed + 1))) * F.cos(2 * math.pi * md5_01(*keys, F.lit(c), seed=seed + 2))
    return kept.withColumns({c: F.col(c) + noise * normal(c) for c in columns})


def long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, "feature", "value")


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std), population std, 0 becomes 1."""
    return long(df, [], features).groupBy("feature").agg(F.avg("value").alias("mean"), safe_std(F.stddev_pop("value")).alias("std")) if features else long(df, [], features)


def fit_conditions(df: DataFrame, features: list[str], condition: str) -> DataFrame:
    """(condition, feature, mean, std)."""
    return long(df, [condition], features).groupBy(condition, "feature").agg(F.avg("value").alias("mean"), safe_std(F.stddev_pop("value")).alias("std"))


def scale(df: DataFrame, features: list[str], scaler: DataFrame) -> DataFrame:
    """Scales by a fitted table; the few parameters go into the plan as literals. The table must hold exactly the features."""
    p = {r.feature: (r["mean"], r["std"]) for r in scaler.collect()}
    if set(p) != set(features):
        raise ValueError("the scaler was fitted on other features")
    return df.withColumns({f: (F.col(f) - F.lit(p[f][0])) / F.lit(p[f][1]) for f in features})


def normalise_conditions(df: DataFrame, features: list[str], stats: DataFrame, condition: str) -> DataFrame:
    """Scales each row by its condition's parameters; a condition without any raises."""
    wide = stats.groupBy(condition).agg(*[x for f in features for x in (F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"_{f}_mean"), F.max(F.when(F.col("feature") == f, F.col("std"))).alias(f"_{f}_std"))])
    joined = df.join(F.broadcast(wide), condition, "left")
    known = F.col(f"_{features[0]}_mean").isNotNull()
    out = {f: F.when(known, (F.col(f) - F.col(f"_{f}_mean")) / F.col(f"_{f}_std")).otherwise(F.raise_error(F.concat(F.lit("unknown condition "), F.col(condition).cast("string"))).cast("double")) for f in features}
    return joined.withColumns(out).drop(*[f"_{f}_{s}" for f in features for s in ("mean", "std")])


def constant_columns(df: DataFrame, features: list[str], limit: float = 1e-6) -> DataFrame:
    """(feature, std) of the features whose sample std is under the limit."""
    return long(df, [], features).groupBy("feature").agg(F.stddev_samp("value").alias("std")).where(F.col("std") < limit)
