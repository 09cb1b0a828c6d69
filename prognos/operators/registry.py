"""Runs, model versions and promotion as append-only tables."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.functions.scalar import higher_is_better
from prognos.storage import stored


def top_runs(metrics: DataFrame, metric: str, n: int, higher: bool) -> DataFrame:
    """The best n runs that have the metric."""
    key = F.col("value").desc() if higher else F.col("value").asc()
    return metrics.where(F.col("metric") == metric).orderBy(key, "run_id").limit(n)


def current_stages(versions: DataFrame) -> DataFrame:
    """(model, version, run_id, stage): the latest row of each version."""
    return versions.groupBy("model", "version").agg(F.max_by("run_id", "changed_at").alias("run_id"), F.max_by("stage", "changed_at").alias("stage"))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("model").agg((F.max("version") + 1).alias("next_version"))


def flatten_params(df: DataFrame, key: str, config: str, secret: str = "(?i)(key|secret|token|password)") -> DataFrame:
    """(run key, dotted key, value) of a map of maps of strings; keys that look like secrets are dropped."""
    leaves = df.select(key, F.explode(config).alias("_a", "_m")).select(key, "_a", F.explode("_m").alias("_b", "value"))
    return leaves.select(key, F.concat_ws(".", "_a", "_b").alias("key"), "value").where(~F.col("key").rlike(secret))


def shown_tags(tags: str, hidden: str) -> Column:
    """name=value of the tags whose names don't begin with the hidden prefix, comma-joined in the order of the map."""
    return F.array_join(F.transform(F.map_entries(F.map_filter(tags, lambda k, v: ~k.startswith(hidden))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def untested(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """The runs that may still be scored on the test split: those without a test row among the evaluations (run_id, split)."""
    return runs.join(evaluations.where("split = 'test'").select("run_id").distinct(), "run_id", "left_anti")


def require_untested(runs: DataFrame, evaluations: DataFrame) -> None:
    """Raises if a run has been scored on the test split before."""
    again = runs.join(evaluations.where("split = 'test'").select("run_id").distinct(), "run_id", "left_semi").select("run_id").limit(20).collect()
    if again:
        raise ValueError("already scored on the test split: " + ", ".join(str(r.run_id) for r in again))


def gate(candidates: DataFrame, margin: float = 0.02, tolerance: float = 1e-9) -> DataFrame:
    """(model, version, passes, reason) of (model, version, metric, candidate, incumbent, has_incumbent).

    Without an incumbent the gate opens; an incumbent without the metric, and a candidate without it, keep it shut.
    """
    up = higher_is_better(F.col("metric"))
    gain = F.when(up, F.col("candidate") - F.col("incumbent")).otherwise(F.col("incumbent") - F.col("candidate"))
    needed = margin * F.abs("incumbent")
    enough = gain >= needed - tolerance * F.greatest(F.abs(gain), needed)  # relative, so that it holds for metrics of any size
    reason = F.when(F.col("candidate").isNull(), "candidate_metric_missing").when(~F.col("has_incumbent"), "no_incumbent").when(F.col("incumbent").isNull(), "incumbent_metric_missing").when(enough, "improved").otherwise("not_enough")
    return candidates.select("model", "version", reason.isin("no_incumbent", "improved").alias("passes"), reason.alias("reason"))


def candidates(versions: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Every staged version beside the production version's metric of its model."""
    now = current_stages(versions)
    m = metrics.where(F.col("metric") == metric).select("run_id", "value")
    staged = now.where("stage = 'staging'").join(m, "run_id", "left").select("model", "version", F.col("value").alias("candidate"))
    prod = now.where("stage = 'production'").join(m, "run_id", "left").select("model", F.lit(True).alias("has_incumbent"), F.col("value").alias("incumbent"))
    return staged.join(prod, "model", "left").select("model", "version", F.lit(metric).alias("metric"), "candidate", "incumbent", F.coalesce("has_incumbent", F.lit(False)).alias("has_incumbent"))


def promote(versions: DataFrame, metrics: DataFrame, metric: str, now: str, margin: float = 0.02) -> DataFrame:
    """The rows to append: passing versions become production, the production versions of their models archived. None if refused."""
    passed = gate(candidates(versions, metrics, metric), margin).where("passes")
    best = passed.groupBy("model").agg(F.max("version").alias("version"))
    state = current_stages(versions)
    up = state.join(best, ["model", "version"], "left_semi").withColumn("stage", F.lit("production"))
    down = state.where("stage = 'production'").join(best.select("model"), "model", "left_semi").withColumn("stage", F.lit("archived"))
    return up.unionByName(down).withColumn("changed_at", F.lit(now).cast("timestamp"))


class VersionTable:
    """An append-only table of stage changes with numbered commits; a commit goes in only if no other came since the table was read.

    Rows are written first, and a marker file with the commit's number makes them part of the table. The marker is put in place by a
    rename, which a distributed file system refuses if the number is taken; within one process a lock does the same for local folders.
    """

    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _system(self):  # noqa: ANN202
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        return of(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), of

    def commits(self) -> list[int]:
        system, of = self._system()
        log = of(f"{self.path}/log")
        names = [f.getPath().getName() for f in system.listStatus(log)] if system.exists(log) else []
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, schema: str) -> tuple[int, DataFrame]:
        """(the last commit's number, 0 for an empty table; all rows committed up to it)."""
        done = self.commits()
        if not done:
            return 0, self.spark.createDataFrame([], schema)
        folders = [r.value for r in self.spark.read.text([f"{self.path}/log/{n:012d}" for n in done]).collect()]
        return done[-1], self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def append(self, rows: DataFrame, seen: int) -> bool:
        """Commits rows as number seen + 1; False, and nothing is kept, if that number is taken."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        system, of = self._system()
        marker, target = of(f"{self.path}/log/.{name}"), of(f"{self.path}/log/{seen + 1:012d}")
        out = system.create(marker, True)
        out.write(bytearray(f"{name}\n".encode()))
        out.close()
        with self._lock:
            won = not system.exists(target) and system.rename(marker, target)
        if not won:
            system.delete(marker, False)
            system.delete(of(f"{self.path}/data/{name}"), True)
        return won


VERSION_ROWS = "model string, version long, run_id long, stage string, changed_at timestamp"


def promote_committed(versions: VersionTable, metrics: DataFrame, metric: str, now: str, margin: float = 0.02, attempts: int = 5) -> DataFrame | None:
    """Promotes against the table as it is and commits; where another commit came first, the gate is asked again against the new production version.

    Returns the committed rows, or None if the gate refused. At any commit each model has at most one production version.
    """
    for _ in range(attempts):
        seen, known = versions.read(VERSION_ROWS)
        last = known.agg(F.max("changed_at")).first()[0]
        at = F.greatest(F.lit(now).cast("timestamp"), F.lit(last).cast("timestamp") + F.expr("interval 1 microsecond"))  # later than all it has seen
        rows = stored(promote(known, metrics, metric, now, margin).selectExpr("model", "cast(version as long) version", "cast(run_id as long) run_id", "stage").withColumn("changed_at", at), "promotion")
        if rows.isEmpty():
            return None
        if versions.append(rows, seen):
            return rows
    raise RuntimeError(f"{attempts} other commits came first")
