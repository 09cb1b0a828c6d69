"""Batch scoring: accepted windows get predictions and alerts, rejected ones a reason, and all an audit row."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prognos.functions.scalar import failure_probability, severity
from prognos.operators.quality import request_problem


def route(requests: DataFrame, expected: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    checked = requests.withColumn("reason", request_problem(F.col("names"), F.col("win"), expected, length))
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def score_rul(accepted: DataFrame, predict: Column, horizon: float, rmse: float, version: str) -> DataFrame:
    p = accepted.withColumn("prediction", predict)
    return p.withColumns({"probability": failure_probability(F.col("prediction"), horizon, rmse), "alert": F.col("prediction") <= horizon, "severity": severity(F.col("prediction"), horizon), "version": F.lit(version)})


def sensor_errors(vector: str, rebuilt: str, sensors: list[str]) -> Column:
    """Mean squared error of each sensor of a time-major window vector, as a map."""
    error = lambda k: F.aggregate(F.filter(F.zip_with(vector, rebuilt, lambda a, b: (a - b) * (a - b)), lambda _, i: i % len(sensors) == k), F.lit(0.0), lambda s, v: s + v) / (F.size(vector) / len(sensors))
    return F.create_map(*[x for k, s in enumerate(sensors) for x in (F.lit(s), error(k))])


def score_anomaly(df: DataFrame, score: Column | None, threshold: float | None, sensors: Column | None = None) -> DataFrame:
    """Adds anomaly_score, is_anomaly, sensors (errors by sensor) and a note.

    Without an anomaly model, or without a threshold, they are null with a reason and the rest still flows.
    """
    none = F.lit(None)
    if score is None or threshold is None:
        return df.withColumns({"anomaly_score": none.cast("double") if score is None else score, "is_anomaly": none.cast("boolean"), "sensors": none.cast("map<string,double>"), "note": F.lit("no anomaly model" if score is None else "no threshold")})
    return df.withColumns({"anomaly_score": score, "is_anomaly": score >= threshold, "sensors": none.cast("map<string,double>") if sensors is None else sensors, "note": none.cast("string")})


def audit(accepted: DataFrame, rejected: DataFrame, key: str, endpoint: str) -> DataFrame:
    """(key, endpoint, status, detail, version) of every request; no payload. Rejected ones met no model, so they have no version."""
    ok = accepted.select(key, F.lit(endpoint).alias("endpoint"), F.lit(200).alias("status"), F.col("severity").alias("detail"), "version")
    return ok.unionByName(rejected.select(key, F.lit(endpoint).alias("endpoint"), F.lit(422).alias("status"), F.col("reason").alias("detail"), F.lit(None).cast("string").alias("version")))


def save_bundle(path: str, model: PipelineModel, tables: dict[str, DataFrame]) -> None:
    model.write().overwrite().save(f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, tables: list[str], probe: DataFrame) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """The model and its tables; fails if a part is missing or the model refuses one probe row."""
    model = PipelineModel.load(f"{path}/model")
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    if model.transform(probe.limit(1)).select("prediction").first() is None:
        raise ValueError("the probe gave no prediction")
    return model, parts
