"""Prediction scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_columns(y: Column, yhat: Column) -> list[Column]:
    """RMSE, mean bias (prediction minus truth), R² and row count as aggregates.
    Constant truth gives R² 1 when there is no error, else 0."""
    both = y.isNotNull() & yhat.isNotNull()
    y, error = F.when(both, y), yhat - y
    squared = F.sum(error * error)
    spread = F.count(y) * F.var_pop(y)
    return [
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("mbe"),
        F.when(spread > 0, 1 - squared / F.when(spread > 0, spread))
        .when(squared.isNull(), None)
        .otherwise(F.when(squared == 0, 1.0).otherwise(0.0))
        .alias("rsq"),
        F.count(y).alias("n"),
    ]


def evaluate_model(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*score_columns(F.col(y), F.col(yhat)))


def to_long(df: DataFrame, truth: str, models: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per prediction: (kept columns, truth, ``model``, ``yhat``)."""
    keep = keep or []
    models = models or [c for c in df.columns if c != truth and c not in keep]
    return df.select(*keep, truth, *[F.col(m).cast("double") for m in models]).unpivot([*keep, truth], models, "model", "yhat")


def compare_models(df: DataFrame, truth: str, models: list[str] | None = None, by: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Scores of all prediction columns in one pass, one row per model.
    ``complete`` keeps only rows where every prediction is present."""
    by = by or []
    models = models or [c for c in df.columns if c != truth and c not in by]
    if complete:
        df = df.dropna("any", subset=[truth, *models])
    return evaluate_model(to_long(df, truth, models, by), truth, "yhat", [*by, "model"])


def scores_wide(scores: DataFrame, models: list[str]) -> DataFrame:
    """One column per model, rows RMSE, MBE and RSQ."""
    long = scores.select("model", F.col("rmse").alias("RMSE"), F.col("mbe").alias("MBE"), F.col("rsq").alias("RSQ")).unpivot(
        ["model"], ["RMSE", "MBE", "RSQ"], "metric", "score"
    )
    return long.groupBy("metric").pivot("model", models).agg(F.first("score"))
