"""Accuracy of predictions per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col, percent_error, ratio, rnd


def error_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    gap = F.col(y) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse")
    )


def r_squared(y: ColumnLike, predicted: ColumnLike) -> Column:
    """1 - SSE / SST. A constant target scores 1 when every prediction hits it and 0 otherwise."""
    target, guess = as_col(y), as_col(predicted)
    sse = F.sum((target - guess) * (target - guess))
    constant = F.min(target) == F.max(target)
    sst = F.var_pop(target) * F.count(target)
    return F.when(constant, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - ratio(sse, sst))


def r_squared_adj(r2: ColumnLike, n: ColumnLike, k: int) -> Column:
    """Adjusted for ``k`` predictors; unchanged when n - k = 1."""
    score, rows = as_col(r2), as_col(n)
    return F.when(rows - k == 1, score).otherwise(1 - ratio((1 - score) * (rows - 1), rows - k - 1))


def pred_score(error: ColumnLike, limit: float) -> Column:
    """Share of known percent errors strictly below ``limit``, rounded to 2 digits."""
    value = as_col(error)
    return rnd(ratio(F.count_if(value < F.lit(limit)), F.count(value)), 2)


def performance_table(
    predictions: DataFrame,
    keys: Sequence[str],
    k: int,
    y: str = "y",
    predicted: str = "predicted",
    fitted: str = "fitted",
    zero: str = "absolute",
) -> DataFrame:
    """Row count, in-sample R2 (from ``fitted``) and the errors of the cross-validated ``predicted``."""
    gap = F.col(y) - F.col(predicted)
    base = predictions.withColumn("_pe", percent_error(y, predicted, zero)).groupBy(*keys).agg(
        rnd(r_squared(y, fitted), 2).alias("r_squared"),
        F.count(F.lit(1)).alias("t_records"),
        rnd(F.avg(F.abs(gap)), 2).alias("mae"),
        rnd(F.avg(gap * gap), 2).alias("mse"),
        rnd(F.sqrt(F.avg(gap * gap)), 2).alias("rmse"),
        pred_score("_pe", 0.25).alias("pred_25"),
        pred_score("_pe", 0.50).alias("pred_50"),
    )
    return base.withColumn("r_squared_adj", rnd(r_squared_adj("r_squared", "t_records", k), 2))


def best_model(scores: DataFrame, keys: Sequence[str], score: str, model: str = "model") -> DataFrame:
    """The model with the highest score per key; the smaller name on ties."""
    top = scores.groupBy(*keys).agg(F.max(F.struct(F.col(score))).alias("_top"))
    from effortloom.operators.ordered import attach

    return (
        attach(scores, top, keys)
        .where(F.col(score) == F.col("_top")[score])
        .groupBy(*keys)
        .agg(F.min(model).alias(model), F.first(score).alias(score))
    )
