"""Trend and season of many series at once: a piecewise-linear trend with shrunk changepoints plus Fourier terms.

A series is first summed up by day - count, sum and sum of squares of its values -, where its rows lie. What is left of a
series is bounded by the calendar, however many rows a day holds, and one task solves the ridge system of each. The
fitted row per series is small; forecasts are column expressions on top of it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col
from effortloom.operators.ordered import attach

#: Changepoints, spread evenly over the first part of the history, and yearly Fourier pairs.
CHANGEPOINTS, CHANGE_RANGE, SEASON_PAIRS = 10, 0.8, 5
#: Ridge penalties per observation on slope changes and on season terms, and a touch of it on the slope, so that a series
#: on a single day has a flat trend.
CHANGE_PENALTY, SEASON_PENALTY, SLOPE_PENALTY = 1e-3, 1e-3, 1e-6
DAYS_PER_YEAR = 365.25


def epoch_day(date: ColumnLike) -> Column:
    return F.datediff(as_col(date), F.lit("1970-01-01").cast("date"))


def changepoint(j: int) -> float:
    """Place of changepoint ``j`` (from 1) on a history that lasts from 0 to 1."""
    return CHANGE_RANGE * j / (CHANGEPOINTS + 1)


def _features(day: np.ndarray, first: int, span: int) -> np.ndarray:
    t = (day - first) / span
    angle = 2 * np.pi * day / DAYS_PER_YEAR
    columns = [np.ones(len(t)), t]
    columns += [np.maximum(0, t - changepoint(j)) for j in range(1, CHANGEPOINTS + 1)]
    for k in range(1, SEASON_PAIRS + 1):
        columns += [np.cos(k * angle), np.sin(k * angle)]
    return np.column_stack(columns)


def _penalties() -> np.ndarray:
    return np.array([0.0, SLOPE_PENALTY] + [CHANGE_PENALTY] * CHANGEPOINTS + [SEASON_PENALTY] * 2 * SEASON_PAIRS)


def fit_trend(df: DataFrame, keys: Sequence[str], value: str, date: str = "date") -> DataFrame:
    """One row per series: first day, ``span`` of its history in days, ``coef`` (intercept, slope, slope changes, season
    terms), ``sigma`` (deviation of what they leave unexplained) and ``jump`` (mean size of a slope change).

    Least squares with ridge penalties; NULL values take no part. Penalties are per observation, so a history that is
    told twice has the same trend.
    """
    keys = list(keys)
    y = F.col(value).cast("double")
    days = df.where(F.col(value).isNotNull()).groupBy(*keys, epoch_day(date).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_q")
    )

    def solve(table: pa.Table) -> pa.Table:
        day, n, s, q = (table.column(c).to_numpy().astype(float) for c in ("_day", "_n", "_s", "_q"))
        first, span = int(day.min()), max(int(day.max() - day.min()), 1)
        x, total = _features(day, first, span), n.sum()
        system = (x.T * n) @ x / total + np.diag(_penalties())
        coef = np.linalg.solve(system, x.T @ s / total)
        hat = x @ coef
        sigma = np.sqrt(max((q - 2 * hat * s + n * hat * hat).sum() / total, 0.0))
        found = {
            "first": pa.array([first], pa.int32()), "span": pa.array([span], pa.int32()), "coef": pa.array([coef.tolist()]),
            "sigma": pa.array([float(sigma)]), "jump": pa.array([float(np.abs(coef[2 : 2 + CHANGEPOINTS]).mean())]),
        }
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, **found})

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema.fields if f.name in keys)
    schema = f"{named}, first int, span int, coef array<double>, sigma double, jump double"
    return days.groupBy(*keys).applyInArrow(solve, schema).select(*keys, "first", "span", "coef", "sigma", "jump")


def _value(day: Column) -> Column:
    t = (day - F.col("first")) / F.col("span")
    angle = day * F.lit(2 * np.pi / DAYS_PER_YEAR)

    def term(i: int) -> Column:
        return F.get("coef", F.lit(i))

    out = term(0) + term(1) * t
    for j in range(1, CHANGEPOINTS + 1):
        out = out + term(1 + j) * F.greatest(F.lit(0.0), t - F.lit(changepoint(j)))
    for k in range(1, SEASON_PAIRS + 1):
        at = 2 + CHANGEPOINTS + 2 * (k - 1)
        out = out + term(at) * F.cos(k * angle) + term(at + 1) * F.sin(k * angle)
    return out


def apply_trend(
    rows: DataFrame, model: DataFrame, keys: Sequence[str], date: str = "date", name: str = "yhat", spread: str | None = None
) -> DataFrame:
    """Point forecast of every row with a date. ``spread`` names a column for its deviation: the noise of the history and,
    beyond its end, the trends that further changepoints would give.

    Such changepoints would come as often as those of the history, at any time, with slope changes of a double
    exponential law of the mean size seen. Simulated trends at a distance h then vary by rate * 2 jump^2 * h^3 / 3, which
    is used in place of draws.
    """
    joined = attach(rows.withColumn("_day", epoch_day(date)), model, keys)
    out = joined.withColumn(name, _value(F.col("_day")))
    if spread:
        ahead = F.greatest(F.lit(0.0), (F.col("_day") - F.col("first")) / F.col("span") - 1)
        drift = F.lit(CHANGEPOINTS * 2 / 3) * F.col("jump") * F.col("jump") * ahead * ahead * ahead
        out = out.withColumn(spread, F.sqrt(F.col("sigma") * F.col("sigma") + drift))
    return out.drop("_day", "first", "span", "coef", "sigma", "jump")
