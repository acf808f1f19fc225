"""Forecasts of many series in one job: Box-Cox scale, trend with changepoints and season, back-tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col, is_nonfinite, rnd
from effortloom.operators.linear import fit_linear, predict_linear
from effortloom.operators.ordered import attach
from effortloom.operators.trend import apply_trend, fit_trend

# The grid of Box-Cox powers in tenths, and the two-sided 90 % point of the standard normal.
LAMBDA_TENTHS = range(-20, 21)
Z90 = 1.6448536269514722


def boxcox(value: ColumnLike, lam: ColumnLike) -> Column:
    x, power = as_col(value).cast("double"), as_col(lam)
    return F.when(power == 0, F.log(x)).otherwise((F.pow(x, power) - 1) / F.nullif(power, F.lit(0.0)))


def boxcox_inverse(value: ColumnLike, lam: ColumnLike) -> Column:
    """Inverse Box-Cox; NULL where the power of a negative base would be taken."""
    y, power = as_col(value).cast("double"), as_col(lam)
    base = power * y + 1
    inner = F.when(base > 0, F.pow(base, 1 / F.nullif(power, F.lit(0.0))))
    return F.when(power == 0, F.exp(y)).otherwise(inner)


def boxcox_lambda(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The power on the grid with the highest profile likelihood of ``value + 1`` per series; 1 for a constant one.

    Rows are summed for every power where they lie; one row per series and power is shuffled.
    """
    keys = list(keys)
    x = F.col(value).cast("double") + 1
    grid = F.explode(F.array(*[F.lit(i / 10) for i in LAMBDA_TENTHS])).alias("lam")
    fits = (
        df.where(F.col(value).isNotNull())
        .select(*keys, x.alias("_x"), grid)
        .groupBy(*keys, "lam")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.log("_x")).alias("_logs"),
            F.var_pop(boxcox("_x", "lam")).alias("_var"),
            (F.min("_x") == F.max("_x")).alias("_flat"),
        )
    )
    likelihood = (F.col("lam") - 1) * F.col("_logs") - F.col("_n") / 2 * F.log("_var")
    return fits.groupBy(*keys).agg(
        F.when(F.bool_or("_flat"), F.lit(1.0))
        .otherwise(F.max_by("lam", F.when(~F.col("_flat"), likelihood)))
        .alias("lam")
    )


def future_months(df: DataFrame, keys: Sequence[str], months: int, date: str = "date") -> DataFrame:
    """The next ``months`` month-ends after the last date of each series."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    skip = F.when(F.col("_last") < F.last_day("_last"), F.lit(0)).otherwise(F.lit(1))
    step = F.explode(F.sequence(F.lit(0), F.lit(months - 1)))
    return last.select(*keys, "_last", skip.alias("_skip"), step.alias("_step")).select(
        *keys, F.last_day(F.add_months(F.trunc("_last", "month"), F.col("_step") + F.col("_skip"))).alias(date)
    )


def forecast_series(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    months: int,
    date: str = "date",
    undo_shift: bool = False,
    interval: bool = False,
) -> DataFrame:
    """History dates and the next month-ends with ``yhat`` in the unit of ``value`` (plus one unless ``undo_shift``).

    Values outside the range of the inverse take the mean of the last ``months - 12`` forecasts of the series, and a
    constant series forecasts itself. ``interval`` adds the 90 % band, which widens with the distance from the history.
    """
    keys = list(keys)
    lams = boxcox_lambda(df, keys, value)
    scaled = attach(df.select(*keys, date, value), lams, keys).withColumn("_z", boxcox(F.col(value) + 1, "lam"))
    model = fit_trend(scaled, keys, "_z", date)
    rows = df.select(*keys, date).distinct().unionByName(future_months(df, keys, months, date))
    fitted = attach(apply_trend(rows, model, keys, date, "_zhat", "_spread"), lams, keys)
    shift = 1 if undo_shift else 0
    back = fitted.withColumn("_raw", boxcox_inverse("_zhat", "lam") - shift)
    latest = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    tail = (
        back.withColumn("_age", F.row_number().over(latest))
        .where(F.col("_age") <= max(months - 12, 1))
        .groupBy(*keys)
        .agg(F.avg("_raw").alias("_fill"))
    )
    out = attach(back, tail, keys).withColumn("yhat", F.coalesce("_raw", "_fill"))
    kept = [*keys, date, "yhat"]
    if interval:
        for name, sign in (("yhat_lower", -1.0), ("yhat_upper", 1.0)):
            out = out.withColumn(name, boxcox_inverse(F.col("_zhat") + sign * Z90 * F.col("_spread"), "lam") - shift)
            kept.append(name)
    return out.select(*kept)


def forecast_inputs(df: DataFrame, keys: Sequence[str], variables: Sequence[str], months: int, date: str = "date") -> DataFrame:
    """Forecasts of several variables side by side: one job over the long form, then back to columns."""
    keys = list(keys)
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("val")) for v in variables]))
    long = df.select(*keys, date, cells.alias("_c")).select(*keys, date, "_c.*")
    hats = forecast_series(long, [*keys, "variable"], "val", months, date)
    return hats.groupBy(*keys, date).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("yhat"))).alias(v) for v in variables]
    )


def forecast_effort(
    df: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    effort: str,
    months: int,
    date: str = "date",
    team_size: float | None = None,
    team_column: str = "t",
) -> DataFrame:
    """Forecast the drivers, then score the effort model fitted on the history: single precision, 0 for anything
    not finite, 2 digits. A fixed ``team_size`` replaces the forecast of ``team_column``."""
    drivers = forecast_inputs(df, keys, variables, months, date)
    if team_size is not None:
        drivers = drivers.withColumn(team_column, F.lit(float(team_size)))
    clean = {
        v: F.when(is_nonfinite(v) | F.col(v).isNull(), F.lit(0.0)).otherwise(F.col(v).cast("float").cast("double"))
        for v in variables
    }
    model = fit_linear(df, keys, variables, effort)
    scored = predict_linear(drivers.withColumns(clean), model, keys, variables, effort)
    return scored.withColumn(effort, rnd(effort, 2))


def backtest(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    date: str = "date",
    initial: int = 1825,
    period: int = 365,
    horizon: int = 365,
    name: str = "yhat",
) -> DataFrame:
    """Rolling origin: cutoffs every ``period`` days back from ``horizon`` days before the end, each with at least
    ``initial`` days of history; every cutoff fits its own trend and predicts the next ``horizon`` days.

    Every (series, cutoff) is a key of the same fit. The number of cutoffs is bounded by the calendar.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    steps = F.floor((F.datediff("_b", "_a") - horizon - initial) / F.lit(period)).cast("int")
    cutoffs = (
        ends.withColumn("_steps", steps)
        .where("_steps >= 0")
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
        .select(*keys, F.date_sub("_b", F.lit(horizon) + F.col("_j") * period).alias("cutoff"))
    )
    per_series = cutoffs.groupBy(*keys).agg(F.collect_set("cutoff").alias("_cuts"))
    rows = attach(df, per_series, keys).withColumn("cutoff", F.explode("_cuts")).drop("_cuts")
    group = [*keys, "cutoff"]
    model = fit_trend(rows.where(F.col(date) <= F.col("cutoff")), group, value, date)
    ahead = rows.where((F.col(date) > F.col("cutoff")) & (F.col(date) <= F.date_add("cutoff", horizon)))
    return apply_trend(ahead, model, group, date, name)


def constant_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Whether a series never changes, and the value it then forecasts for itself."""
    return df.groupBy(*keys).agg(
        (F.min(value) == F.max(value)).alias("constant"),
        F.when(F.min(value) == F.max(value), F.min(value)).alias("own_forecast"),
    )
