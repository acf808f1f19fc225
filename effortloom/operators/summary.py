"""Descriptive statistics per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col, rnd
from effortloom.operators.ordered import attach, quantiles

# Fixed value: two-sided 95 % point of the standard normal.
Z95 = 1.959963984540054


def describe(df: DataFrame, value: str, keys: Sequence[str] = (), **kwargs) -> DataFrame:
    """count, mean, std, min, quartiles and max; quartiles are exact and interpolated."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return attach(moments, quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, **kwargs), keys)


def sample_stats(df: DataFrame, value: str, keys: Sequence[str] = (), **kwargs) -> DataFrame:
    """mean, median, std, min and max, each rounded to 2 digits."""
    full = describe(df, value, keys, **kwargs)
    names = {"mean": "mean", "q50": "median", "std": "std", "min": "min", "max": "max"}
    return full.select(*keys, "count", *[rnd(c, 2).alias(n) for c, n in names.items()])


def normal_ci(df: DataFrame, value: str, keys: Sequence[str] = (), columns: int = 1) -> DataFrame:
    """95 % interval of the mean, from the mean and deviation rounded to 2 digits. ``columns`` multiplies the row
    count, for callers that count cells instead of rows."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(F.lit(1)).alias("n")
    )
    half = Z95 * rnd("_s", 2) / F.sqrt(F.col("n") * columns)
    return stats.select(*keys, "n", (rnd("_m", 2) - half).alias("low"), (rnd("_m", 2) + half).alias("high"))


def row_mean_var(a: ColumnLike, b: ColumnLike) -> tuple[Column, Column]:
    """Mean and sample variance of two values of one row."""
    x, y = as_col(a), as_col(b)
    return (x + y) / 2, (x - y) * (x - y) / 2


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the last bin is closed."""
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    raw = F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins)
    spot = F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = attach(df.where(F.col(value).isNotNull()), ends, keys).groupBy(*keys, spot.alias("bin"))
    return counted.agg(F.count(F.lit(1)).alias("n"))


def boxplot_stats(df: DataFrame, value: str, keys: Sequence[str], **kwargs) -> DataFrame:
    """Quartiles and whiskers, the whiskers being the outermost values inside the 1.5 iqr fences."""
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **kwargs)
    width = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - width, F.col("q3") + width)
    whiskers = (
        attach(df, q, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return attach(q, whiskers, keys)


def all_same(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Whether every value of the key is the same."""
    return df.groupBy(*keys).agg((F.min(value) == F.max(value)).alias("all_same"))
