"""Row filters and column scalings computed per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ratio
from effortloom.operators.ordered import attach, quantiles


def remove_outliers(df: DataFrame, col: str, by: Sequence[str] = (), **kwargs) -> DataFrame:
    """Keep rows strictly inside the fences q1 - 1.5 iqr and q3 + 1.5 iqr of their key."""
    by = list(by)
    q = quantiles(df, by, col, {"_q1": 0.25, "_q3": 0.75}, **kwargs)
    width = 1.5 * (F.col("_q3") - F.col("_q1"))
    inside = (F.col(col) > F.col("_q1") - width) & (F.col(col) < F.col("_q3") + width)
    return attach(df, q, by).where(inside).drop("_q1", "_q3")


def normalize(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Min-max scaling; NULL for a constant column."""
    by = list(by)
    ends = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    scaled = ratio(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return attach(df, ends, by).withColumn(name or col, scaled).drop("_lo", "_hi")


def standardize(
    df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None, population: bool = False
) -> DataFrame:
    """Z-score with the sample (default) or population deviation. A constant column scales to 0 in the population
    form, whose divisor then counts as 1, and to NULL in the sample form."""
    by = list(by)
    spread = F.stddev_pop(col) if population else F.stddev_samp(col)
    stats = df.groupBy(*by).agg(F.avg(col).alias("_mean"), spread.alias("_sd"))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd")) if population else F.col("_sd")
    return attach(df, stats, by).withColumn(name or col, ratio(F.col(col) - F.col("_mean"), sd)).drop("_mean", "_sd")


def hot_encode(df: DataFrame, field: str, values: Sequence) -> DataFrame:
    """One 0/1 column per listed value of ``field``, which is dropped. The schema follows from the list alone; fields
    with values without a list belong into :func:`hot_long`."""
    flags = [F.coalesce((F.col(field) == F.lit(v)).cast("int"), F.lit(0)).alias(str(v)) for v in values]
    return df.select(*[c for c in df.columns if c != field], *flags)


def hot_long(df: DataFrame, identity: Sequence[str], field: str) -> DataFrame:
    """The sparse form for any number of values: one row per row and value that is one, ``feature`` naming it."""
    return df.where(F.col(field).isNotNull()).select(*identity, F.col(field).cast("string").alias("feature"), F.lit(1).alias("one"))


def few_missing(df: DataFrame, cols: Sequence[str], keys: Sequence[str], share: float) -> DataFrame:
    """Rows of the keys whose share of NULL cells in ``cols`` is at most ``share``."""
    table = missing_share(df, cols, keys, "_na").where(F.col("_na") <= share)
    return attach(df, table, keys).drop("_na")


def missing_share(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), name: str = "p_na") -> DataFrame:
    """Share of NULL cells in ``cols`` per key, rounded to 3 digits."""
    from effortloom.functions.numbers import rnd

    missing = sum((F.col(c).isNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNull().cast("int"))
    return df.groupBy(*keys).agg(rnd(F.avg(missing) / len(cols), 3).alias(name))


def min_rows(df: DataFrame, keys: Sequence[str], rows: int = 2) -> DataFrame:
    """Drop keys with fewer than ``rows`` rows."""
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    return attach(df, enough, keys).drop("_n")
