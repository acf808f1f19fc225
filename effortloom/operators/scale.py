"""Feature scalers per key, with the inverse needed to bring predictions back to the target's unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ratio
from effortloom.operators.ordered import attach, counted, ordered, quantiles


def robust_scale(df: DataFrame, col: str, by: Sequence[str] = (), name: str | None = None, **kwargs) -> DataFrame:
    """(x - median) / iqr, an iqr of 0 counting as 1. ``center`` and ``width`` are kept for the inverse."""
    by = list(by)
    q = quantiles(df, by, col, {"_a": 0.25, "center": 0.5, "_b": 0.75}, **kwargs)
    width = F.col("_b") - F.col("_a")
    q = q.select(*by, "center", F.when(width == 0, F.lit(1.0)).otherwise(width).alias("width"))
    return attach(df, q, by).withColumn(name or col, (F.col(col) - F.col("center")) / F.col("width"))


def robust_unscale(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or col, F.col(col) * F.col("width") + F.col("center"))


def quantile_transform(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str = "u",
    train: str | None = None,
    bounded: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Map ``value`` to its place in the training distribution of the key: lowest 0, highest 1, ties half-way.

    ``train`` names a boolean column; rows where it is false are placed between the neighbouring training values.
    Distinct values are counted first, so only they are ordered; neighbours are found by equality on running counts.
    """
    keys = list(keys)
    weight = F.lit(1) if train is None else F.col(train).cast("int")
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.sum(weight).cast("bigint").alias("_n"))
    counts, small = counted(counts, known, keys, bounded, rows_per_task)
    placed = ordered(
        counts, keys, [value], running={"_upto": "_n"}, totals={"_size": "_n"}, bounded=small, rows_per_task=rows_per_task
    )
    n, upto, last = F.col("_n"), F.col("_upto"), F.nullif(F.col("_size") - 1, F.lit(0))
    tie = (2 * upto - n - 1) / 2 / last
    if train is None:
        inner = tie
    else:
        knots = placed.where(n > 0)
        low = knots.select(*keys, F.col(value).alias("_low"), F.col("_upto").alias("_c"))
        high = knots.select(*keys, F.col(value).alias("_high"), (F.col("_upto") - F.col("_n")).alias("_c"))
        placed = placed.withColumn("_c", upto)
        placed = attach(placed, low, [*keys, "_c"], "left")
        placed = attach(placed, high, [*keys, "_c"], "left")
        gap = ratio(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low"))
        inner = F.when(n > 0, tie).otherwise((upto - 1 + gap) / last)
    below = upto - n == 0
    above = upto == F.col("_size")
    u = F.when(below, F.lit(0.0)).when(above, F.lit(1.0)).otherwise(inner)
    return attach(df, placed.select(*keys, value, u.alias(name)), [*keys, value], "left")


def quantile_inverse(
    df: DataFrame,
    training: DataFrame,
    keys: Sequence[str],
    value: str,
    identity: Sequence[str],
    share: str,
    name: str,
    **kwargs,
) -> DataFrame:
    """Map a share in 0..1 back to the training distribution of ``value`` by linear interpolation, clamped."""
    keys = list(keys)
    knots = ordered(
        training.select(*keys, *identity, value), keys, [value, *identity], position="_i", size="_n", **kwargs
    ).select(*keys, "_i", F.col(value).alias("_v"), "_n")
    sizes = knots.groupBy(*keys).agg(F.max("_n").alias("_n"))
    spot = F.least(F.greatest(F.col(share), F.lit(0.0)), F.lit(1.0)) * (F.col("_n") - 1)
    placed = attach(df, sizes, keys).withColumn("_spot", spot).withColumn("_i", F.floor("_spot"))
    placed = attach(placed, knots.select(*keys, "_i", F.col("_v").alias("_a")), [*keys, "_i"])
    placed = placed.withColumn("_frac", F.col("_spot") - F.col("_i")).withColumn(
        "_i", F.least(F.col("_i") + 1, F.col("_n") - 1)
    )
    placed = attach(placed, knots.select(*keys, "_i", F.col("_v").alias("_b")), [*keys, "_i"])
    return placed.withColumn(name, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).drop(
        "_a", "_b", "_i", "_n", "_spot", "_frac"
    )
