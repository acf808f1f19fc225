"""Contiguous cross-validation folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.operators.ordered import ordered


def kfold_assign(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 10, bounded: bool = False, **kwargs
) -> DataFrame:
    """Add ``fold``: min(k, n) runs of neighbouring rows, the first n mod k of them one row longer."""
    placed = ordered(df, keys, order, position="_i", size="_n", bounded=bounded, **kwargs)
    i, n = F.col("_i"), F.col("_n")
    folds = F.least(F.lit(k), n)
    short = F.floor(n / folds)
    longer = n - short * folds
    cut = longer * (short + 1)
    fold = F.when(i < cut, F.floor(i / (short + 1))).otherwise(longer + F.floor((i - cut) / short))
    return placed.withColumn("fold", fold.cast("int")).drop("_i", "_n")


def training_sets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row once per fold it helps to train, marked ``fold_out``."""
    folds = df.groupBy(*keys).agg((F.max("fold") + 1).alias("_k"))
    from effortloom.operators.ordered import attach

    spread = attach(df, folds, keys).withColumn("fold_out", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return spread.where(F.col("fold_out") != F.col("fold")).drop("_k")
