"""Estimated savings percentage: external effort relative to core effort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col, ratio, rnd
from effortloom.operators.ordered import attach
from effortloom.operators.summary import row_mean_var


def esp_sums(df: DataFrame, keys: Sequence[str], effort: str = "effort", role: str = "role") -> DataFrame:
    """Effort of core contributors (incurred) and of external contributors (saved)."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(role) == "CC", F.col(effort))), F.lit(0)).cast("double").alias("effort_incurred"),
        F.coalesce(F.sum(F.when(F.col(role) == "EC", F.col(effort))), F.lit(0)).cast("double").alias("effort_saved"),
    )


def net_gain(incurred: ColumnLike, saved: ColumnLike) -> Column:
    return rnd(as_col(saved) - as_col(incurred), 2)


def esp(incurred: ColumnLike, saved: ColumnLike) -> Column:
    """(gain + incurred) / incurred - 1 to 3 digits; the gain itself where nothing was incurred."""
    spent, gain = as_col(incurred), net_gain(incurred, saved)
    return F.when(spent == 0, rnd(gain, 3)).otherwise(rnd(ratio(gain + spent, spent) - 1, 3))


def annualized(value: ColumnLike, years: float) -> Column:
    """Yearly rate from the rounded ESP; NULL below -100 %."""
    growth = 1 + as_col(value)
    return F.when(growth >= 0, rnd(F.pow(growth, F.lit(1.0 / years)) - 1, 3))


def with_esp(df: DataFrame, years: float = 3, incurred: str = "effort_incurred", saved: str = "effort_saved", prefix: str = "") -> DataFrame:
    return df.withColumns(
        {f"{prefix}net_saved": net_gain(incurred, saved), f"{prefix}esp": esp(incurred, saved)}
    ).withColumn(f"{prefix}annualized_esp", annualized(f"{prefix}esp", years))


def esp_table(df: DataFrame, keys: Sequence[str], years: float = 3) -> DataFrame:
    """The published table: project, model and five measures."""
    full = with_esp(df, years)
    return full.select(
        *keys,
        F.col("effort_incurred").alias("Effort_Incurred"),
        F.col("effort_saved").alias("Effort_Saved"),
        F.col("net_saved").alias("Net_Effort_Saved"),
        F.col("esp").alias("ESP"),
        F.col("annualized_esp").alias("Annualized_ESP"),
    )


def savings(effort_cc: ColumnLike, cost_cc: ColumnLike, effort_ec: ColumnLike) -> Column:
    """What the external effort would have cost at the core rate; NULL without core effort."""
    return ratio(cost_cc, effort_cc) * as_col(effort_ec)


def cost_esp(df: DataFrame, keys: Sequence[str], parts: Sequence[str], years: float = 3) -> DataFrame:
    """ESP on cost. ``df`` has one row per key and part (task) with effort_cc, effort_ec, cost_cc, cost_ec.

    A part without core effort keeps its own external cost. When any cost was incurred the total is re-priced at the
    total core rate.
    """
    priced = df.withColumn("_saved", F.coalesce(savings("effort_cc", "cost_cc", "effort_ec"), F.col("cost_ec")))
    sums = priced.groupBy(*keys).agg(
        F.sum("effort_cc").alias("_ecc"),
        F.sum("effort_ec").alias("_eec"),
        F.sum("cost_cc").alias("cost_incurred"),
        F.sum("_saved").alias("_sum"),
    )
    total = F.when(F.col("cost_incurred") > 0, savings("_ecc", "cost_incurred", "_eec")).otherwise(F.col("_sum"))
    out = sums.withColumn("cost_saved", F.coalesce(total, F.col("_sum"))).drop("_ecc", "_eec", "_sum")
    return with_esp(out, years, "cost_incurred", "cost_saved", "cost_")


def esp_join(left: DataFrame, right: DataFrame, key: str = "project", suffix: str = "_line") -> DataFrame:
    """Left join of two result tables; columns of the right one carry a suffix when the name is taken."""
    renamed = right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key])
    return attach(left, renamed, [key], "left")


def esp_agreement(joined: DataFrame, a: str, b: str, threshold: float = 0.04) -> DataFrame:
    """Mean and variance of the two estimates per project, and whether they agree within ``threshold``."""
    mean, variance = row_mean_var(a, b)
    return joined.withColumns({"esp_mean": mean, "esp_variance": variance}).withColumn(
        "agrees", F.col("esp_variance") <= threshold
    )
