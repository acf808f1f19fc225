"""Cost of a release: opening hours since the last one, times the people its effort stands for, times the wage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col, ratio, rnd
from effortloom.operators.calendar import business_hours, previous_date
from effortloom.operators.ordered import attach

# Fixed value: how many of the latest releases define the average effort.
TAIL_RELEASES = 30


def min_contrib(contributors: ColumnLike, effort: ColumnLike) -> Column:
    """Effort without a counted contributor stands for one contributor."""
    people = as_col(contributors)
    return F.when((people == 0) & (as_col(effort) > 0), F.lit(1)).otherwise(people)


def calculate_contribs(effort: ColumnLike, average: ColumnLike, contributors: ColumnLike) -> Column:
    """People the effort stands for: effort over average effort per person, at most the people counted."""
    share = F.least(ratio(effort, average), as_col(contributors).cast("double"))
    return F.when(as_col(average) == 0, F.lit(0.0)).otherwise(rnd(share, 2))


def tail_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, rows: int = TAIL_RELEASES
) -> DataFrame:
    """Mean of the last ``rows`` rows of each key. The rank filter is applied before the shuffle as well, so only the
    last rows of each task travel."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    last = df.select(*keys, *order, F.col(value).alias("_v")).withColumn("_rn", F.row_number().over(latest))
    return last.where(F.col("_rn") <= rows).groupBy(*keys).agg(F.avg("_v").alias(name))


def average_effort(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], effort: str, contributors: str, name: str = "avg_effort"
) -> DataFrame:
    """Effort per contributor: mean effort of the latest releases over the mean number of contributors."""
    tail = tail_mean(df, keys, order, effort, "_tail")
    people = df.groupBy(*keys).agg(F.avg(contributors).alias("_people"))
    return attach(tail, people, keys).select(*keys, ratio("_tail", "_people").alias(name))


def release_costs(
    df: DataFrame,
    calendar: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    effort: str,
    contributors: str,
    hourly_wage: float = 100.0,
    bounded: bool = False,
) -> DataFrame:
    """Add hours since the last release, equivalent contributors, contributor gap, billed hours and cost."""
    dated = business_hours(previous_date(df, keys, order, bounded), calendar, "date_p", "date", "hours_diff")
    floored = dated.withColumn(contributors, min_contrib(contributors, effort))
    average = average_effort(floored, keys, order, effort, contributors)
    return (
        attach(floored, average, keys)
        .withColumn("avg_contribs", calculate_contribs(effort, "avg_effort", contributors))
        .withColumn("contrib_diff", rnd(F.col(contributors) - F.col("avg_contribs"), 2))
        .withColumn("billed_hours", rnd(F.col("hours_diff") * F.col("avg_contribs"), 2))
        .withColumn("cost", rnd(F.col("billed_hours") * F.lit(float(hourly_wage)), 2))
    )
