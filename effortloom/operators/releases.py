"""Releases: which one a commit belongs to, what it contains, and the totals up to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortloom.operators.ordered import ordered

SERIES_ORDER = ("date", "t_line", "version")


def assign_release(commits: DataFrame, releases: DataFrame, key: str = "project", date: str = "date") -> DataFrame:
    """Give every commit the first release of its project dated on or after the commit; NULL when none follows.

    Commits are never sorted. The search runs over the distinct days of a project, which the calendar bounds, and
    the answer per day is joined back on equality.
    """
    tagged = releases.groupBy(key, date).agg(F.min("version").alias("_version"))
    days = commits.select(key, date).distinct().withColumn("_version", F.lit(None).cast("string"))
    # Backwards in time, so that the frame grows row by row instead of being walked anew for every day.
    later = (
        Window.partitionBy(key)
        .orderBy(F.col(date).desc(), F.col("_version").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        days.unionByName(tagged)
        .withColumn("version", F.last("_version", ignorenulls=True).over(later))
        .where(F.col("_version").isNull())
        .select(key, date, "version")
    )
    return commits.join(found, [key, date], "left")


def tag_pairs(tags: DataFrame, key: str = "project", bounded: bool = False) -> DataFrame:
    """Consecutive releases (from, to) of a project; the first release opens no pair."""
    paired = ordered(tags, [key], ["date", "version"], previous={"from_version": "version"}, bounded=bounded)
    return paired.where(F.col("from_version").isNotNull()).withColumnRenamed("version", "to_version")


def release_effort(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files and lines touched between two releases, summed over the commits in between."""
    return changes.groupBy(*keys).agg(F.sum("e_module").alias("e_module"), F.sum("e_line").alias("e_line"))


def release_paths(changes: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Files touched between two releases when a file changed by several commits counts once."""
    return changes.groupBy(*keys).agg(F.countDistinct(path).alias("e_module"), F.sum("lines").alias("e_line"))


def release_totals(snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracked files and their lines at each release, from a table of one row per release and file."""
    return snapshot.groupBy(*keys).agg(F.count(F.lit(1)).alias("t_module"), F.sum("lines").alias("t_line"))


def running_totals(releases: DataFrame, key: str = "project", bounded: bool = False) -> DataFrame:
    """Totals up to each release from the effort of the releases so far."""
    return ordered(
        releases, [key], ["date", "version"], running={"t_module": "e_module", "t_line": "e_line"}, bounded=bounded
    )


def lag_totals(df: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Totals of the previous release."""
    return ordered(
        df, keys, SERIES_ORDER, previous={"t_module_p": "t_module", "t_line_p": "t_line"}, bounded=bounded
    )


def quarterly_rollup(df: DataFrame, measures: Sequence[str], date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.year(date).alias("year"), F.quarter(date).alias("quarter")).agg(
        *[F.sum(m).alias(m) for m in measures]
    )


def yearly_totals(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], years: int | None = None, date: str = "date"
) -> DataFrame:
    """Sums per year; with ``years`` only the last ``years + 1`` years of each key."""
    sums = df.groupBy(*keys, F.year(date).alias("year")).agg(*[F.sum(m).alias(m) for m in measures])
    if years is None:
        return sums
    latest = Window.partitionBy(*keys).orderBy(F.col("year").desc())  # one row per calendar year
    return sums.withColumn("_age", F.row_number().over(latest)).where(F.col("_age") <= years + 1).drop("_age")
