"""Business calendar: weekdays without holidays, nine opening hours each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Opening hours of a business day.
OPENS, CLOSES = 8, 17


def us_public_holiday(day: str) -> Column:
    """Fixed-date and nth-weekday public holidays in the United States by rule, without observed-day shifts."""
    d = F.col(day)
    month, dom, dow = F.month(d), F.dayofmonth(d), F.dayofweek(d)  # dow: 1 Sunday .. 7 Saturday
    nth = F.floor((dom - 1) / 7) + 1
    return (
        ((month == 1) & (dom == 1))
        | ((month == 7) & (dom == 4))
        | ((month == 11) & (dom == 11))
        | ((month == 12) & (dom == 25))
        | ((month == 1) & (dow == 2) & (nth == 3))
        | ((month == 2) & (dow == 2) & (nth == 3))
        | ((month == 5) & (dow == 2) & (dom > 24))
        | ((month == 9) & (dow == 2) & (nth == 1))
        | ((month == 11) & (dow == 5) & (nth == 4))
    )


def business_calendar(span: DataFrame, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """One row per day between the earliest ``first`` and the latest ``last`` of ``span``.

    ``open`` tells whether the day is a business day, ``before`` counts the business days before it. ``holidays`` is
    an optional table with a ``day`` column; without it the public holiday rules apply. The calendar bounds the size:
    one row per day, whatever the size of ``span``.
    """
    ends = span.agg(F.min(first).alias("a"), F.max(last).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    weekday = ~F.dayofweek("day").isin(1, 7)
    if holidays is None:
        days = days.withColumn("open", weekday & ~us_public_holiday("day"))
    else:
        closed = holidays.select("day", F.lit(True).alias("_closed")).distinct()
        days = (
            days.join(closed, "day", "left").withColumn("open", weekday & F.col("_closed").isNull()).drop("_closed")
        )
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.col("open").cast("bigint")
    return days.withColumn("before", F.sum(one).over(so_far) - one)


def business_hours(df: DataFrame, calendar: DataFrame, start: str, end: str, name: str = "hours") -> DataFrame:
    """Opening hours in [start, end): the difference of two running counts, found by two equality joins."""
    a = calendar.select(F.col("day").alias(start), F.col("before").alias("_from"))
    b = calendar.select(F.col("day").alias(end), F.col("before").alias("_to"))
    hours = (F.col("_to") - F.col("_from")) * (CLOSES - OPENS)
    return df.join(a, start, "left").join(b, end, "left").withColumn(name, hours).drop("_from", "_to")


def previous_date(df: DataFrame, keys: Sequence[str], order: Sequence[str], bounded: bool = False) -> DataFrame:
    """Date of the release before; the first release of a key takes the earliest date of the key."""
    from effortloom.operators.ordered import attach, ordered

    lagged = ordered(df, keys, order, previous={"_date_p": "date"}, bounded=bounded)
    first = df.groupBy(*keys).agg(F.min("date").alias("_first"))
    return attach(lagged, first, keys).withColumn("date_p", F.coalesce("_date_p", "_first")).drop("_date_p", "_first")
