"""Rounding, safe division and non-finite handling as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rnd(value: ColumnLike, digits: int = 6) -> Column:
    """Half-even rounding on the scaled double, the rule numpy and pandas use; never yields a negative zero."""
    scale = float(10**digits)
    return F.rint(as_col(value).cast("double") * scale) / scale + F.lit(0.0)


def ratio(top: ColumnLike, bottom: ColumnLike) -> Column:
    """Double division that yields NULL, not an error, for a zero divisor."""
    return as_col(top).cast("double") / F.nullif(as_col(bottom).cast("double"), F.lit(0.0))


def is_nonfinite(value: ColumnLike) -> Column:
    number = as_col(value).cast("double")
    return F.isnan(number) | (F.abs(number) == F.lit(float("inf")))


def zero_nonfinite(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace NaN, both infinities and NULL by 0 in ``cols``."""
    return df.withColumns(
        {c: F.when(is_nonfinite(c) | F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in cols}
    )


def log_transform(value: ColumnLike) -> Column:
    return F.log1p(as_col(value).cast("double"))


def reverse_log_transform(value: ColumnLike) -> Column:
    return F.expm1(as_col(value).cast("double"))


def log_transform_numeric(df: DataFrame) -> DataFrame:
    """``log1p`` of every numeric column, the others unchanged."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return df.select(*[log_transform(c).alias(c) if t in numeric else F.col(c) for c, t in df.dtypes])


def percent_error(observed: ColumnLike, predicted: ColumnLike, zero: str = "absolute") -> Column:
    """|observed - predicted| / observed, rounded to 2 digits, under one of three rules for observed = 0.

    ``absolute``: the error is |predicted|. ``zero``: the error is 0. ``infinite``: a hit is 0, a miss infinity.
    """
    y, p = as_col(observed).cast("double"), as_col(predicted).cast("double")
    otherwise = rnd(F.abs(y - p) / F.nullif(y, F.lit(0.0)), 2)
    if zero == "absolute":
        return F.when(y == 0, F.abs(p)).otherwise(F.abs(otherwise))
    if zero == "zero":
        return F.when(y == 0, F.lit(0.0)).otherwise(otherwise)
    if zero == "infinite":
        return F.when((y == 0) & (p == 0), F.lit(0.0)).when(y == 0, F.lit(float("inf"))).otherwise(otherwise)
    raise ValueError(f"unknown zero rule {zero!r}")
