"""Text expressions: repository keys, version filters and metric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col, rnd

# The version patterns that decide which releases count as regular.
REGULAR_VERSION = r"^[v]{0,1}\d{1,2}\.\d{1,2}[\.\d{1,2}]{0,2}[\.\d{1,2}]{0,2}$"
LOOSE_VERSION = r"^[v]{0,1}\d{1,2}\.\d{1,2}\.\d{1,2}"
API_URL_PREFIX_LENGTH = 29


def is_regular_version(version: ColumnLike, loose: bool = False) -> Column:
    """True for versions such as v3.4.5; NULL versions are not regular."""
    return F.coalesce(as_col(version).rlike(LOOSE_VERSION if loose else REGULAR_VERSION), F.lit(False))


def repo_key(url: ColumnLike) -> Column:
    """``owner/repo`` of an API url: everything after the fixed-length prefix."""
    return F.substring(as_col(url), API_URL_PREFIX_LENGTH + 1, 2**31 - 1 - API_URL_PREFIX_LENGTH)


def repo_short(key: ColumnLike) -> Column:
    """The part of ``owner/repo`` after the slash."""
    return F.split_part(as_col(key), F.lit("/"), F.lit(2))


def format_pred(percentage: str, value: ColumnLike) -> Column:
    return F.format_string(f"Pred - PRED ({percentage}): %.2f%%", as_col(value).cast("double") * 100)


def format_metric(label: str, value: ColumnLike) -> Column:
    return F.concat(F.lit(f"{label}: "), rnd(value, 2).cast("string"))


def effort_unit(model: ColumnLike) -> Column:
    """Module effort is counted in files, everything else in lines of code."""
    return F.when(as_col(model).startswith("Module"), F.lit("Files")).otherwise(F.lit("LOC"))
