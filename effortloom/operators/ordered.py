"""Row order inside a key: positions, previous values, running sums and everything that follows from them.

A window over a key sorts the whole key in one task. That is fine for a release series (a few hundred rows) and wrong
for a key that holds a third of a large table, so every function here first measures the largest key. Below the limit
a plain window runs. Above it the rows are range-partitioned by key *and* order, pinned, numbered inside each range,
and then shifted by the totals of the earlier ranges of the same key - a table of one row per range and key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortloom.session import pin

ROWS_PER_TASK = 2_000_000


def same_key(left: str, right: str, keys: Sequence[str]):
    """Null-safe equality on every key of two aliased frames."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-key table back to its rows; NULL keys match. No hint: a small table is broadcast by the
    optimizer's own size check and a hot key is split by the adaptive skew join. Without keys the table is the single
    row of a global aggregate."""
    if not keys:
        return df.crossJoin(F.broadcast(table))
    new = [c for c in table.columns if c not in keys]
    return (
        df.alias("l")
        .join(table.alias("r"), same_key("l", "r", keys), how)
        .select("l.*", *[F.col(f"r.`{c}`") for c in new])
    )


def fits_in_task(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> bool:
    """Whether the largest key has few enough rows for one task: a scan of the key columns with map-side counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0]
    return largest is None or largest <= (rows_per_task or ROWS_PER_TASK)


def counted(
    counts: DataFrame, rows: DataFrame, keys: Sequence[str], bounded: bool = False, rows_per_task: int | None = None
) -> tuple[DataFrame, bool]:
    """Prepare a table of distinct values for ordering: is any key of it too large for a task?

    Keys with few rows have few values, which the rows answer without the shuffle that counts values. Otherwise the
    counted values are pinned, since they are read again by the ordering.
    """
    if bounded or fits_in_task(rows, keys, rows_per_task):
        return counts, True
    return pin(counts), False


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    position: str | None = None,
    previous: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    size: str | None = None,
    bounded: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add order-dependent columns.

    ``position`` 0-based index; ``previous`` {new: column} value of the row before; ``running`` {new: column} sum up
    to and including the row; ``totals`` {new: column} sum over the key; ``size`` rows of the key. ``order`` must
    leave no ties that matter. ``bounded=True`` is for keys whose size is limited by construction.
    """
    keys, order = list(keys), list(order)
    previous, running, totals = dict(previous or {}), dict(running or {}), dict(totals or {})
    limit = rows_per_task or ROWS_PER_TASK
    if not bounded:
        largest, rows = (
            df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        )
        if largest is not None and largest > limit:
            parts = math.ceil(rows / limit) + 1
            return _ordered_ranges(df, keys, order, position, previous, running, totals, size, parts)
    rank = Window.partitionBy(*keys).orderBy(*order)
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    added = {}
    if position:
        added[position] = F.row_number().over(rank) - 1
    for new, old in previous.items():
        added[new] = F.lag(old).over(rank)
    for new, old in running.items():
        added[new] = F.sum(F.coalesce(F.col(old), F.lit(0))).over(upto)
    for new, old in totals.items():
        added[new] = F.sum(F.coalesce(F.col(old), F.lit(0))).over(whole)
    if size:
        added[size] = F.count(F.lit(1)).over(whole)
    return df.withColumns(added)


def _ordered_ranges(df, keys, order, position, previous, running, totals, size, parts):
    source = df.columns
    ranged = pin(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    rank = Window.partitionBy(*keys, "_range").orderBy(*order)
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {"_pos": F.row_number().over(rank) - 1}
    for new, old in previous.items():
        local[f"_prev_{new}"] = F.lag(old).over(rank)
    for new, old in running.items():
        local[f"_run_{new}"] = F.sum(F.coalesce(F.col(old), F.lit(0))).over(upto)
    rows = ranged.withColumns(local)

    sums = {f"_sum_{new}": old for new, old in {**running, **totals}.items()}
    ends = ranged.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.coalesce(F.col(old), F.lit(0))).alias(name) for name, old in sums.items()],
        *[F.max_by(F.struct(F.col(old)), F.struct(*order)).alias(f"_last_{new}") for new, old in previous.items()],
    )
    across = Window.partitionBy(*keys).orderBy("_range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = ends.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("_size"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in running],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"_tot_{n}") for n in totals],
        *[F.lag(f"_last_{n}").over(across)[old].alias(f"_in_{n}") for n, old in previous.items()],
    )
    joined = attach(rows, carry, [*keys, "_range"])
    out = [F.col(c) for c in source]
    if position:
        out.append((F.col("_pos") + F.col("_base")).alias(position))
    for new in previous:
        out.append(F.when(F.col("_pos") == 0, F.col(f"_in_{new}")).otherwise(F.col(f"_prev_{new}")).alias(new))
    for new in running:
        out.append((F.col(f"_run_{new}") + F.col(f"_off_{new}")).alias(new))
    for new in totals:
        out.append(F.col(f"_tot_{new}").alias(new))
    if size:
        out.append(F.col("_size").alias(size))
    return joined.select(*out)


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, bounded: bool = False, rows_per_task: int | None = None
) -> DataFrame:
    """One row per distinct value with its copies ``n``, the rows up to it ``upto`` and the key size ``size``.

    Copies collapse before any ordering, so a value that fills a third of the table is one row here.
    """
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    counts, small = counted(counts, known, keys, bounded, rows_per_task)
    return ordered(
        counts, keys, [value], running={"upto": "n"}, totals={"size": "n"}, bounded=small, rows_per_task=rows_per_task
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], **kwargs
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per entry of ``probabilities``."""
    counts = value_counts(df, keys, value, **kwargs)
    picks = []
    for name, p in probabilities.items():
        spot = (F.col("size") - 1) * F.lit(float(p))
        low = F.floor(spot)
        high = F.least(low + 1, F.col("size") - 1)

        def at(index):
            inside = (index < F.col("upto")) & (index >= F.col("upto") - F.col("n"))
            return F.max(F.when(inside, F.col(value)))

        picks += [at(low).alias(f"_a_{name}"), at(high).alias(f"_b_{name}"), F.max(spot - low).alias(f"_f_{name}")]
    return counts.groupBy(*keys).agg(*picks).select(
        *keys,
        *[
            (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", **kwargs) -> DataFrame:
    """One row per distinct value with its average rank (1-based, ties share) and its copies ``n``."""
    return value_counts(df, keys, value, **kwargs).select(
        *keys, value, "n", "size", (F.col("upto") - (F.col("n") - 1) / 2).alias(name)
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", **kwargs) -> DataFrame:
    """Add the average rank of ``value`` within its key to every row; NULL values get a NULL rank."""
    ranks = mid_ranks(df, keys, value, name, **kwargs).select(*keys, value, name)
    return attach(df, ranks, [*keys, value], "left")
