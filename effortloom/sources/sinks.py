"""Writers: partitioned exports, appended results and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "csv", salt: int = 1, mode: str = "overwrite") -> None:
    """One folder per project and task. ``salt`` spreads each key over that many writers, so that one large project
    neither fills a single task nor ends in a single file."""
    spread = [F.pmod(F.xxhash64(*df.columns), F.lit(salt))] if salt > 1 else []
    writer = df.repartition(*keys, *spread).write.mode(mode).partitionBy(*keys)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append part files; the commit protocol makes each append whole, so writers need no lock."""
    writer = df.write.mode("append")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def insert_into(df: DataFrame, table: str) -> None:
    """Create the table when absent, then append by column name."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df.select(*spark.table(table).columns).write.insertInto(table)
    else:
        df.write.format("parquet").saveAsTable(table)


def write_report(df: DataFrame, path: str, keys: Sequence[str], value: str = "value", mode: str = "overwrite") -> None:
    """A text file tree of the report lines, one folder per key."""
    df.select(*keys, value).repartition(*keys).write.mode(mode).partitionBy(*keys).text(path)
