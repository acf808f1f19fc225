"""Warehouse tables and parameterised SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; schema and files are read anew on every call."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def run_sql(spark: SparkSession, sql: str, folder: str | None = None, tables: Iterable[str] = (), **args) -> DataFrame:
    """Run SQL with ``:name`` parameters. Tables of ``folder`` are referred to as ``{name}`` in the text."""
    frames = {t: load(spark, folder, t) for t in tables}
    return spark.sql(sql, args=args or None, **frames)
