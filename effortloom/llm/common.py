"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effortloom.session import pin

#: White space of the word and line rules: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does just that on pure ASCII and is much faster than ``translate``."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column) -> Column:
    """Words between blanks, in order; none for NULL."""
    cut = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(cut, lambda w: w != "")


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pin_python(df: DataFrame, rows_per_batch: int = 500) -> DataFrame:
    """``pin`` for a frame that runs Python over whole texts: Arrow batches of few rows keep the memory of executors and
    workers small however long the texts are. The session's own batch size is put back."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(rows_per_batch))
    try:
        return pin(df)
    finally:
        conf.set(name, before)
