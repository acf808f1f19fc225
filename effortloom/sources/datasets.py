"""Release datasets as written by the export: one CSV per project and task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effortloom.operators.export import ROLE_COLUMNS

# The columns of an export file in their order; the first one is an unnamed row index.
DATASET_SCHEMA = T.StructType(
    [
        T.StructField("_index", T.IntegerType()),
        T.StructField("project", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("task", T.StringType()),
        T.StructField("t_module", T.LongType()),
        T.StructField("t_line", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ROLE_COLUMNS],
    ]
)


def read_dataset(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return (
        spark.read.schema(DATASET_SCHEMA)
        .options(header=True, enforceSchema=True, dateFormat="yyyy-MM-dd")
        .csv(path)
        .drop("_index")
    )


def read_datasets(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root/<name>/<name>_dataset_<TASK>.csv`` in one scan; name and task come from the path."""
    base = spark.read.schema(DATASET_SCHEMA).options(header=True, enforceSchema=True, dateFormat="yyyy-MM-dd")
    path = F.url_decode(F.col("_metadata.file_path"))
    return (
        base.csv(f"{root}/*/*_dataset_*.csv")
        .withColumn("repo", F.regexp_extract(path, r"/([^/]+)_dataset_[^/]+\.csv$", 1))
        .withColumn("file_task", F.regexp_extract(path, r"_dataset_([^/]+)\.csv$", 1))
        .drop("_index")
    )
