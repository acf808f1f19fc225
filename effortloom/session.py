"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, name: str = "effortloom", **conf) -> SparkSession:
    """A session with the settings the operators expect; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key even where the next step could have reused the join's partitioning
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A folder of this machine is taken only where none is
    named and the session runs in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="effortloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it as a table in the shared folder and reading that.

    A lost executor then costs a re-read only. A table is preferred over an RDD checkpoint because the plan on top of
    it starts with the true size, so small results are broadcast by the optimizer's own check, and with none of the
    constraints of the plan below, which grow without limit in a level-by-level loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
