"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortloom.llm import lines, mixing, packing, quality, simhash
from effortloom.llm.common import read
from effortloom.llm.queries import TARGETS
from effortloom.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Verdicts are joined back by id and text, so rows with equal ids are judged
    one by one; equal rows have one verdict."""
    verdicts = quality.judge(docs)
    return _where(docs, verdicts.where("kept"), ["doc_id", "digest"])


def _where(docs: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are among ``chosen`` (keys: id, hash), NULL ids included."""
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    right = chosen.select(F.col(keys[0]).alias("_id"), F.col(keys[1]).alias("_hash")).distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash"))
    return left.join(right, same, "left_semi").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents repeat; ``n_chars`` follows the text."""
    kept = lines.dedup_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    same = F.col("n_dropped") == 0
    return kept.select(
        *[
            F.when(same, F.col(f"row.`{c}`")).otherwise(changed[c]).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints of three-word shingles link at three bits or fewer: the one with
    the smallest id. Of rows with that id the first text by hash stays; a group without ids keeps its first text by hash."""
    return simhash.representatives(docs, shingle=3, distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains' tokens to their target weights."""
    domains = mixing.quality_domains(read(spark, sf_dir, "labels"))
    return mixing.copies(mixing.Mix(docs, domains, TARGETS).rows())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2,048."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SimHash, mixing and tokens are beyond SQL; the tests run the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
