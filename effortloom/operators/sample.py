"""Repeatable samples: rows ordered by a digest of their identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.operators.ordered import ordered


def digest(identity: Sequence[str], seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))


def seeded_sample(
    df: DataFrame, identity: Sequence[str], n: int, by: Sequence[str] = (), seed: int = 0, **kwargs
) -> DataFrame:
    """Exactly ``n`` rows, or ``n`` per key, without replacement. ``identity`` must name each row.

    Without keys at most ``n`` rows per task travel. With keys rows are numbered by :func:`ordered`, which splits hot
    keys, for every ``n`` alike.
    """
    marked = df.withColumn("_digest", digest(identity, seed))
    if not by:
        return marked.orderBy("_digest", *identity).limit(n).drop("_digest")
    placed = ordered(marked, list(by), ["_digest", *identity], position="_i", **kwargs)
    return placed.where(F.col("_i") < n).drop("_i", "_digest")


def train_test_split(
    df: DataFrame, identity: Sequence[str], test_share: float, by: Sequence[str] = (), seed: int = 0, **kwargs
) -> DataFrame:
    """Add ``is_test``: ceil(n * test_share) rows of each key, chosen by digest order."""
    marked = df.withColumn("_digest", digest(identity, seed))
    placed = ordered(marked, list(by), ["_digest", *identity], position="_i", size="_n", **kwargs)
    return placed.withColumn("is_test", F.col("_i") < F.ceil(F.col("_n") * F.lit(test_share))).drop("_digest", "_i", "_n")
