"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.session import pin


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``: bigint).

    Alternates two rewrites until nothing changes. First every node hands its larger neighbours to the smallest of its
    neighbourhood, then every node hands its smaller neighbours on likewise; both keep the components, never add edges
    beyond one a node, and end in stars. Rounds grow with the logarithm of the longest path. Each round is a written
    table, so a lost executor costs a re-read. A node with very many neighbours is aggregated where its edges lie and
    joined back under the adaptive skew split. Self-loops and NULLs are ignored.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    now = pin(tidy(edges))
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        # u > v in every row of ``large``: the smaller neighbours of u are its v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hang = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        now = pin(tidy(hang))
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Size and digest of a set of edges, to see whether a round changed it."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    n, total = edges.agg(F.count(F.lit(1)), digest).first()
    return n, int(total or 0)
