"""Nearest-neighbour regression without comparing all pairs of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortloom.operators.ordered import attach, ordered
from effortloom.session import pin


def knn_regress(
    df: DataFrame,
    keys: Sequence[str],
    identity: Sequence[str],
    xs: Sequence[str],
    y: str,
    k: int = 5,
    name: str = "predicted",
    bounded: bool = False,
) -> DataFrame:
    """Mean target of the ``k`` rows of the key nearest in ``xs`` (a row is its own neighbour, as in the full fit).

    Exact, with ties in distance broken by ``identity``. First the rows next to each other in
    sort order give an upper bound of the k-th distance. Then each distinct point looks only into those cells of a
    grid over the predictors that the bound can reach; a cell holds about ``k`` times eight rows. Of identical points only the first
    ``k`` can ever be neighbours, so copies beyond them are no candidates; they still get a prediction.
    """
    keys, identity, xs = list(keys), list(identity), list(xs)
    points = df.select(*keys, *identity, *[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias(y))
    copies = Window.partitionBy(*keys, *xs).orderBy(*identity)
    donors = points.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    placed = pin(ordered(donors, keys, [*xs, *identity], position="_i", size="_n", bounded=bounded))

    def shifted(offset):
        cells = placed.select(*keys, (F.col("_i") + offset).alias("_i"), *[F.col(x).alias(f"_o_{x}") for x in xs])
        return attach(placed, cells, [*keys, "_i"]).select(*keys, *xs, *identity, distance("_o_").alias("_d"))

    def distance(prefix):
        terms = [(F.col(x) - F.col(f"{prefix}{x}")) * (F.col(x) - F.col(f"{prefix}{x}")) for x in xs]
        return sum(terms[1:], terms[0])

    near = shifted(0)
    for step in range(1, k):
        near = near.unionByName(shifted(step)).unionByName(shifted(-step))
    ranked = Window.partitionBy(*keys, *identity).orderBy("_d")
    # A point at the edge may see fewer than k rows on the line; its bound is then the whole key.
    bound = (
        near.withColumn("_rn", F.row_number().over(ranked))
        .groupBy(*keys, *xs, *identity)
        .agg(F.max(F.when(F.col("_rn") == k, F.col("_d"))).alias("_bound"))
        .groupBy(*keys, *xs)
        .agg(F.min(F.coalesce("_bound", F.lit(float("inf")))).alias("_bound"))
    )
    share = 1.0 / len(xs)
    grid = placed.groupBy(*keys).agg(
        *[F.min(x).alias(f"_lo_{x}") for x in xs],
        *[F.max(x).alias(f"_hi_{x}") for x in xs],
        F.ceil(F.pow(F.max("_n") / (8 * k), F.lit(share))).alias("_cells"),
    )

    def cell(x, value):
        width = F.nullif((F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) / F.col("_cells"), F.lit(0.0))
        raw = F.floor((value - F.col(f"_lo_{x}")) / width)
        return F.coalesce(F.greatest(F.lit(0), F.least(raw, F.col("_cells") - 1)), F.lit(0))

    gridded = attach(placed, grid, keys)
    candidates = gridded.select(
        *keys, *[cell(x, F.col(x)).alias(f"_g_{x}") for x in xs], *[F.col(x).alias(f"_c_{x}") for x in xs],
        F.col(y).alias("_y"), F.struct(*identity).alias("_id"),
    )
    reach = F.sqrt("_bound") * (1 + 1e-9)
    queries = attach(attach(placed.select(*keys, *xs).distinct(), grid, keys), bound, [*keys, *xs])
    for x in xs:
        low = F.when(F.col("_bound") < float("inf"), cell(x, F.col(x) - reach)).otherwise(F.lit(0))
        high = F.when(F.col("_bound") < float("inf"), cell(x, F.col(x) + reach)).otherwise(F.col("_cells") - 1)
        queries = queries.withColumn(f"_g_{x}", F.explode(F.sequence(low, high)))
    queries = queries.select(*keys, *xs, *[f"_g_{x}" for x in xs])
    pairs = attach(queries, candidates, [*keys, *[f"_g_{x}" for x in xs]]).withColumn("_d", distance("_c_"))
    best = Window.partitionBy(*keys, *xs).orderBy("_d", "_id")
    answers = (
        pairs.withColumn("_rn", F.row_number().over(best))
        .where(F.col("_rn") <= k)
        .groupBy(*keys, *xs)
        .agg(F.avg("_y").alias(name))
    )
    return attach(points, answers, [*keys, *xs])

