"""Ensembles per key: forests on the grouped tree, boosting on its splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.operators.ordered import attach
from effortloom.operators.tree import best_splits, grouped_cart
from effortloom.session import pin


# The distribution function of a Poisson variable with mean one, which bootstrap counts tend to.
BOOTSTRAP_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def bootstrap_copies(identity: Sequence[str], tree: str, seed: int = 0) -> Column:
    """How often a row takes part in a tree: a Poisson count drawn by a digest of its identity and the tree."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(tree).cast("string"), *[F.col(c).cast("string") for c in identity]))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum(((u >= step).cast("int") for step in BOOTSTRAP_STEPS), F.lit(0))


def random_forest(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], xs: Sequence[str], y: str, trees: int = 10, depth: int = 10,
    min_split: int = 10, seed: int = 0, name: str = "predicted", **kwargs,
) -> DataFrame:
    """A forest per key, all keys and trees grown together: the tree number is one more key of :func:`grouped_cart`.
    ``identity`` names a row within its key. A row that a tree did not draw is still scored by it."""
    keys, identity = list(keys), list(identity)
    drawn = (
        df.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_w", bootstrap_copies([*keys, *identity], "_tree", seed))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("_w", F.lit(1)))))
        .withColumn("_train", F.col("_w") > 0)
    )
    grown = grouped_cart(drawn, [*keys, "_tree"], xs, y, "_train", depth, min_split, "_hat", **kwargs)
    scores = grown.where("_copy = 1").groupBy(*keys, *identity).agg(F.avg("_hat").alias(name))
    return attach(df, scores, [*keys, *identity], "left")


def gradient_boosting(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], xs: Sequence[str], y: str, trees: int = 20, depth: int = 3,
    rate: float = 0.1, min_split: int = 2, name: str = "predicted", **kwargs,
) -> DataFrame:
    """Least-squares boosting per key, all keys together: every round grows one small tree a key on what the rounds before
    leave unexplained and adds ``rate`` times its leaf means. ``identity`` names a row within its key.

    What travels from round to round is a table of identity, predictors and the fit so far; the splits and leaf means of a
    round are a few rows a key, written and joined back. Keys whose target is constant end at their mean, NULL targets
    take no part in the fit and are scored all the same.
    """
    keys, identity, xs = list(keys), list(identity), list(xs)
    known = F.col("_y").isNotNull()
    cells = [F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]
    rows = df.select(*keys, *identity, *cells, F.col(y).cast("double").alias("_y"))
    state = pin(attach(rows, rows.groupBy(*keys).agg(F.avg("_y").alias("_f")), keys))
    inner = [f"_x{i}" for i in range(len(xs))]
    for _ in range(trees):
        rest = state.withColumn("_r", F.col("_y") - F.col("_f")).withColumn("_node", F.lit(1))
        for _ in range(depth):
            found = pin(best_splits(rest.where(known), [*keys, "_node"], inner, "_r", min_split, **kwargs))
            value = F.get(F.array(*inner), F.col("feature"))
            side = F.when(value > F.col("threshold"), F.lit(1)).otherwise(F.lit(0))
            moved = F.when(F.col("feature").isNull(), F.col("_node")).otherwise(F.col("_node") * 2 + side)
            rest = attach(rest, found, [*keys, "_node"], "left").withColumn("_node", moved).drop("feature", "threshold")
        leaves = pin(rest.where(known).groupBy(*keys, "_node").agg(F.avg("_r").alias("_step")))
        grown = attach(rest, leaves, [*keys, "_node"], "left")
        state = pin(grown.withColumn("_f", F.col("_f") + rate * F.coalesce("_step", F.lit(0.0))).drop("_r", "_node", "_step"))
    return attach(df, state.select(*keys, *identity, F.col("_f").alias(name)), [*keys, *identity], "left")
