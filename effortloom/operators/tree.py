"""Regression trees for all keys at once, grown level by level.

Each level is one distributed pass: distinct feature values per open node are counted, ordered running sums give the
error of every split, and the best split per node moves the rows on. Training rows and rows to predict travel in the
same frame, so growing the tree also scores it. Cross-validation folds are just another key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.operators.ordered import attach, fits_in_task, ordered
from effortloom.session import pin

# Tree limits.
MAX_DEPTH, MIN_SPLIT = 10, 10


def best_splits(
    rows: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    y: str,
    min_split: int,
    bounded: bool = False,
    rows_per_task: int | None = None,
) -> DataFrame:
    """The split with the smallest squared error per key (a node is part of the key).

    Ties in the error, compared at ten digits of its relative gain, go to the first feature, then the smallest value.
    """
    keys = list(keys)
    small = bounded or fits_in_task(rows, keys, rows_per_task)
    if small:
        # One shuffle serves the counts, the ordering and the choice below, all of which stay within a key.
        rows = rows.repartition(*keys)
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).alias("feature"), F.col(x).cast("double").alias("v")) for i, x in enumerate(xs)])
    )
    counts = (
        rows.select(*keys, F.col(y).cast("double").alias("_y"), cells.alias("_c"))
        .groupBy(*keys, F.col("_c.feature").alias("feature"), F.col("_c.v").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")
        )
    )
    placed = ordered(
        counts if small else pin(counts), [*keys, "feature"], ["v"], running={"n_to": "n", "s_to": "s"},
        previous={"v_prev": "v"}, totals={"node_n": "n", "node_s": "s", "node_q": "q"}, bounded=small,
        rows_per_task=rows_per_task,
    )
    sst = F.col("node_q") - F.col("node_s") * F.col("node_s") / F.col("node_n")
    # A node whose targets are all equal keeps only rounding noise in sst and is a leaf.
    open_splits = placed.where(
        F.col("v_prev").isNotNull() & (F.col("node_n") >= min_split) & (sst > 1e-12 * F.col("node_q"))
    )
    nl, sl = F.col("n_to") - F.col("n"), F.col("s_to") - F.col("s")
    nr, sr = F.col("node_n") - nl, F.col("node_s") - sl
    gain = (sl * sl / nl + sr * sr / nr - F.col("node_s") * F.col("node_s") / F.col("node_n")) / F.nullif(sst, F.lit(0.0))
    threshold = (F.col("v_prev") + F.col("v")) / 2
    ranked = open_splits.select(
        *keys,
        F.struct(
            (-F.round(gain, 10)).alias("cost"),
            F.col("feature").alias("feature"),
            threshold.alias("threshold"),
        ).alias("_s"),
    )
    return ranked.groupBy(*keys).agg(F.min("_s").alias("_s")).select(
        *keys, F.col("_s.feature").alias("feature"), F.col("_s.threshold").alias("threshold")
    )


def grouped_cart(
    rows: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    y: str,
    train: str = "is_train",
    max_depth: int = MAX_DEPTH,
    min_split: int = MIN_SPLIT,
    name: str = "predicted",
    **kwargs,
) -> DataFrame:
    """Add ``node`` and the prediction of a tree grown on the rows of each key where ``train`` is true.

    The rows are pinned after each level: the plan stays flat and a lost executor costs one level at most.
    """
    keys = list(keys)
    state = pin(rows.withColumns({"node": F.lit(1).cast("bigint"), "_open": F.lit(True)}))
    for _ in range(max_depth):
        growing = state.where(F.col("_open") & F.col(train))
        splits = best_splits(growing, [*keys, "node"], xs, y, min_split, **kwargs)
        moved = attach(state, splits, [*keys, "node"], "left")
        value = F.element_at(F.array(*[F.col(x).cast("double") for x in xs]), F.col("feature") + 1)
        side = F.when(value > F.col("threshold"), F.lit(1)).otherwise(F.lit(0))
        state = pin(
            moved.withColumns(
                {
                    "node": F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side),
                    "_open": F.col("feature").isNotNull(),
                }
            ).drop("feature", "threshold")
        )
        if state.where("_open").isEmpty():
            break
    leaves = state.where(F.col(train)).groupBy(*keys, "node").agg(F.avg(F.col(y).cast("double")).alias(name))
    return attach(state.drop("_open"), leaves, [*keys, "node"], "left")
