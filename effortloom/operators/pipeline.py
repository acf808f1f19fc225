"""The effort model: quantile-transformed predictors and target, a regressor, predictions brought back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.operators.folds import kfold_assign, training_sets
from effortloom.operators.linear import fit_linear, predict_linear
from effortloom.operators.ordered import attach
from effortloom.operators.scale import quantile_inverse, quantile_transform
from effortloom.operators.tree import grouped_cart
from effortloom.session import pin

FULL_FIT = -1


def model_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 10, bounded: bool = False) -> DataFrame:
    """Rows of every fit a key needs, told apart by ``fold_out``: one fit per held-out fold and the full fit (-1).

    ``is_train`` marks rows a fit learns from, ``is_test`` rows it predicts.
    """
    folded = kfold_assign(df, keys, order, k, bounded)
    train = training_sets(folded, keys).withColumns({"is_train": F.lit(True), "is_test": F.lit(False)})
    test = folded.withColumns({"fold_out": F.col("fold"), "is_train": F.lit(False), "is_test": F.lit(True)})
    full = folded.withColumns({"fold_out": F.lit(FULL_FIT), "is_train": F.lit(True), "is_test": F.lit(True)})
    return train.unionByName(test).unionByName(full)


def transform_features(rows: DataFrame, keys: Sequence[str], identity: Sequence[str], xs: Sequence[str], **kwargs) -> DataFrame:
    """Quantile-transform all predictors in one pass over their long form."""
    keys, identity = list(keys), list(identity)
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("col"), F.col(x).cast("double").alias("val")) for x in xs]))
    long = rows.select(*keys, *identity, "is_train", cells.alias("_c")).select(*keys, *identity, "is_train", "_c.*")
    placed = quantile_transform(long, [*keys, "col"], "val", "u", train="is_train", **kwargs)
    wide = placed.groupBy(*keys, *identity).agg(*[F.max(F.when(F.col("col") == x, F.col("u"))).alias(f"u_{x}") for x in xs])
    return attach(rows, wide, [*keys, *identity])


def transformed_regression(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    xs: Sequence[str],
    y: str,
    regressor: str = "tree",
    k: int = 10,
    bounded: bool = False,
) -> DataFrame:
    """Each row with ``predicted`` (by the model of the other folds) and ``fitted`` (by the model of all rows).

    ``order`` must name each row of a key. Rows with a NULL predictor or target are the caller's to fill.
    """
    keys, order = list(keys), list(order)
    group = [*keys, "fold_out"]
    rows = pin(model_rows(df.select(*keys, *order, *xs, y), keys, order, k, bounded))
    x_rows = transform_features(rows, group, order, xs, bounded=bounded)
    training = x_rows.where("is_train")
    target = quantile_transform(training, group, y, "u_y", bounded=bounded).select(*group, *order, "u_y")
    ready = pin(attach(x_rows, target, [*group, *order], "left"))
    u_xs = [f"u_{x}" for x in xs]
    if regressor == "tree":
        scored = grouped_cart(ready, group, u_xs, "u_y", name="u_hat", bounded=bounded)
    elif regressor == "linear":
        model = fit_linear(ready.where("is_train"), group, u_xs, "u_y")
        scored = predict_linear(ready, model, group, u_xs, "u_hat")
    else:
        raise ValueError(f"unknown regressor {regressor!r}")
    back = quantile_inverse(
        scored.where("is_test"), rows.where("is_train"), group, y, order, "u_hat", "hat", bounded=bounded
    )
    full = F.col("fold_out") == FULL_FIT
    return back.groupBy(*keys, *order).agg(
        *[F.max(c).alias(c) for c in [*xs, y]],
        F.max("fold").alias("fold"),
        F.max(F.when(~full, F.col("hat"))).alias("predicted"),
        F.max(F.when(full, F.col("hat"))).alias("fitted"),
    )
