"""Linear models per key from mergeable centred cross-products.

A key is reduced where its rows lie (map-side) to its count, means and products about the means, which Spark's covariance
aggregates merge pairwise; raw sums of squares, whose difference loses all digits where values are large and close, are
never formed. No key is gathered; only the small systems of normal equations are solved in Python, many per Arrow batch.
Cross-validation needs one pass over the rows as well: moments are kept per fold, and the training moments of a fold are
those of the other folds put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.operators.ordered import attach


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k + 1) for j in range(i, k + 1)]


def moment_sums(xs: Sequence[str], y: str) -> list[Column]:
    """Aggregates: n, then the means and the products about the means of the predictors and the target. A NULL is left out
    of the means and products it takes part in."""
    cols = [F.col(c).cast("double") for c in [*xs, y]]
    n = F.count(F.lit(1)).cast("double")
    out = [n.alias("m_n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]]
    return out + [(F.covar_pop(cols[i], cols[j]) * n).alias(f"m_{i}_{j}") for i, j in _pairs(len(xs))]


def merged_moments(k: int) -> list[Column]:
    """Aggregates that put rows of moments together. ``r_<i>`` is any fixed point near the means, such as the mean of the
    whole key: the products of the means are taken about it, so that nothing large is subtracted."""
    n = F.sum("m_n")
    off = [F.col(f"m_{i}") - F.col(f"r_{i}") for i in range(k + 1)]
    shift = [F.sum(F.col("m_n") * d) / n for d in off]
    out = [n.alias("m_n"), *[(F.first(f"r_{i}") + shift[i]).alias(f"m_{i}") for i in range(k + 1)]]
    return out + [
        (F.sum(F.col(f"m_{i}_{j}") + F.col("m_n") * off[i] * off[j]) - n * shift[i] * shift[j]).alias(f"m_{i}_{j}")
        for i, j in _pairs(k)
    ]


def moment_names(k: int) -> list[str]:
    return ["m_n", *[f"m_{i}" for i in range(k + 1)], *[f"m_{i}_{j}" for i, j in _pairs(k)]]


def _solver(k: int, intercept: bool):
    @F.pandas_udf("array<double>")
    def solve(moments: pd.Series, alpha: pd.Series) -> pd.Series:
        m = np.array(moments.tolist(), dtype=float).reshape(len(moments), -1)
        n, mean = m[:, 0], m[:, 1 : k + 2]
        full = np.zeros((len(m), k + 1, k + 1))
        upper = np.triu_indices(k + 1)
        full[:, upper[0], upper[1]] = m[:, k + 2 :]
        full[:, upper[1], upper[0]] = m[:, k + 2 :]
        # A predictor without variation keeps only the rounding noise of its mean; drop it.
        noise = n[:, None] * (1e-13 * mean[:, :k]) ** 2
        if not intercept:
            full = full + n[:, None, None] * mean[:, :, None] * mean[:, None, :]
            noise = np.zeros_like(noise)
        xx, xy = full[:, :k, :k].copy(), full[:, :k, k]
        diagonal = np.einsum("rii->ri", xx)
        flat = diagonal <= np.maximum(noise, 1e-300)
        scale = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, diagonal)))
        xx = np.where(flat[:, :, None] | flat[:, None, :], 0.0, xx)
        xy = np.where(flat, 0.0, xy)
        ridge = np.asarray(alpha, dtype=float)[:, None, None] * np.eye(k)
        system = (xx + np.where(flat[:, :, None], 0.0, ridge)) / (scale[:, :, None] * scale[:, None, :])
        slopes = np.einsum("rij,rj->ri", np.linalg.pinv(system, rcond=1e-10, hermitian=True), xy / scale) / scale
        base = mean[:, k] - np.einsum("ri,ri->r", slopes, mean[:, :k]) if intercept else np.zeros(len(m))
        return pd.Series(list(np.column_stack([base, slopes])))

    return solve


def solve_moments(sums: DataFrame, k: int, intercept: bool = True, alpha: Column | float = 0.0) -> DataFrame:
    """Replace the moment columns by ``coef``: intercept first, then one slope per predictor."""
    names = moment_names(k)
    penalty = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    coef = _solver(k, intercept)(F.array(*names), penalty.cast("double"))
    return sums.withColumn("coef", coef).drop(*names)


def fit_linear(
    df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, intercept: bool = True, alpha: float = 0.0
) -> DataFrame:
    """Least squares per key; ``alpha`` adds a ridge penalty on the slopes."""
    return solve_moments(df.groupBy(*keys).agg(*moment_sums(xs, y)), len(xs), intercept, alpha)


def score(coef: str, xs: Sequence[str]) -> Column:
    terms = [F.element_at(coef, i + 2) * F.col(x) for i, x in enumerate(xs)]
    return reduce(lambda a, b: a + b, terms, F.element_at(coef, 1))


def predict_linear(df: DataFrame, model: DataFrame, keys: Sequence[str], xs: Sequence[str], name: str = "predicted") -> DataFrame:
    return attach(df, model.select(*keys, "coef"), keys).withColumn(name, score("coef", xs)).drop("coef")


def fold_moments(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Training moments per key and held-out fold. Only the per-fold moments (at most k rows per key) are multiplied."""
    keys, k = list(keys), len(xs)
    per_fold = df.groupBy(*keys, "fold").agg(*moment_sums(xs, y))
    near = [(F.sum(F.col("m_n") * F.col(f"m_{i}")) / F.sum("m_n")).alias(f"r_{i}") for i in range(k + 1)]
    folds = per_fold.groupBy(*keys).agg((F.max("fold") + 1).alias("_k"), *near)
    outs = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    spread = attach(per_fold, folds, keys).withColumn("fold_out", outs).where(F.col("fold_out") != F.col("fold"))
    return spread.groupBy(*keys, "fold_out").agg(*merged_moments(k))


def cv_predict(
    df: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    y: str,
    intercept: bool = True,
    alpha: float = 0.0,
    name: str = "predicted",
) -> DataFrame:
    """Predict each row of a frame with ``fold`` by the model of the other folds."""
    model = solve_moments(fold_moments(df, keys, xs, y), len(xs), intercept, alpha)
    model = model.withColumnRenamed("fold_out", "fold")
    return predict_linear(df, model, [*keys, "fold"], xs, name)


def ridge_cv(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, alphas: Sequence[float]) -> DataFrame:
    """The penalty with the smallest held-out squared error per key, and the model fitted with it on all rows.

    Held-out errors come from the moments of the held-out fold, so the rows are read once for all penalties.
    """
    keys, k = list(keys), len(xs)
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    train = fold_moments(df, keys, xs, y).withColumn("alpha", grid)
    models = solve_moments(train, k, True, F.col("alpha")).withColumnRenamed("fold_out", "fold")
    held = df.groupBy(*keys, "fold").agg(*moment_sums(xs, y))
    both = attach(models, held, [*keys, "fold"])
    b = [F.element_at("coef", i + 1) for i in range(k + 1)]
    # sum (y - b0 - b.x)^2: products about the means, and the square of the error at the means; index k is the target.
    miss = F.col(f"m_{k}") - b[0] - reduce(lambda u, v: u + v, [b[i + 1] * F.col(f"m_{i}") for i in range(k)])
    sse = F.col(f"m_{k}_{k}") + F.col("m_n") * miss * miss
    for i in range(k):
        sse = sse - 2 * b[i + 1] * F.col(f"m_{i}_{k}")
        for j in range(k):
            sse = sse + b[i + 1] * b[j + 1] * F.col(f"m_{min(i, j)}_{max(i, j)}")
    errors = both.groupBy(*keys, "alpha").agg(F.sum(sse).alias("sse"))
    best = errors.groupBy(*keys).agg(F.min_by("alpha", F.struct("sse", "alpha")).alias("alpha"), F.min("sse").alias("sse"))
    whole = df.groupBy(*keys).agg(*moment_sums(xs, y))
    return solve_moments(attach(whole, best, keys), k, True, F.col("alpha"))
