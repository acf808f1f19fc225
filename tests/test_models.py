"""Models against small brute-force versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effortloom.operators import correlate, folds, isotonic, linear, metrics, models, neighbors, pipeline, tree
from tests.test_ordered import uniform

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def frame():
    n = 240
    out = pd.DataFrame({"g": RNG.choice(["hot", "hot", "b", "c"], n), "i": np.arange(n)})
    out["a"] = RNG.integers(0, 12, n).astype(float)
    out["b"] = RNG.random(n).round(2)
    out["flat"] = 3.0
    out["y"] = (4 * out["a"] + 10 * (out["b"] > 0.5) + RNG.normal(0, 1, n)).round(3)
    return out


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def lstsq(x, y, intercept=True):
    design = np.column_stack([np.ones(len(x)), x]) if intercept else x
    return np.linalg.lstsq(design, y, rcond=None)[0]


@pytest.mark.parametrize("intercept", [True, False])
def test_least_squares(frame, df, intercept):
    for r in linear.fit_linear(df, ["g"], ["a", "b"], "y", intercept).collect():
        part = frame[frame["g"] == r["g"]]
        want = lstsq(part[["a", "b"]].to_numpy(), part["y"].to_numpy(), intercept)
        assert np.allclose(r["coef"] if intercept else r["coef"][1:], want)


def test_constant_predictor_gets_no_slope(frame, df):
    for r in linear.fit_linear(df, ["g"], ["a", "flat"], "y").collect():
        part = frame[frame["g"] == r["g"]]
        want = lstsq(part[["a"]].to_numpy(), part["y"].to_numpy())
        assert np.allclose(r["coef"], [want[0], want[1], 0.0])


def test_large_close_values_keep_their_digits(spark):
    """Values about 1e9 that differ by units: differences of raw sums would keep none of their digits."""
    rng = np.random.default_rng(5)
    n = 900
    out = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "small", "hot"), "i": np.arange(n)})
    out["a"], out["b"] = 1e9 + rng.integers(0, 50, n), 3e8 + rng.integers(0, 9, n)
    out["y"] = 2.5 * (out["a"] - 1e9) - 4 * (out["b"] - 3e8) + 7
    out["level"] = 1e9 + 0.1
    df = spark.createDataFrame(out).repartition(7)
    for r in linear.fit_linear(df, ["g"], ["a", "b", "level"], "y").collect():
        assert r["coef"][1:] == pytest.approx([2.5, -4, 0], rel=1e-8, abs=1e-8)
    rows = folds.kfold_assign(df, ["g"], ["i"], bounded=True)
    for r in linear.solve_moments(linear.fold_moments(rows, ["g"], ["a", "b", "level"], "y"), 3).collect():
        assert r["coef"][1:] == pytest.approx([2.5, -4, 0], rel=1e-8, abs=1e-8)
    got = linear.cv_predict(rows, ["g"], ["a", "b"], "y").toPandas()
    assert np.allclose(got["predicted"], got["y"], atol=1e-4)
    best = linear.ridge_cv(rows, ["g"], ["a", "b"], "y", [1e-9, 1000.0]).collect()
    assert {r["alpha"] for r in best} == {1e-9}
    for r in best:  # the held-out error of an exact law is nothing beside the spread of its values
        y = out[out["g"] == r["g"]]["y"]
        assert abs(r["sse"]) < 1e-8 * ((y - y.mean()) ** 2).sum()


def held_out(part, predict):
    part = part.sort_values("i")
    out = np.empty(len(part))
    for rows in np.array_split(np.arange(len(part)), min(10, len(part))):
        rest = np.setdiff1d(np.arange(len(part)), rows)
        out[rows] = predict(part.iloc[rest], part.iloc[rows])
    return out


def test_cross_validation(frame, df):
    rows = folds.kfold_assign(df, ["g"], ["i"], bounded=True)
    got = linear.cv_predict(rows, ["g"], ["a", "b"], "y").toPandas().sort_values("i")

    def predict(train, test):
        c = lstsq(train[["a", "b"]].to_numpy(), train["y"].to_numpy())
        return c[0] + test[["a", "b"]].to_numpy() @ c[1:]

    for g, part in frame.groupby("g"):
        assert np.allclose(got[got["g"] == g]["predicted"], held_out(part, predict))


def test_ridge_picks_best_penalty(frame, df):
    alphas = [0.01, 1.0, 100.0]
    rows = folds.kfold_assign(df, ["g"], ["i"], bounded=True)
    for r in linear.ridge_cv(rows, ["g"], ["a", "b"], "y", alphas).collect():
        part = frame[frame["g"] == r["g"]]

        def fit(train, alpha):
            x, y = train[["a", "b"]].to_numpy(), train["y"].to_numpy()
            xc = x - x.mean(0)
            c = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (y - y.mean()))
            return y.mean() - x.mean(0) @ c, c

        sse = {}
        for alpha in alphas:
            def predict(train, test, alpha=alpha):
                b0, c = fit(train, alpha)
                return b0 + test[["a", "b"]].to_numpy() @ c
            sse[alpha] = ((held_out(part, predict) - part.sort_values("i")["y"].to_numpy()) ** 2).sum()
        best = min(sse, key=sse.get)
        assert r["alpha"] == best and np.isclose(r["sse"], sse[best])
        b0, c = fit(part, best)
        assert np.allclose(r["coef"], [b0, *c])


def grow(x, y, depth, min_split):
    """Plain recursive tree: returns a predictor."""
    if depth == 0 or len(y) < min_split or y.min() == y.max():
        return lambda z: np.full(len(z), y.mean())
    best = None
    sst = ((y - y.mean()) ** 2).sum()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] < b
            nl, sl, nr, sr = left.sum(), y[left].sum(), (~left).sum(), y[~left].sum()
            gain = (sl * sl / nl + sr * sr / nr - y.sum() ** 2 / len(y)) / sst
            key = (-round(gain, 10), f, (a + b) / 2)
            best = min(best, key) if best else key
    if best is None:
        return lambda z: np.full(len(z), y.mean())
    _, f, cut = best
    low = grow(x[x[:, f] <= cut], y[x[:, f] <= cut], depth - 1, min_split)
    high = grow(x[x[:, f] > cut], y[x[:, f] > cut], depth - 1, min_split)
    return lambda z: np.where(z[:, f] <= cut, low(z), high(z))


@pytest.mark.parametrize("limit", [None, 20])
def test_tree_equals_brute_force(frame, df, limit):
    rows = df.withColumn("is_train", F.col("i") % 4 != 0)
    got = tree.grouped_cart(rows, ["g"], ["a", "b"], "y", max_depth=4, rows_per_task=limit).toPandas().sort_values("i")
    for g, part in frame.groupby("g"):
        train = part[part["i"] % 4 != 0]
        model = grow(train[["a", "b"]].to_numpy(), train["y"].to_numpy(), 4, 10)
        assert np.allclose(got[got["g"] == g]["predicted"], model(part.sort_values("i")[["a", "b"]].to_numpy()))


def test_production_model_equals_brute_force(spark, frame):
    part = frame[frame["g"] == "b"].sort_values("i").reset_index(drop=True)
    rows = spark.createDataFrame(part)
    got = pipeline.transformed_regression(rows, ["g"], ["i"], ["a", "b"], "y", "tree", bounded=True).toPandas().sort_values("i")

    def predict(train, test):
        def scale(z):
            return np.column_stack([uniform(train[c].to_numpy(), z[c].to_numpy().copy()) for c in ("a", "b")])

        y = train["y"].to_numpy()
        model = grow(scale(train), uniform(y, y), 10, 10)
        return np.interp(model(scale(test)), np.linspace(0, 1, len(y)), np.sort(y))

    assert np.allclose(got["predicted"], held_out(part, predict))
    assert np.allclose(got["fitted"], predict(part, part))


def test_neighbours_equal_brute_force(frame, df):
    got = neighbors.knn_regress(df, ["g"], ["i"], ["a", "b"], "y").toPandas().sort_values("i")
    for g, part in frame.groupby("g"):
        part = part.sort_values("i")
        x, y, i = part[["a", "b"]].to_numpy(), part["y"].to_numpy(), part["i"].to_numpy()
        want = []
        for row in x:
            d = ((x - row) ** 2).sum(1)
            want.append(y[np.lexsort((i, d))[:5]].mean())
        assert np.allclose(got[got["g"] == g]["predicted"], want)


def test_neighbours_with_many_copies(spark):
    part = pd.DataFrame({"g": "x", "i": np.arange(120), "a": [1.0] * 100 + list(np.arange(20.0)), "y": np.arange(120.0)})
    got = neighbors.knn_regress(spark.createDataFrame(part), ["g"], ["i"], ["a"], "y").toPandas().sort_values("i")
    for j, row in part.iterrows():
        order = np.lexsort((part["i"], (part["a"] - row["a"]) ** 2))[:5]
        assert np.isclose(got.iloc[j]["predicted"], part["y"].to_numpy()[order].mean())


def test_few_rows_have_few_neighbours(spark):
    part = spark.createDataFrame([("x", 0, 1.0, 2.0), ("x", 1, 5.0, 4.0)], "g string, i int, a double, y double")
    assert {r["predicted"] for r in neighbors.knn_regress(part, ["g"], ["i"], ["a"], "y").collect()} == {3.0}


def min_max_fit(frame, x, y):
    """The closed form of a monotone fit, by predictor value: the largest over starts of the smallest mean up to an end."""
    points = frame.groupby(x)[y].agg(["sum", "count"]).sort_index()
    s, w = (np.concatenate(([0.0], points[c].cumsum())) for c in ("sum", "count"))
    n = len(points)
    means = np.array([[(s[b] - s[a]) / (w[b] - w[a]) if b > a else np.inf for b in range(1, n + 1)] for a in range(n)])
    least = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]  # over ends at or after a point
    return {v: least[: k + 1, k].max() for k, v in enumerate(points.index)}


@pytest.mark.parametrize("points_per_range", [7, 500_000])
def test_isotonic_equals_min_max_formula(spark, frame, df, points_per_range):
    out = isotonic.isotonic(df, ["g"], "a", "y", points_per_range=points_per_range)
    got = out.toPandas()
    assert len(got) == len(frame)
    for g, part in frame.groupby("g"):
        want = min_max_fit(part, "a", "y")
        mine = got[got["g"] == g]
        assert np.allclose(mine["predicted"], [want[v] for v in mine["a"]])


def test_isotonic_with_a_hot_key_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(i), float(300 - i if 100 < i < 250 else i + rng.integers(-20, 20))) for i in range(400)]
    rows += [("down", float(i), float(-i)) for i in range(90)] + [("up", float(i), float(i)) for i in range(90)]
    rows += [(None, float(i % 5), float(i)) for i in range(20)] + [("one", 1.0, 2.0), ("hot", None, 1.0), ("hot", 399.5, None), ("gone", 1.0, None)]
    table = pd.DataFrame(rows, columns=["g", "x", "y"])
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    out = isotonic.isotonic(df, ["g"], "x", "y", points_per_range=13).toPandas()
    assert len(out) == len(rows)
    blocks = isotonic.isotonic_blocks(df, ["g"], "x", "y", 13).toPandas()
    for g in ("hot", "down", "up", None, "one"):
        pick = (lambda t: t["g"].isna()) if g is None else (lambda t, g=g: t["g"] == g)
        part = table[pick(table)].dropna(subset=["x", "y"])
        want = min_max_fit(part, "x", "y")
        mine = out[pick(out)].dropna(subset=["x", "y"])
        assert np.allclose(mine["predicted"], [want[v] for v in mine["x"]]), g
        assert len(blocks[pick(blocks)]) == len({round(v, 9) for v in want.values()})
    assert out[out["x"] == 399.5]["predicted"].iloc[0] == out[out["x"] == 399.0]["predicted"].iloc[0]
    assert out[out["g"] == "gone"]["predicted"].isna().all() and out[out["x"].isna()]["predicted"].isna().all()
    assert isotonic.isotonic(df.limit(0), ["g"], "x", "y").count() == 0


def boosted(part, xs, y, trees, depth, rate, min_split=2):
    """Plain least-squares boosting on one key."""
    x, target = part[xs].to_numpy(float), part[y].to_numpy(float)
    fit = np.full(len(part), target.mean())

    def grow(at, rest, left):
        def sse(some):
            return ((rest[some] - rest[some].mean()) ** 2).sum()

        best = None
        if left and len(at) >= min_split and sse(at) > 1e-12 * (rest[at] ** 2).sum():
            for f in range(len(xs)):
                values = np.unique(x[at, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[at, f] <= cut
                    gain = round((sse(at) - sse(at[low]) - sse(at[~low])) / sse(at), 10)
                    if best is None or gain > best[0]:
                        best = (gain, low)
        if best is None:
            fit[at] += rate * rest[at].mean()
            return
        grow(at[best[1]], rest, left - 1)
        grow(at[~best[1]], rest, left - 1)

    for _ in range(trees):
        grow(np.arange(len(part)), target - fit, depth)
    return fit


def test_boosting_equals_plain_boosting(spark, frame, df):
    out = models.gradient_boosting(df, ["g"], ["i"], ["a", "b"], "y", trees=4, depth=2, rate=0.3).toPandas()
    assert len(out) == len(frame)
    for g, part in frame.groupby("g"):
        mine = out[out["g"] == g].set_index("i").loc[part["i"]]
        assert np.allclose(mine["predicted"], boosted(part, ["a", "b"], "y", 4, 2, 0.3)), g


def test_boosting_takes_many_keys_and_odd_rows(spark):
    rows = [(f"p{i % 3000}", i, float(i % 7), float(i % 7 * 3)) for i in range(18000)] + [("p1", 99999, 3.0, None), ("flat", 1, 1.0, 4.0), ("flat", 2, 2.0, 4.0), ("none", 1, 1.0, None)]
    many = spark.createDataFrame(rows, "g string, i int, a double, y double")
    out = models.gradient_boosting(many, ["g"], ["i"], ["a"], "y", trees=2, depth=2)
    assert out.count() == len(rows)
    odd = {(r["g"], r["i"]): r["predicted"] for r in out.where("y IS NULL OR g = 'flat'").collect()}
    assert odd["flat", 1] == 4.0 and odd["none", 1] is None and odd["p1", 99999] is not None


def test_forest_per_key_beats_the_mean(df):
    out = models.random_forest(df, ["g"], ["i"], ["a", "b"], "y", trees=3, depth=4, bounded=True)
    scores = out.groupBy("g").agg(metrics.r_squared("y", "predicted").alias("r")).collect()
    assert out.count() == df.count() and min(r["r"] for r in scores) > 0.5


def test_adjusted_r2_guard(spark):
    row = spark.createDataFrame([(0.5, 3), (0.5, 10)], "r double, n int").select(
        metrics.r_squared_adj("r", "n", 2).alias("x")
    ).collect()
    assert row[0]["x"] == 0.5 and np.isclose(row[1]["x"], 1 - 0.5 * 9 / 7)


def test_inflation_factor(frame, df):
    got = correlate.vif(df, ["a", "b", "y"]).first()
    x = frame[["a", "b", "y"]].to_numpy()
    inverse = np.linalg.inv(x.T @ x)
    assert np.allclose([got[f"vif_{c}"] for c in ("a", "b", "y")], np.diag(inverse) * np.diag(x.T @ x))


def test_constant_columns_have_no_correlation(df):
    row = correlate.pearson_pairs(df, ["g"], [("a", "flat"), ("a", "y")]).first()
    assert row["a__flat"] is None and row["a__y"] > 0.9
