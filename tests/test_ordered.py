"""Order-dependent columns: the range path must equal a plain window, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effortloom.operators.folds import kfold_assign, training_sets
from effortloom.operators.ordered import average_rank, mid_ranks, ordered, quantiles
from effortloom.operators.sample import seeded_sample, train_test_split
from effortloom.operators.scale import quantile_inverse, quantile_transform

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def rows(spark):
    n = 900
    key = np.where(RNG.random(n) < 0.6, "hot", RNG.choice(["a", "b", "c"], n))
    frame = pd.DataFrame({"k": key, "i": np.arange(n), "x": RNG.integers(0, 40, n).astype(float), "v": RNG.integers(1, 9, n)})
    frame["k"] = frame["k"].where(frame["k"] != "c", None)
    return spark.createDataFrame(frame)


def pairs(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


@pytest.mark.parametrize("keys", [["k"], []])
def test_range_path_equals_window(rows, keys):
    what = dict(position="p", previous={"pv": "v", "px": "x"}, running={"rv": "v"}, totals={"tv": "v"}, size="n")
    plain = ordered(rows, keys, ["x", "i"], bounded=True, **what)
    ranged = ordered(rows, keys, ["x", "i"], rows_per_task=50, **what)
    assert pairs(plain, *plain.columns) == pairs(ranged, *plain.columns)


def test_quantiles_are_exact(rows):
    data = rows.toPandas()
    for limit in (None, 10):
        got = quantiles(rows, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}, rows_per_task=limit).collect()
        for r in got:
            x = data[data["k"].isna() if r["k"] is None else data["k"] == r["k"]]["x"]
            assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(x, [0.25, 0.5, 0.9]))


def test_average_rank(rows):
    data = rows.toPandas()
    want = data.groupby("k", dropna=False)["x"].rank()
    got = average_rank(rows, ["k"], "x", rows_per_task=20).orderBy("i").toPandas()
    assert np.allclose(got["rank"], want)
    assert mid_ranks(rows, ["k"], "x").agg(F.sum("n")).first()[0] == 900


@pytest.mark.parametrize("n", [1, 2, 7, 10, 23, 101])
def test_folds_are_contiguous(spark, n):
    df = spark.range(n).withColumn("k", F.lit(1))
    got = [r["fold"] for r in kfold_assign(df, ["k"], ["id"], bounded=True).orderBy("id").collect()]
    want = [f for f, part in enumerate(np.array_split(np.arange(n), min(10, n))) for _ in part]
    assert got == want
    if n > 1:
        sets = training_sets(kfold_assign(df, ["k"], ["id"], bounded=True), ["k"])
        assert sets.count() == n * (min(10, n) - 1)


def test_sample_is_exact_and_repeatable(rows):
    once = pairs(seeded_sample(rows, ["i"], 40, ["k"]), "k", "i")
    again = pairs(seeded_sample(rows.repartition(5), ["i"], 40, ["k"]), "k", "i")
    assert once == again
    assert sum(1 for k, _ in once if k == "hot") == 40
    assert seeded_sample(rows, ["i"], 33).count() == 33


def test_split_size(rows):
    plain = train_test_split(rows, ["i"], 0.25, ["k"], bounded=True)
    ranged = train_test_split(rows, ["i"], 0.25, ["k"], rows_per_task=30)
    assert pairs(plain, "i", "is_test") == pairs(ranged, "i", "is_test")
    for r in plain.groupBy("k").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect():
        assert r["t"] == -(-r["n"] // 4)


def uniform(train, values):
    """Plain re-statement: interpolate from below and from above and take the mean."""
    q = np.sort(train)
    ref = np.linspace(0, 1, len(q))
    up = np.interp(values, q, ref)
    down = -np.interp(-values, -q[::-1], -ref[::-1])
    out = (up + down) / 2
    out[values >= q[-1]] = 1
    out[values <= q[0]] = 0
    return out


@pytest.mark.parametrize("limit", [None, 15])
def test_quantile_transform(spark, limit):
    train = RNG.integers(0, 30, 80).astype(float)
    test = np.concatenate([RNG.random(40) * 40 - 5, train[:10]])
    frame = pd.DataFrame(
        {"k": "a", "i": np.arange(130), "x": np.concatenate([train, test]), "t": [True] * 80 + [False] * 50}
    )
    got = quantile_transform(spark.createDataFrame(frame), ["k"], "x", train="t", rows_per_task=limit).orderBy("i").toPandas()
    assert np.allclose(got["u"], uniform(train, frame["x"].to_numpy()))
    shares = spark.createDataFrame(pd.DataFrame({"k": "a", "j": np.arange(60), "s": RNG.random(60) * 1.4 - 0.2}))
    base = spark.createDataFrame(frame[frame["t"]])
    back = quantile_inverse(shares, base, ["k"], "x", ["i"], "s", "y", rows_per_task=limit).orderBy("j").toPandas()
    assert np.allclose(back["y"], np.interp(back["s"], np.linspace(0, 1, 80), np.sort(train)))
