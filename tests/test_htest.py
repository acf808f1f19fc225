"""Distribution functions and tests against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effortloom.functions.special import binomial_cdf, chi2_sf, norm_cdf, norm_ppf, norm_sf, student_two_sided
from effortloom.operators import htest

RNG = np.random.default_rng(5)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("z", [-9.0, -4.2, -1.96, 0.0, 0.3, 2.5, 3.99, 4.0, 6.5, 12.0])
def test_normal_tail(spark, z):
    assert math.isclose(one(spark, norm_sf(F.lit(z))), math.erfc(z / math.sqrt(2)) / 2, rel_tol=1e-9, abs_tol=1e-300)
    assert math.isclose(one(spark, norm_cdf(F.lit(z))), math.erfc(-z / math.sqrt(2)) / 2, rel_tol=1e-9, abs_tol=1e-300)


@pytest.mark.parametrize("p", [1e-6, 0.01, 0.3, 0.5, 0.8, 0.99999])
def test_probit(spark, p):
    z = one(spark, norm_ppf(F.lit(p)))
    assert math.isclose(math.erfc(-z / math.sqrt(2)) / 2, p, rel_tol=1e-7)


def integral(f, a, b, n=200_000):
    x = np.linspace(a, b, n + 1)
    w = np.ones(n + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return (f(x) * w).sum() * (b - a) / n / 3


@pytest.mark.parametrize("df", [1, 2, 3, 7, 8])
def test_chi_square_tail(spark, df):
    f = lambda x: np.exp((df / 2 - 1) * np.log(x) - x / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
    assert math.isclose(one(spark, chi2_sf(F.lit(5.5), df)), integral(f, 5.5, 200), rel_tol=1e-8)


@pytest.mark.parametrize("df,t", [(1, 1.0), (5, 2.3), (29, -0.7), (400, 3.1)])
def test_student_tail(spark, df, t):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    want = 1 - 2 * integral(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, abs(t))
    assert math.isclose(one(spark, student_two_sided(F.lit(t), F.lit(df))), want, rel_tol=1e-8)


@pytest.mark.parametrize("k,n,p", [(28, 64, 0.5), (0, 9, 0.3), (16, 26, 0.9), (9, 9, 0.4), (5, 40, 0.02)])
def test_binomial_tail(spark, k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert math.isclose(one(spark, binomial_cdf(F.lit(k), F.lit(n), F.lit(p))), want, rel_tol=1e-9)


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_shapiro_on_a_published_sample(spark):
    weights = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = htest.shapiro(frame(spark, i=range(11), x=weights), "x", ["i"]).first()
    assert math.isclose(got["statistic"], 0.79, abs_tol=0.002) and math.isclose(got["p"], 0.0067, abs_tol=0.0005)


def test_shapiro_tells_normal_from_skewed(spark):
    for limit in (None, 60):
        z = RNG.normal(5, 2, 300)
        normal = htest.shapiro(frame(spark, i=range(300), x=z), "x", ["i"], rows_per_task=limit).first()
        skewed = htest.shapiro(frame(spark, i=range(300), x=np.exp(z)), "x", ["i"], rows_per_task=limit).first()
        assert normal["p"] > 0.01 and skewed["p"] < 1e-10
    assert htest.shapiro(frame(spark, i=range(9), x=[1.0] * 9), "x", ["i"]).first()["statistic"] is None


def ranks(values):
    return pd.Series(values).rank().to_numpy()


def test_rank_tests_with_ties_and_a_hot_value(spark):
    x = np.where(RNG.random(300) < 0.4, 7.0, RNG.integers(0, 20, 300)).astype(float)
    g = RNG.choice(["a", "b", "c"], 300)
    df = frame(spark, g=g, x=x)
    r, n = ranks(x), len(x)
    t = pd.Series(x).value_counts().to_numpy().astype(float)
    correction = 1 - (t**3 - t).sum() / (n**3 - n)
    h = 12 / (n * (n + 1)) * sum(r[g == k].sum() ** 2 / (g == k).sum() for k in "abc") - 3 * (n + 1)
    got = htest.kruskal(df, "x", "g", ["a", "b", "c"], rows_per_task=6).first()
    assert math.isclose(got["statistic"], h / correction) and math.isclose(got["p"], math.exp(-h / correction / 2))

    both = np.isin(g, ["a", "b"])
    r, n1, n2 = ranks(x[both]), int((g == "a").sum()), int((g == "b").sum())
    u = r[g[both] == "a"].sum() - n1 * (n1 + 1) / 2
    got = htest.mann_whitney(df, "x", "g", "a", "b").first()
    wins = sum((a > b) + (a == b) / 2 for a in x[g == "a"] for b in x[g == "b"])
    assert math.isclose(got["statistic"], u) and math.isclose(u, wins)


def test_signed_rank(spark):
    x = RNG.integers(0, 15, 90).astype(float)
    d = x - 6
    d = d[d != 0]
    r = ranks(np.abs(d))
    got = htest.signed_rank(frame(spark, x=x), "x", 6.0, rows_per_task=4).first()
    assert got["n"] == len(d) and math.isclose(got["statistic"], r[d > 0].sum())


def test_choice_of_test(spark):
    few = frame(spark, k="few", i=range(20), x=RNG.normal(0, 1, 20))
    many = frame(spark, k="many", i=range(200), x=RNG.normal(0, 1, 200))
    odd = frame(spark, k="odd", i=range(200), x=RNG.exponential(1, 200))
    got = htest.choose_one_sample(few.union(many).union(odd), "x", ["i"], 0.0, ["k"]).collect()
    assert {r["k"]: r["test"] for r in got} == {"few": "t", "many": "z", "odd": "signed_rank"}


def test_incomplete_beta_at_every_size():
    """Half of a fair binomial has the lower tail 1/2 + pmf / 2; a t tail tends to the normal one."""
    import math

    import numpy as np

    from effortloom.functions.special import beta_fraction

    for n in (1e2, 1e4, 1e6, 3e7, 1e9, 1e12):
        pmf = math.exp(math.lgamma(n + 1) - 2 * math.lgamma(n / 2 + 1) - n * math.log(2)) if n < 1e6 else math.sqrt(2 / (math.pi * n)) * math.exp(-1 / (4 * n))
        assert beta_fraction([n / 2], [n / 2 + 1], [0.5])[0] == pytest.approx(0.5 + pmf / 2, abs=1e-9)
        t = 1.96
        tail = beta_fraction([n / 2], [0.5], [n / (n + t * t)], [t * t / (n + t * t)])[0]
        # two terms of the tail's expansion in 1 / n
        want = math.erfc(t / math.sqrt(2)) + 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t**3 + t) / (4 * n)
        assert tail == pytest.approx(want, abs=20 / n**2 + 1e-9)
    grid = np.linspace(0.001, 0.999, 50)
    for a, b in ((0.5, 0.5), (2, 3), (300, 70), (2e5, 3e5)):
        low, high = beta_fraction(a, b, grid), beta_fraction(b, a, 1 - grid)
        assert np.allclose(low + high, 1, atol=1e-9) and (np.diff(low) >= 0).all() and low.min() >= 0 and low.max() <= 1
    assert beta_fraction([2.0, 2.0], [3.0, 3.0], [0.0, 1.0]).tolist() == [0.0, 1.0]


def test_shapiro_of_small_samples(spark):
    samples = {"three": [1, 2, 4], "four": [1, 2, 3, 4], "five": [1, 2, 3, 4, 5], "two": [1, 2], "flat": [3, 3, 3]}
    rows = [(k, i, float(x)) for k, xs in samples.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {r["k"]: (r["statistic"], r["p"]) for r in htest.shapiro(df, "x", ["i"], ["k"]).collect()}
    # Published results of the test.
    for k, w, p in (("three", 0.964286, 0.636886), ("four", 0.992912, 0.971880), ("five", 0.986762, 0.967174)):
        assert got[k] == (pytest.approx(w, abs=2e-5), pytest.approx(p, abs=2e-4))
    assert got["two"] == (None, None) and got["flat"] == (None, None)
