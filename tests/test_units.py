"""Golden values of the small expressions."""

import math

import pytest
from pyspark.sql import functions as F

from effortloom.functions import numbers, text
from effortloom.operators import clean, costs, esp, forecast, metrics, summary


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_labels(spark):
    assert one(spark, text.format_pred("25", F.lit(0.25))) == "Pred - PRED (25): 25.00%"
    assert one(spark, text.format_metric("Model - R Squared", F.lit(0.25))) == "Model - R Squared: 0.25"
    assert one(spark, text.effort_unit(F.lit("Module_CC"))) == "Files" and one(spark, text.effort_unit(F.lit("Line"))) == "LOC"


def test_regular_versions(spark):
    versions = ["v3.4.5.6", "v3.4.5-rc1", "v3.4", "3.4.55", None, "v3", "version"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    assert sorted(r["v"] for r in df.where(text.is_regular_version("v")).collect()) == ["3.4.55", "v3.4", "v3.4.5.6"]


def test_repository_keys(spark):
    url = F.lit("https://api.github.com/repos/owner/name")
    assert one(spark, text.repo_key(url)) == "owner/name" and one(spark, text.repo_short(text.repo_key(url))) == "name"


@pytest.mark.parametrize("y,p,want", [(0.0, 2.0, 2.0), (0.0, 0.0, 0.0), (18.0, 9.8, 0.46), (1093.0, 403.0, 0.63)])
def test_percent_error(spark, y, p, want):
    assert one(spark, numbers.percent_error(F.lit(y), F.lit(p))) == want
    assert one(spark, numbers.percent_error(F.lit(y), F.lit(p), "zero")) == (0.0 if y == 0 else want)
    endless = one(spark, numbers.percent_error(F.lit(y), F.lit(p), "infinite"))
    assert endless == (want if y else (math.inf if p else 0.0))


def test_missing_share_and_all_same(spark):
    df = spark.createDataFrame([(1, 2), (3, None), (5, 6)], "a int, b int")
    assert clean.missing_share(df, ["a", "b"]).first()["p_na"] == 0.167
    same = spark.createDataFrame([("x", 1)] * 6 + [("y", 1), ("y", 2)], "k string, v int")
    assert {r["k"]: r["all_same"] for r in summary.all_same(same, "v", ["k"]).collect()} == {"x": True, "y": False}


def test_savings(spark):
    df = spark.createDataFrame([(182389.0, 1863864.0), (0.0, 5.0), (10.0, 0.0)], "effort_incurred double, effort_saved double")
    got = [tuple(r)[2:] for r in esp.with_esp(df).collect()]
    assert got == [(1681475.0, 9.219, 1.17), (5.0, 5.0, 0.817), (-10.0, -1.0, -1.0)]
    assert one(spark, esp.annualized(F.lit(9.2), 3)) == 1.169
    assert one(spark, esp.annualized(F.lit(-1.5), 3)) is None


def test_cost_savings_without_core_effort(spark):
    df = spark.createDataFrame([("p", "a", 0.0, 5.0, 0.0, 70.0), ("q", "a", 10.0, 5.0, 100.0, 9.0)], "project string, task string, effort_cc double, effort_ec double, cost_cc double, cost_ec double")
    got = {r["project"]: (r["cost_incurred"], r["cost_saved"], r["cost_esp"]) for r in esp.cost_esp(df, ["project"], ["task"]).collect()}
    assert got == {"p": (0.0, 70.0, 70.0), "q": (100.0, 50.0, -0.5)}


def test_rounding_is_half_even(spark):
    assert one(spark, numbers.rnd(F.lit(0.125), 2)) == 0.12 and one(spark, numbers.rnd(F.lit(0.375), 2)) == 0.38
    assert str(one(spark, numbers.rnd(F.lit(-0.001), 2))) == "0.0"


def test_nonfinite_and_logs(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (float("inf"), "b"), (-float("inf"), "c"), (None, "d"), (2.0, "e")], "x double, k string")
    assert [r["x"] for r in numbers.zero_nonfinite(df, ["x"]).orderBy("k").collect()] == [0.0, 0.0, 0.0, 0.0, 2.0]
    logs = numbers.log_transform_numeric(df.where("k = 'e'")).first()
    assert math.isclose(logs["x"], math.log(3)) and logs["k"] == "e"


def test_contributors(spark):
    assert one(spark, costs.min_contrib(F.lit(0), F.lit(3))) == 1 and one(spark, costs.min_contrib(F.lit(0), F.lit(0))) == 0
    assert one(spark, costs.calculate_contribs(F.lit(30), F.lit(8.0), F.lit(5))) == 3.75
    assert one(spark, costs.calculate_contribs(F.lit(30), F.lit(0.0), F.lit(5))) == 0.0


def test_scalers_on_constant_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    assert {(r["k"], r["x"]) for r in clean.normalize(df, "x", ["k"]).collect()} == {("a", None), ("b", 0.0), ("b", 1.0)}
    assert {(r["k"], r["x"]) for r in clean.standardize(df, "x", ["k"], population=True).collect()} == {("a", 0.0), ("b", -1.0), ("b", 1.0)}


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, f string")
    assert [tuple(r) for r in clean.hot_encode(df, "f", ["x", "y"]).orderBy("i").collect()] == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    assert sorted(tuple(r) for r in clean.hot_long(df, ["i"], "f").collect()) == [(1, "x", 1), (2, "y", 1)]


def test_best_model(spark):
    df = spark.createDataFrame([("p", "b", 0.5), ("p", "a", 0.5), ("q", "a", 0.1), ("q", "b", 0.2)], "k string, model string, s double")
    assert {r["k"]: r["model"] for r in metrics.best_model(df, ["k"], "s").collect()} == {"p": "a", "q": "b"}


def test_boxcox(spark):
    for lam in (-1.5, 0.0, 0.5, 2.0):
        z = forecast.boxcox(F.lit(7.0), F.lit(lam))
        assert math.isclose(one(spark, forecast.boxcox_inverse(z, F.lit(lam))), 7.0)
    assert one(spark, forecast.boxcox_inverse(F.lit(-3.0), F.lit(0.5))) is None


def test_month_ends_follow_the_last_date(spark):
    df = spark.sql("SELECT 'a' AS k, DATE '2020-01-15' AS date UNION ALL SELECT 'b', DATE '2020-01-31'")
    out = forecast.future_months(df, ["k"], 2)
    assert sorted((r["k"], str(r["date"])) for r in out.collect()) == [
        ("a", "2020-01-31"), ("a", "2020-02-29"), ("b", "2020-02-29"), ("b", "2020-03-31")
    ]


def test_team_size_replaces_the_driver(spark):
    df = spark.sql("SELECT 'a' AS k, add_months(DATE '2018-01-31', CAST(id AS INT)) AS date, CAST(id % 5 AS DOUBLE) AS t, CAST(id AS DOUBLE) AS nt, 2.0D * id + (id % 5) AS y FROM range(40)")
    out = forecast.forecast_effort(df, ["k"], ["nt", "t"], "y", 36, team_size=5)
    assert out.count() == 76 and {r["t"] for r in out.collect()} == {5.0}


def test_constant_series_forecasts_itself(spark):
    df = spark.sql("SELECT 'a' AS k, add_months(DATE '2018-01-31', CAST(id AS INT)) AS date, 4 AS y FROM range(30)")
    out = forecast.forecast_series(df, ["k"], "y", 24, undo_shift=True, interval=True)
    assert out.count() == 54 and all(math.isclose(r["yhat"], 4.0) and math.isclose(r["yhat_upper"], 4.0) for r in out.collect())
