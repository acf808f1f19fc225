"""The trend against a closed form, planted breaks and odd histories."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effortloom.operators import forecast, trend

START = datetime.date(2015, 1, 31)


def months(n):
    out = []
    for i in range(n):
        y, m = divmod(START.month - 1 + i, 12)
        nxt = datetime.date(START.year + y + (m == 11), (m + 1) % 12 + 1, 1)
        out.append(nxt - datetime.timedelta(days=1))
    return out


def broken(d, at=60):
    t = (d - START).days / 365.25
    return 20 + 12 * t - 20 * max(0.0, t - at / 12) + 3 * math.sin(2 * math.pi * t)


def plain_fit(rows, where):
    """Ridge least squares on stacked rows: penalties as extra observations."""
    day = np.array([(d - datetime.date(1970, 1, 1)).days for d, _ in rows], dtype=float)
    y = np.array([v for _, v in rows], dtype=float)
    first, span = day.min(), max(day.max() - day.min(), 1)

    def design(x):
        t = (x - first) / span
        w = 2 * np.pi * x / 365.25
        cols = [t**0, t] + [np.clip(t - 0.8 * j / 11, 0, None) for j in range(1, 11)]
        return np.column_stack(cols + [f(k * w) for k in range(1, 6) for f in (np.cos, np.sin)])

    pen = np.diag(np.sqrt(len(y) * np.array([0, 1e-6] + [1e-3] * 20)))
    beta = np.linalg.lstsq(np.vstack([design(day), pen]), np.concatenate([y, np.zeros(22)]), rcond=None)[0]
    sigma = math.sqrt(((y - design(day) @ beta) ** 2).mean())
    at = np.array([(d - datetime.date(1970, 1, 1)).days for d in where], dtype=float)
    ahead = np.clip((at - first) / span - 1, 0, None)
    jump = np.abs(beta[2:12]).mean()
    return design(at) @ beta, np.sqrt(sigma**2 + 20 / 3 * jump**2 * ahead**3)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    dates = months(96)
    rows = [("a", d, broken(d) + rng.normal(0, 0.5)) for d in dates]
    rows += [("b", d, float(i)) for i, d in enumerate(dates[:5])] + [("c", dates[3], 7.0)] * 4
    rows += [(None, d, 3.0) for d in dates[:20]] + [("a", dates[0], None)]
    rows += [("d", dates[i % 7], float(i % 11)) for i in range(3000)]  # few days, many rows
    return rows


def test_fit_equals_least_squares(spark, series):
    df = spark.createDataFrame(series, "k string, date date, y double").repartition(4)
    ahead = months(130)[90:]
    model = trend.fit_trend(df, ["k"], "y")
    assert model.count() == 5
    rows = spark.createDataFrame([(k, d) for k in ("a", "b", "c", "d", None) for d in ahead], "k string, date date")
    out = trend.apply_trend(rows, model, ["k"], "date", "yhat", "spread").collect()
    assert len(out) == 5 * len(ahead)
    for k in ("a", "b", "c", "d", None):
        want, spread = plain_fit([(d, y) for key, d, y in series if key == k and y is not None], ahead)
        got = {r["date"]: (r["yhat"], r["spread"]) for r in out if r["k"] == k}
        assert [got[d][0] for d in ahead] == pytest.approx(want.tolist(), rel=1e-6, abs=1e-6)
        assert [got[d][1] for d in ahead] == pytest.approx(spread.tolist(), rel=1e-5, abs=1e-5)


def test_breaks_are_followed(spark, series):
    """On a series whose slope turns, the forecast of the next year beats that of a straight line with month effects."""
    df = spark.createDataFrame([r for r in series if r[0] == "a"], "k string, date date, y double").where("y IS NOT NULL")
    ahead = months(108)[96:]
    rows = spark.createDataFrame([("a", d) for d in ahead], "k string, date date")
    got = {r["date"]: r["yhat"] for r in trend.apply_trend(rows, trend.fit_trend(df, ["k"], "y"), ["k"]).collect()}
    past = [(d, y) for k, d, y in series if k == "a" and y is not None]
    t = np.array([(d - START).days / 365.25 for d, _ in past])
    slope, base = np.polyfit(t, [y for _, y in past], 1)
    off = {m: np.mean([y - base - slope * (d - START).days / 365.25 for d, y in past if d.month == m]) for m in range(1, 13)}
    line = {d: base + slope * (d - START).days / 365.25 + off[d.month] for d in ahead}
    true = {d: broken(d) for d in ahead}
    miss = np.mean([abs(got[d] - true[d]) for d in ahead])
    assert miss < 0.25 * np.mean([abs(line[d] - true[d]) for d in ahead])


def test_a_history_told_twice_has_one_trend(spark, series):
    df = spark.createDataFrame([r for r in series if r[0] == "a"], "k string, date date, y double")
    once, twice = (trend.fit_trend(x, ["k"], "y").first() for x in (df, df.unionAll(df)))
    assert once["coef"] == pytest.approx(twice["coef"], rel=1e-9, abs=1e-9) and once["sigma"] == pytest.approx(twice["sigma"])


def test_many_keys_and_empty(spark):
    df = spark.range(3000).select(
        (F.col("id") % 300).alias("p"), F.lit("x").alias("q"),
        F.expr("date_add(DATE '2020-01-01', CAST(id / 300 AS INT) * 31)").alias("date"), (F.col("id") % 7).alias("y"),
    )
    assert trend.fit_trend(df, ["p", "q"], "y").count() == 300
    assert trend.fit_trend(df.limit(0), ["p"], "y").count() == 0


def test_band_widens_with_the_distance(spark, series):
    df = spark.createDataFrame([r for r in series if r[0] == "a" and r[2]], "k string, date date, y double")
    out = forecast.forecast_series(df, ["k"], "y", 36, interval=True).orderBy("date").collect()
    assert len(out) == 132 and all(r["yhat"] is not None for r in out)
    band = [(r["yhat_lower"], r["yhat"], r["yhat_upper"]) for r in out]
    assert all(a is None or b is None or c is None or a <= b <= c for a, b, c in band)
