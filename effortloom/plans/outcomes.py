"""Forecasts, savings measures and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortloom.functions.numbers import rnd
from effortloom.operators import costs, esp, export, forecast, htest, linear, ordered, releases, sample, summary
from effortloom.plans import standins as s
from effortloom.plans.registry import query
from effortloom.plans.standins import big, probit_sql, r, sql
from effortloom.plans.stats import COST_CTES, KEYS, costed, ols_sql, rounded
from effortloom.sources.tables import load

MONTHS = 36
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# Forecasts ----------------------------------------------------------------------------------------------------------

# One series per project: release effort in files by month.
_GRID = "SELECT unnest(range(-20, 21)) / CAST(10 AS DOUBLE) AS lam"


def lambda_sql(source: str, by: str, value: str) -> str:
    cut = "CASE WHEN lam = 0 THEN ln(x) ELSE (power(x, lam) - 1) / nullif(lam, 0) END"
    return f"""SELECT {by}, CASE WHEN bool_or(flat) THEN 1 ELSE arg_max(lam, lik) FILTER (NOT flat) END AS lam FROM (
        SELECT {by}, lam, min(x) = max(x) AS flat,
               CASE WHEN min(x) <> max(x) THEN (lam - 1) * sum(ln(x)) - count(*) / 2 * ln(var_pop({cut})) END AS lik
        FROM (SELECT {by}, CAST({value} AS DOUBLE) + 1 AS x FROM {source}), ({_GRID}) GROUP BY {by}, lam) GROUP BY {by}"""


# What the trend is made of: constant, time, ten changes of slope over the first 80 % of the history, five yearly pairs.
_N_TERMS = 22
_DAY = "date_diff('day', DATE '1970-01-01', {0})"


def _terms_sql(day: str, first: str, span: str) -> str:
    t = f"({day} - {first}) / {span}::DOUBLE"
    turn = f"2 * pi() * {day} / 365.25::DOUBLE"
    bends = ", ".join(f"greatest(0::DOUBLE, {t} - 0.8::DOUBLE * {j} / 11)" for j in range(1, 11))
    waves = ", ".join(f"cos({k} * {turn}), sin({k} * {turn})" for k in range(1, 6))
    return f"[1::DOUBLE, {t}, {bends}, {waves}]"


def trend_ctes(source: str, by: str, value: str, prefix: str = "") -> dict[str, str]:
    """Trend of ``value`` in ``source``: the penalised normal equations, solved by Gauss-Jordan elimination, a column of the
    system per step of a recursion."""
    x = prefix
    return {
        f"{x}known": f"SELECT {by}, {_DAY.format('date')} AS d, CAST({value} AS DOUBLE) AS y FROM {source} WHERE {value} IS NOT NULL",
        f"{x}span": f"SELECT {by}, min(d) AS d0, greatest(max(d) - min(d), 1) AS span, count(*) AS n FROM {x}known GROUP BY {by}",
        f"{x}terms": f"SELECT {by}, n, y, list_append({_terms_sql('d', 'd0', 'span')}, y) AS f FROM {x}known JOIN {x}span USING ({by})",
        f"{x}products": f"""SELECT {by}, i, j, sum(f[i] * f[j]) / any_value(n)
            + CASE WHEN i <> j OR i = 1 THEN 0 WHEN i = 2 THEN 1e-6 ELSE 1e-3 END::DOUBLE AS v
            FROM {x}terms, range(1, {_N_TERMS + 1}) a(i), range(1, {_N_TERMS + 2}) b(j) GROUP BY {by}, i, j""",
        f"{x}solved": f"""WITH RECURSIVE g AS (
              SELECT 1 AS k, {by}, i, j, v FROM {x}products
              UNION ALL
              SELECT k + 1, {by}, i, j, CASE WHEN i = k THEN v / corner ELSE v - below * beside / corner END FROM (
                SELECT *, max(v) FILTER (i = k AND j = k) OVER (PARTITION BY {by}) AS corner,
                  max(v) FILTER (j = k) OVER (PARTITION BY {by}, i) AS below, max(v) FILTER (i = k) OVER (PARTITION BY {by}, j) AS beside
                FROM g WHERE k <= {_N_TERMS}))
            SELECT {by}, list(v ORDER BY i) AS coef FROM g WHERE k = {_N_TERMS + 1} AND j = {_N_TERMS + 1} GROUP BY {by}""",
        f"{x}trend": f"""SELECT {by}, s.d0, s.span, m.coef, u.sigma, list_avg(list_transform(m.coef[3:12], lambda c: abs(c))) AS jump
            FROM {x}solved m JOIN {x}span s USING ({by}) JOIN (
              SELECT {by}, sqrt(avg(power(y - list_dot_product(coef, f[1:{_N_TERMS}]), 2))) AS sigma FROM {x}terms JOIN {x}solved USING ({by}) GROUP BY {by}) u USING ({by})""",
    }


def hat_sql(date: str, model: str = "m") -> str:
    """Value of the trend ``model`` on a date."""
    return f"list_dot_product({model}.coef, {_terms_sql(_DAY.format(date), model + '.d0', model + '.span')})"


_SCALED = """SELECT e.project, e.date, CASE WHEN lam = 0 THEN ln(e_module + 1) ELSE (power(e_module + 1::DOUBLE, lam) - 1) / lam END AS z
    FROM release_effort e JOIN lams USING (project)"""
_FUTURE = f"""SELECT project, CAST(last_day(date_trunc('month', d) + to_months(CAST(i AS INTEGER))) AS DATE) AS date FROM (
    SELECT project, max(date) AS d, unnest(range(1, {MONTHS + 1})) AS i FROM release_effort GROUP BY 1)"""
_INV = "CASE WHEN lam = 0 THEN exp({0}) WHEN lam * ({0}) + 1 > 0 THEN power(lam * ({0}) + 1, 1 / lam) END"
_HATS = f"""SELECT x.project, x.date, p.lam, {hat_sql('x.date')} AS zhat,
      sqrt(m.sigma * m.sigma + 10 * 2 / 3::DOUBLE * m.jump * m.jump * power(greatest(0, ({_DAY.format('x.date')} - m.d0) / m.span::DOUBLE - 1), 3)) AS spread
    FROM (SELECT project, date FROM release_effort UNION ALL SELECT * FROM future) x JOIN trend m ON m.project = x.project
    JOIN lams p ON p.project = x.project"""
_FILLED = f"""SELECT *, coalesce(inv, avg(inv) FILTER (age <= {MONTHS - 12}) OVER (PARTITION BY project)) AS yhat FROM (
    SELECT *, {_INV.format('zhat')} AS inv, row_number() OVER (PARTITION BY project ORDER BY date DESC) AS age FROM hats)"""
SERIES_CTES = {
    "lams": lambda_sql("release_effort", "project", "e_module"), "scaled": _SCALED, **trend_ctes("scaled", "project", "z"),
    "future": _FUTURE, "hats": _HATS, "hatted": _FILLED,
}


def _series(spark, d):
    return s.pin(s.release_effort(spark, d).select("project", "version", "date", "e_module", "e_line"))


@query("boxcox_lambda", sql("SELECT project, CAST(lam AS DOUBLE) AS lam FROM lams", **SERIES_CTES))
def boxcox_lambda(spark, d):
    return forecast.boxcox_lambda(s.release_effort(spark, d), ["project"], "e_module")


@query(
    "boxcox_inverse",
    f"""SELECT o_orderkey, {r('exp(o_totalprice / 100000)')} AS log_case, {r('power(0.5 * (o_totalprice / 100000) + 1, 2)')} AS root_case,
        CASE WHEN 1 - 0.5 * (o_totalprice / 100000) > 0 THEN {r('power(1 - 0.5 * (o_totalprice / 100000), -2)', 2)} END AS negative_case FROM orders""",
)
def boxcox_inverse(spark, d):
    y = F.col("o_totalprice") / 100000
    return load(spark, d, "orders").select(
        "o_orderkey", rnd(forecast.boxcox_inverse(y, F.lit(0.0))).alias("log_case"),
        rnd(forecast.boxcox_inverse(y, F.lit(0.5))).alias("root_case"),
        rnd(forecast.boxcox_inverse(y, F.lit(-0.5)), 2).alias("negative_case"),
    )


@query("future_months", sql("SELECT project, CAST(date AS VARCHAR) AS date FROM future", **SERIES_CTES))
def future_months(spark, d):
    rows = forecast.future_months(s.release_effort(spark, d), ["project"], MONTHS)
    return rows.withColumn("date", F.col("date").cast("string"))


@query("forecast_series", sql(f"SELECT project, CAST(date AS VARCHAR) AS date, {r('yhat', 4)} AS yhat FROM hatted", **SERIES_CTES))
def forecast_series(spark, d):
    out = forecast.forecast_series(_series(spark, d), ["project"], "e_module", MONTHS)
    return out.select("project", F.col("date").cast("string").alias("date"), rnd("yhat", 4).alias("yhat"))


_Z90 = "1.6448536269514722"


@query(
    "forecast_interval",
    sql(f"""SELECT project, CAST(date AS VARCHAR) AS date, {r(_INV.format(f'zhat - {_Z90} * spread'), 4)} AS yhat_lower,
            {r(_INV.format(f'zhat + {_Z90} * spread'), 4)} AS yhat_upper FROM hatted""", **SERIES_CTES),
)
def forecast_interval(spark, d):
    out = forecast.forecast_series(_series(spark, d), ["project"], "e_module", MONTHS, interval=True)
    return out.select(
        "project", F.col("date").cast("string").alias("date"), rnd("yhat_lower", 4).alias("yhat_lower"), rnd("yhat_upper", 4).alias("yhat_upper")
    )


@query(
    "constant_series",
    sql("""SELECT project, task, min(t_uc) = max(t_uc) AS constant, CASE WHEN min(t_uc) = max(t_uc) THEN min(t_uc) END AS own_forecast
           FROM dataset GROUP BY 1, 2"""),
)
def constant_series(spark, d):
    return forecast.constant_series(s.dataset(spark, d), KEYS, "t_uc")


DRIVERS = ["nt_ec", "t_line_p"]
_LONG = "SELECT project, task, 'nt_ec' AS variable, date, nt_ec AS val FROM filled UNION ALL SELECT project, task, 't_line_p', date, t_line_p FROM filled"
_BY = "project, task, variable"
_F = "x.project = {0}.project AND x.task = {0}.task AND x.variable = {0}.variable"
EFFORT_CTES = {
    "long": _LONG,
    "flams": lambda_sql("long", _BY, "val"),
    "fscaled": f"""SELECT x.project, x.task, x.variable, x.date, CASE WHEN lam = 0 THEN ln(val + 1) ELSE (power(val + 1::DOUBLE, lam) - 1) / lam END AS z
        FROM long x JOIN flams l ON {_F.format('l')}""",
    **trend_ctes("fscaled", _BY, "z", "f"),
    "ffuture": f"""SELECT project, task, variable, CAST(last_day(date_trunc('month', d) + to_months(CAST(i AS INTEGER))) AS DATE) AS date FROM (
        SELECT project, task, variable, max(date) AS d, unnest(range(1, {MONTHS + 1})) AS i FROM long GROUP BY 1, 2, 3)""",
    "fhats": f"""SELECT x.*, p.lam, {hat_sql('x.date')} AS zhat
        FROM (SELECT DISTINCT project, task, variable, date FROM long UNION ALL SELECT * FROM ffuture) x JOIN ftrend m ON {_F.format('m')}
        JOIN flams p ON {_F.format('p')}""",
    "fhatted": f"""SELECT *, coalesce(inv, avg(inv) FILTER (age <= {MONTHS - 12}) OVER (PARTITION BY {_BY})) AS yhat FROM (
        SELECT *, {_INV.format('zhat')} AS inv, row_number() OVER (PARTITION BY {_BY} ORDER BY date DESC) AS age FROM fhats)""",
    "drivers": """SELECT project, task, date, CAST(CAST(coalesce(max(yhat) FILTER (variable = 'nt_ec'), 0) AS FLOAT) AS DOUBLE) AS nt_ec,
        CAST(CAST(coalesce(max(yhat) FILTER (variable = 't_line_p'), 0) AS FLOAT) AS DOUBLE) AS t_line_p FROM fhatted GROUP BY 1, 2, 3""",
    "emodel": ols_sql("filled", "project, task", "nt_ec", "t_line_p", "module_ec"),
    "predicted": f"""SELECT x.project, x.task, x.date, {r('b0 + b1 * nt_ec + b2 * t_line_p', 2)} AS effort
        FROM drivers x JOIN emodel m ON m.project = x.project AND m.task = x.task""",
}


def _effort(spark, d):
    return forecast.forecast_effort(s.filled(spark, d), KEYS, DRIVERS, "module_ec", MONTHS)


@query("forecast_effort", sql("SELECT project, task, CAST(date AS VARCHAR) AS date, effort AS module_ec FROM predicted", **EFFORT_CTES))
def forecast_effort(spark, d):
    return _effort(spark, d).select(*KEYS, F.col("date").cast("string").alias("date"), "module_ec")


@query(
    "forecast_totals",
    sql(f"""SELECT project, task, year, {r('effort', 2)} AS effort FROM (SELECT project, task, year(date) AS year, sum(effort) AS effort,
            row_number() OVER (PARTITION BY project, task ORDER BY year(date) DESC) AS age FROM predicted GROUP BY 1, 2, 3) WHERE age <= 4""", **EFFORT_CTES),
)
def forecast_totals(spark, d):
    out = _effort(spark, d).withColumnRenamed("module_ec", "effort")
    return rounded(releases.yearly_totals(out, KEYS, ["effort"], years=3), ["effort"], 2)


@query(
    "team_forecast",
    sql(f"""SELECT project, CAST(date AS VARCHAR) AS date, CAST(5 AS DOUBLE) AS t FROM (
            SELECT project, date FROM release_effort UNION ALL SELECT * FROM future)""", **SERIES_CTES),
)
def team_forecast(spark, d):
    rows = _series(spark, d)
    horizon = rows.select("project", "date").unionByName(forecast.future_months(rows, ["project"], MONTHS))
    return horizon.select("project", F.col("date").cast("string").alias("date"), F.lit(5.0).alias("t"))


_BACK = {
    "cutoffs": """SELECT project, CAST(b - 365 - 365 * CAST(unnest(range(0, CAST(floor((date_diff('day', a, b) - 365 - 1825) / 365) AS BIGINT) + 1)) AS INTEGER) AS DATE) AS cutoff
        FROM (SELECT project, min(date) AS a, max(date) AS b FROM release_effort GROUP BY 1) WHERE date_diff('day', a, b) >= 365 + 1825""",
    "past": "SELECT e.project, c.cutoff, e.date, e.e_module AS z FROM release_effort e JOIN cutoffs c ON c.project = e.project WHERE e.date <= c.cutoff",
    **trend_ctes("past", "project, cutoff", "z", "b"),
    "tested": f"""SELECT e.project, c.cutoff, e.date, e.e_module, {hat_sql('e.date')} AS yhat
        FROM release_effort e JOIN cutoffs c ON c.project = e.project AND e.date > c.cutoff AND e.date <= c.cutoff + 365
        JOIN btrend m ON m.project = c.project AND m.cutoff = c.cutoff""",
}


def _backtest(spark, d):
    return forecast.backtest(_series(spark, d), ["project"], "e_module")


@query("backtest", sql(f"SELECT project, CAST(cutoff AS VARCHAR) AS cutoff, CAST(date AS VARCHAR) AS date, {r('yhat', 4)} AS yhat FROM tested", **_BACK))
def backtest(spark, d):
    return _backtest(spark, d).select(
        "project", F.col("cutoff").cast("string").alias("cutoff"), F.col("date").cast("string").alias("date"), rnd("yhat", 4).alias("yhat")
    )


@query(
    "backtest_join",
    sql(f"""SELECT e.project, CAST(e.date AS VARCHAR) AS date, e.e_module, {r('t.yhat', 4)} AS e_module_pred FROM release_effort e
            JOIN (SELECT project, date, avg(yhat) AS yhat FROM tested GROUP BY 1, 2) t ON t.project = e.project AND t.date = e.date""", **_BACK),
)
def backtest_join(spark, d):
    rows = _series(spark, d)
    hats = forecast.backtest(rows, ["project"], "e_module").groupBy("project", "date").agg(F.avg("yhat").alias("yhat"))
    joined = rows.select("project", "date", "e_module").join(hats, ["project", "date"])
    return joined.select("project", F.col("date").cast("string").alias("date"), "e_module", rnd("yhat", 4).alias("e_module_pred"))


@query(
    "backtest_yearly",
    sql(f"""SELECT project, year(date) AS year, {big('sum(e_module)')} AS e_module, {r('sum(yhat)', 4)} AS predicted FROM tested GROUP BY 1, 2""", **_BACK),
)
def backtest_yearly(spark, d):
    out = releases.yearly_totals(_backtest(spark, d).withColumnRenamed("yhat", "predicted"), ["project"], ["e_module", "predicted"])
    return rounded(out, ["predicted"], 4)


# Savings ------------------------------------------------------------------------------------------------------------

_SUMS = """SELECT project, '{unit}' AS model, CAST(coalesce(sum({col}_cc), 0) AS DOUBLE) AS effort_incurred,
    CAST(coalesce(sum({col}_ec), 0) AS DOUBLE) AS effort_saved FROM dataset GROUP BY 1"""
_ESP = "CASE WHEN {i} = 0 THEN {zero} ELSE {other} END"


def esp_cols(i: str, v: str, prefix: str = "") -> str:
    gain = r(f"{v} - {i}", 2)
    e = f"CASE WHEN {i} = 0 THEN {r(gain, 3)} ELSE {r(f'({gain} + {i}) / nullif({i}, 0) - 1', 3)} END"
    return f"{gain} AS {prefix}net_saved, {e} AS {prefix}esp, CASE WHEN 1 + {e} >= 0 THEN {r(f'power(1 + {e}, 1 / 3::DOUBLE) - 1', 3)} END AS {prefix}annualized_esp"


ESP_CTES = {
    "sums": " UNION ALL ".join(_SUMS.format(unit=u, col=u.lower()) for u in ("Module", "Line")),
    "esps": f"SELECT *, {esp_cols('effort_incurred', 'effort_saved')} FROM sums",
}


def _esp_sums(spark, d):
    long = export.long_targets(s.dataset(spark, d)).select(
        "project", F.split_part("model", F.lit("_"), F.lit(1)).alias("model"),
        F.split_part("model", F.lit("_"), F.lit(2)).alias("role"), F.col("y").alias("effort"),
    )
    return esp.esp_sums(long, ["project", "model"])


@query("esp_sums", sql("SELECT * FROM sums", **ESP_CTES))
def esp_sums(spark, d):
    return _esp_sums(spark, d)


@query("esp", sql("SELECT project, model, net_saved, esp FROM esps", **ESP_CTES))
def esp_query(spark, d):
    return esp.with_esp(_esp_sums(spark, d)).select("project", "model", "net_saved", "esp")


@query("esp_annualized", sql("SELECT project, model, annualized_esp FROM esps", **ESP_CTES))
def esp_annualized(spark, d):
    return esp.with_esp(_esp_sums(spark, d)).select("project", "model", "annualized_esp")


@query(
    "esp_table",
    sql("""SELECT project, model, effort_incurred AS "Effort_Incurred", effort_saved AS "Effort_Saved", net_saved AS "Net_Effort_Saved",
           esp AS "ESP", annualized_esp AS "Annualized_ESP" FROM esps""", **ESP_CTES),
)
def esp_table(spark, d):
    return esp.esp_table(_esp_sums(spark, d), ["project", "model"])


_COST_SUM = """SELECT project, task, sum(module_ec) AS effort_cc, sum(module_uc) AS effort_ec, sum(cost) AS cost_cc, sum(cost) / 2 AS cost_ec FROM costed GROUP BY 1, 2"""


@query(
    "cost_esp",
    sql(f"SELECT project, {r('i', 2)} AS cost_incurred, {r('v', 2)} AS cost_saved, {esp_cols('i', 'v', 'cost_')} FROM cs", **COST_CTES, part_costs=_COST_SUM,
        cs="""SELECT project, sum(cost_cc) AS i, coalesce(CASE WHEN sum(cost_cc) > 0 THEN sum(cost_cc) / nullif(sum(effort_cc), 0) * sum(effort_ec) END,
              sum(coalesce(cost_cc / nullif(effort_cc, 0) * effort_ec, cost_ec))) AS v FROM part_costs GROUP BY 1"""),
)
def cost_esp(spark, d):
    """External effort in the place of core effort, unknown effort in the place of external effort."""
    parts = costed(spark, d).groupBy(*KEYS).agg(
        F.sum("module_ec").alias("effort_cc"), F.sum("module_uc").alias("effort_ec"), F.sum("cost").alias("cost_cc"),
        (F.sum("cost") / 2).alias("cost_ec"),
    )
    return rounded(esp.cost_esp(parts, ["project"], ["task"]), ["cost_incurred", "cost_saved"], 2)


_JOINED = """SELECT a.project, a.annualized_esp, b.annualized_esp AS annualized_esp_line FROM esps a
    LEFT JOIN esps b ON b.project = a.project AND b.model = 'Line' WHERE a.model = 'Module'"""


def _esp_joined(spark, d):
    table = s.pin(esp.with_esp(_esp_sums(spark, d)).select("project", "model", "annualized_esp"))
    module = table.where(F.col("model") == "Module").drop("model")
    return esp.esp_join(module, table.where(F.col("model") == "Line").drop("model"))


@query("esp_join", sql("SELECT * FROM joined", **ESP_CTES, joined=_JOINED))
def esp_join(spark, d):
    return _esp_joined(spark, d)


_VAR = "(annualized_esp - annualized_esp_line) * (annualized_esp - annualized_esp_line) / 2"


@query(
    "esp_agreement",
    sql(f"""SELECT project, {r('(annualized_esp + annualized_esp_line) / 2')} AS esp_mean, {r(_VAR)} AS esp_variance, {_VAR} <= 0.04 AS agrees,
            project IN ('1-URGENT', '2-HIGH') AS popular, (annualized_esp + annualized_esp_line) / 2 >= 0 AS saves FROM joined""", **ESP_CTES, joined=_JOINED),
)
def esp_agreement(spark, d):
    out = esp.esp_agreement(_esp_joined(spark, d), "annualized_esp", "annualized_esp_line")
    return out.select(
        "project", rnd("esp_mean").alias("esp_mean"), rnd("esp_variance").alias("esp_variance"), "agrees",
        F.col("project").isin("1-URGENT", "2-HIGH").alias("popular"), (F.col("esp_mean") >= 0).alias("saves"),
    )


# Hypothesis tests ---------------------------------------------------------------------------------------------------


def cdf_sql(z: str) -> str:
    """Normal distribution function as a power series, an independent path to the same number."""
    # phi(z) * sum over k of z^(2k+1) / (2k+1)!!, and (2k+1)!! = 2^(k+1) gamma(k + 3/2) / sqrt(pi)
    term = f"exp((2 * k + 1) * ln(abs({z})) + ln(pi()) / 2 - (k + 1) * ln(2) - lgamma(k + 1.5))"
    return (
        f"(CASE WHEN {z} = 0 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) "
        f"* list_sum([{term} FOR k IN range(0, 200)]) END)"
    )


def _events(spark, d):
    return load(spark, d, "events").select("event_id", "event_type", "value")


_T = "(avg(value) - 50) / (stddev_samp(value) / sqrt(count(value)))"


@query("t_test", f"SELECT event_type, count(value) AS n, {r(_T)} AS statistic FROM events GROUP BY 1")
def t_test(spark, d):
    return rounded(htest.t_test(_events(spark, d), "value", 50.0, ["event_type"], p_value=False), ["statistic"])


# Two-sided Student tail by Simpson's rule over [0, |t|] with 2,000 steps.
_STUDENT = """1 - 2 * abs(t) / 6000 * exp(lgamma(n / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE) - ln((n - 1) * pi()) / 2) * list_sum([
    (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * exp(-n / 2.0::DOUBLE * ln(1 + power(t * i / 2000, 2) / (n - 1))) FOR i IN range(0, 2001)])"""


@query(
    "t_test_p",
    f"SELECT event_type, n, {r('t')} AS statistic, {r(_STUDENT)} AS p FROM (SELECT event_type, count(value) AS n, {_T} AS t FROM events GROUP BY 1)",
)
def t_test_p(spark, d):
    return rounded(htest.t_test(_events(spark, d), "value", 50.0, ["event_type"]), ["statistic", "p"])


@query("z_test", f"SELECT event_type, n, {r('z')} AS statistic, {r(cdf_sql('z'))} AS p FROM (SELECT event_type, count(value) AS n, {_T} AS z FROM events GROUP BY 1)")
def z_test(spark, d):
    return rounded(htest.z_test(_events(spark, d), "value", 50.0, ["event_type"]), ["statistic", "p"])


@query(
    "signed_rank",
    f"""SELECT event_type, n, statistic, {r('z')} AS z, {r(cdf_sql('z'))} AS p FROM (SELECT event_type, n, statistic,
        (statistic - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM (
        SELECT event_type, count(*) AS n, sum(CASE WHEN g > 0 THEN rnk END) AS statistic, sum((c * c * c - c) / c) AS ties FROM (
          SELECT event_type, g, CAST(count(*) OVER (PARTITION BY event_type, abs(g)) AS DOUBLE) AS c,
                 rank() OVER (PARTITION BY event_type ORDER BY abs(g)) + (count(*) OVER (PARTITION BY event_type, abs(g)) - 1) / 2 AS rnk
          FROM (SELECT event_type, value - 35 AS g FROM events) WHERE g <> 0) GROUP BY 1))""",
)
def signed_rank(spark, d):
    return rounded(htest.signed_rank(_events(spark, d), "value", 35.0, ["event_type"]), ["z", "p"])


def drawn_sql(n: int, where: str = "true") -> str:
    return f"""SELECT * FROM events WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', '0', CAST(event_id AS VARCHAR))), event_id) <= {n}"""


def ranked_sql(source: str, sample: str, value: str) -> str:
    return f"""SELECT {sample} AS g, {value} AS x, CAST(count(*) OVER (PARTITION BY {value}) AS DOUBLE) AS c,
        rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2 AS rnk, CAST(count(*) OVER () AS DOUBLE) AS size
        FROM ({source})"""


def mann_sql(ranks: str, a: str, b: str) -> str:
    return f"""SELECT n1, n2, u AS statistic, {r('z')} AS z, {r(f'least(2 * (1 - {cdf_sql("z")}), 1)')} AS p FROM (SELECT *,
        (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt((1 - ties / (size * size * size - size)) * n1 * n2 * (size + 1) / 12) AS z FROM (
        SELECT CAST(count(*) FILTER (g = '{a}') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = '{b}') AS DOUBLE) AS n2, any_value(size) AS size,
        sum(rnk) FILTER (g = '{a}') - count(*) FILTER (g = '{a}') * (count(*) FILTER (g = '{a}') + 1) / 2 AS u,
        sum((c * c * c - c) / c) AS ties FROM ({ranks})))"""


def kruskal_sql(ranks: str) -> str:
    """For five samples: four degrees of freedom."""
    return f"""SELECT samples, n, {r('h')} AS statistic, {r('exp(-h / 2) * (1 + h / 2)')} AS p FROM (SELECT count(*) AS samples, CAST(any_value(size) AS BIGINT) AS n,
        (12 / (any_value(size) * (any_value(size) + 1)) * sum(rs * rs / m) - 3 * (any_value(size) + 1))
        / (1 - sum(ties) / (any_value(size) * any_value(size) * any_value(size) - any_value(size))) AS h FROM (
        SELECT g, sum(rnk) AS rs, count(*) AS m, any_value(size) AS size, sum((c * c * c - c) / c) AS ties FROM ({ranks}) GROUP BY 1))"""


@query(
    "mann_whitney",
    mann_sql(ranked_sql("SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')", "o_orderpriority", "o_totalprice"), "1-URGENT", "5-LOW"),
)
def mann_whitney(spark, d):
    rows = load(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    return rounded(htest.mann_whitney(rows, "o_totalprice", "o_orderpriority", "1-URGENT", "5-LOW"), ["z", "p"])


@query("kruskal", kruskal_sql(ranked_sql("SELECT * FROM orders", "o_orderpriority", "o_totalprice")))
def kruskal(spark, d):
    rows = load(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    return rounded(htest.kruskal(rows, "o_totalprice", "o_orderpriority", PRIORITIES), ["statistic", "p"])


_SHARE = "SELECT o_orderpriority, count(*) FILTER (o_totalprice >= 255000) AS k, count(*) AS n FROM orders GROUP BY 1"


def _share(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_totalprice") >= 255000).alias("k"), F.count(F.lit(1)).alias("n")
    )


@query(
    "proportion_z",
    f"""SELECT o_orderpriority, k, n, {r('z')} AS z, {r(cdf_sql('z'))} AS p FROM (SELECT *,
        (k / n - 0.5) / sqrt(k / n * (1 - k / n) / n) AS z FROM ({_SHARE}))""",
)
def proportion_z(spark, d):
    z, p = htest.proportion_z(F.col("k"), F.col("n"), 0.5)
    return _share(spark, d).select("o_orderpriority", "k", "n", rnd(z).alias("z"), rnd(p).alias("p"))


@query(
    "binomial_test",
    f"""SELECT o_orderpriority, k, n, {r('list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) FOR i IN range(0, k + 1)])')} AS p
        FROM ({_SHARE})""",
)
def binomial_test(spark, d):
    return _share(spark, d).select("o_orderpriority", "k", "n", rnd(htest.binomial_test(F.col("k"), F.col("n"), 0.5)).alias("p"))


@query("clt_check", f"SELECT o_orderpriority, n * (k / n) > 5 AS successes, n * (1 - k / n) > 5 AS failures FROM ({_SHARE})")
def clt_check(spark, d):
    yes, no = htest.clt_check(F.col("k"), F.col("n"))
    return _share(spark, d).select("o_orderpriority", yes.alias("successes"), no.alias("failures"))


def shapiro_sql(source: str) -> str:
    """Royston's W and p for samples of 12 or more rows."""
    return f"""SELECT event_type, CAST(n AS BIGINT) AS n, w, 1 - {cdf_sql('zz')} AS p FROM (SELECT *,
        (ln(1 - w) - (0.0038915 * power(ln(n), 3) - 0.083751 * power(ln(n), 2) - 0.31082 * ln(n) - 1.5861))
        / exp(0.0030302 * power(ln(n), 2) - 0.082676 * ln(n) - 0.4803) AS zz FROM (SELECT *,
        least(power(mx / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * (xn - x1) + a2 * (xn1 - x2), 2) / ss, 1) AS w FROM (SELECT *,
        -2.706056 * power(u, 5) + 4.434685 * power(u, 4) - 2.071190 * power(u, 3) - 0.147981 * u * u + 0.221157 * u + m1 / sqrt(mm) AS a1,
        -3.582633 * power(u, 5) + 5.682633 * power(u, 4) - 1.752461 * power(u, 3) - 0.293762 * u * u + 0.042981 * u + m2 / sqrt(mm) AS a2 FROM (
        SELECT event_type, CAST(count(*) AS DOUBLE) AS n, 1 / sqrt(count(*)) AS u, sum(m * m) AS mm, sum(m * x) FILTER (i >= 2 AND i < c - 2) AS mx,
        var_pop(x) * count(*) AS ss, max(m) FILTER (i = c - 1) AS m1, max(m) FILTER (i = c - 2) AS m2, max(x) FILTER (i = 0) AS x1,
        max(x) FILTER (i = 1) AS x2, max(x) FILTER (i = c - 1) AS xn, max(x) FILTER (i = c - 2) AS xn1 FROM (
        SELECT *, {probit_sql('((i + 1 - 0.375) / (c + 0.25::DOUBLE))')} AS m FROM (
        SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS c FROM ({source}))) GROUP BY 1))))"""


@query("shapiro", f"SELECT event_type, n, {r('w')} AS statistic, {r('p')} AS p FROM ({shapiro_sql('SELECT * FROM events')})")
def shapiro(spark, d):
    return rounded(htest.shapiro(_events(spark, d), "value", ["event_id"], ["event_type"]), ["statistic", "p"])


def choice_sql(source: str, center: str = "50") -> str:
    ranks = f"""SELECT event_type, (statistic - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS sz FROM (
        SELECT event_type, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN g > 0 THEN rnk END) AS statistic, sum((c * c * c - c) / c) AS ties FROM (
          SELECT event_type, g, CAST(count(*) OVER (PARTITION BY event_type, abs(g)) AS DOUBLE) AS c,
                 rank() OVER (PARTITION BY event_type ORDER BY abs(g)) + (count(*) OVER (PARTITION BY event_type, abs(g)) - 1) / 2 AS rnk
          FROM (SELECT event_type, value - {center} AS g FROM ({source})) WHERE g <> 0) GROUP BY 1)"""
    return f"""SELECT event_type, n, normal_p, test, p, p > 0.05 AS likely FROM (SELECT event_type, n, normal_p,
        CASE WHEN NOT normal_p > 0.05 THEN 'signed_rank' WHEN n <= 30 THEN 't' ELSE 'z' END AS test,
        CASE WHEN NOT normal_p > 0.05 THEN {cdf_sql('sz')} WHEN n <= 30 THEN {_STUDENT} ELSE {cdf_sql('t')} END AS p FROM (
        SELECT w.event_type, w.n, w.p AS normal_p, k.sz, m.t FROM ({shapiro_sql(source)}) w JOIN ({ranks}) k USING (event_type)
        JOIN (SELECT event_type, {_T} AS t FROM ({source}) GROUP BY 1) m USING (event_type)))"""


@query(
    "test_choice",
    f"SELECT event_type, n, {r('normal_p')} AS normal_p, test, {r('p')} AS p, likely FROM ({choice_sql('SELECT * FROM events')})",
)
def test_choice(spark, d):
    return rounded(htest.choose_one_sample(_events(spark, d), "value", ["event_id"], 50.0, ["event_type"]), ["normal_p", "p"])


_H1 = drawn_sql(276)


def _h1_ci(sign: str) -> str:
    return r(f"{r('avg(value)', 2)} {sign} 1.959963984540054 * {r('stddev_samp(value)', 2)} / sqrt(count(*))")


@query(
    "h_one",
    f"""SELECT d.*, {r('c.normal_p')} AS normal_p, c.test, {r('c.p')} AS p, c.likely FROM (SELECT event_type, count(value) AS count,
        {r('avg(value)', 2)} AS mean, {r('median(value)', 2)} AS median, {r('stddev_samp(value)', 2)} AS std, {r('min(value)', 2)} AS min,
        {r('max(value)', 2)} AS max, {_h1_ci('-')} AS low, {_h1_ci('+')} AS high FROM ({_H1}) GROUP BY 1) d JOIN ({choice_sql(_H1)}) c USING (event_type)""",
)
def h_one(spark, d):
    """One sample per event type: draw 276 rows, describe them, choose a test."""
    drawn = s.pin(sample.seeded_sample(_events(spark, d), ["event_id"], 276, ["event_type"]))
    stats = summary.sample_stats(drawn, "value", ["event_type"], bounded=True)
    ci = summary.normal_ci(drawn, "value", ["event_type"]).drop("n")
    verdict = htest.choose_one_sample(drawn, "value", ["event_id"], 50.0, ["event_type"], bounded=True).drop("n")
    return rounded(ordered.attach(ordered.attach(stats, ci, ["event_type"]), verdict, ["event_type"]), ["low", "high", "normal_p", "p"])


@query("h_two", mann_sql(ranked_sql(drawn_sql(64, "event_type IN ('view', 'click')"), "event_type", "value"), "view", "click"))
def h_two(spark, d):
    """Two samples of 64 rows, compared by ranks."""
    rows = _events(spark, d).where(F.col("event_type").isin("view", "click"))
    drawn = s.pin(sample.seeded_sample(rows, ["event_id"], 64, ["event_type"]))
    return rounded(htest.mann_whitney(drawn, "value", "event_type", "view", "click", bounded=True), ["z", "p"])


@query("h_many", kruskal_sql(ranked_sql(drawn_sql(64), "event_type", "value")))
def h_many(spark, d):
    """Samples of 64 rows of every event type, compared by ranks."""
    drawn = s.pin(sample.seeded_sample(_events(spark, d), ["event_id"], 64, ["event_type"]))
    return rounded(htest.kruskal(drawn, "value", "event_type", EVENT_TYPES, bounded=True), ["statistic", "p"])
