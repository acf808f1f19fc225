"""Descriptive statistics, correlations, scalings, models and their accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortloom.functions import numbers
from effortloom.functions.numbers import rnd
from effortloom.functions.special import norm_ppf
from effortloom.operators import (
    clean, correlate, costs, export, folds, linear, metrics, models, neighbors, ordered, pipeline, scale, summary, tree,
)
from effortloom.operators import isotonic as monotone
from effortloom.operators.calendar import business_calendar, business_hours, previous_date
from effortloom.operators.releases import SERIES_ORDER
from effortloom.plans import standins as s
from effortloom.plans.registry import query
from effortloom.plans.standins import big, holiday, probit_sql, r, sql
from effortloom.sources.tables import load

KEYS = ["project", "task"]
ORDER = list(SERIES_ORDER)
XS = ["nt_ec", "t_line_p"]
_W = "WINDOW w AS (PARTITION BY project, task ORDER BY date, t_line, version)"


def rounded(df, names, digits=6):
    return df.withColumns({n: rnd(n, digits) for n in names})


@query(
    "missing_share",
    sql(f"""SELECT project, task, {r("avg(CAST(nt_cc IS NULL AS INT) + CAST(no_cc IS NULL AS INT) + CAST(t_cc IS NULL AS INT) + CAST(t_line_p IS NULL AS INT)) / 4", 3)} AS p_na
            FROM lagged GROUP BY 1, 2"""),
)
def missing_share(spark, d):
    from effortloom.operators.releases import lag_totals

    rows = lag_totals(s.dataset(spark, d), KEYS, bounded=True)
    return clean.missing_share(rows, ["nt_cc", "no_cc", "t_cc", "t_line_p"], KEYS)


@query("all_same", sql("SELECT project, task, min(t_uc) = max(t_uc) AS all_same FROM dataset GROUP BY 1, 2"))
def all_same(spark, d):
    return summary.all_same(s.dataset(spark, d), "t_uc", KEYS)


_Q = "quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75"


@query(
    "describe",
    f"""SELECT event_type, count, {r('mean')} AS mean, {r('std')} AS std, min, max, {r('q25')} AS q25, {r('q50')} AS q50, {r('q75')} AS q75
        FROM (SELECT event_type, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
              {_Q} FROM events GROUP BY 1)""",
)
def describe(spark, d):
    out = summary.describe(load(spark, d, "events").select("event_type", "value"), "value", ["event_type"])
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


@query(
    "sample_stats",
    f"""SELECT event_type, count(value) AS count, {r('avg(value)', 2)} AS mean, {r('median(value)', 2)} AS median,
        {r('stddev_samp(value)', 2)} AS std, {r('min(value)', 2)} AS min, {r('max(value)', 2)} AS max FROM events GROUP BY 1""",
)
def sample_stats(spark, d):
    return summary.sample_stats(load(spark, d, "events").select("event_type", "value"), "value", ["event_type"])


def _ci(sign: str) -> str:
    return r(f"{r('avg(o_totalprice)', 2)} {sign} 1.959963984540054 * {r('stddev_samp(o_totalprice)', 2)} / sqrt(count(*))", 4)


@query("normal_ci", f"SELECT o_orderpriority, count(*) AS n, {_ci('-')} AS low, {_ci('+')} AS high FROM orders GROUP BY 1")
def normal_ci(spark, d):
    return rounded(summary.normal_ci(load(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), ["low", "high"], 4)


@query(
    "row_mean_var",
    sql(f"""SELECT project, version, task, {r('(module_cc + module_ec) / 2.0')} AS mean,
            {r('(module_cc - module_ec) * (module_cc - module_ec) / 2.0')} AS variance FROM dataset"""),
)
def row_mean_var(spark, d):
    mean, variance = summary.row_mean_var("module_cc", "module_ec")
    return s.dataset(spark, d).select("project", "version", "task", rnd(mean).alias("mean"), rnd(variance).alias("variance"))


@query(
    "histogram",
    """WITH e AS (SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
       SELECT event_type, CAST(least(floor((value - low) / (high - low) * 20), 19) AS INTEGER) AS bin, count(*) AS n
       FROM events JOIN e USING (event_type) GROUP BY 1, 2""",
)
def histogram(spark, d):
    return summary.histogram(load(spark, d, "events").select("event_type", "value"), "value", 20, ["event_type"])


@query(
    "boxplot_stats",
    f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3
                   FROM events GROUP BY 1),
             x AS (SELECT e.event_type, e.value, q.*, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
                   FROM events e JOIN q ON q.event_type = e.event_type)
        SELECT event_type, {r('any_value(q1)')} AS q1, {r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3,
               min(value) FILTER (ok) AS whisker_low, max(value) FILTER (ok) AS whisker_high, count(*) FILTER (NOT ok) AS outliers
        FROM x GROUP BY 1""".replace("q.*, value", "q1, median, q3, value"),
)
def boxplot_stats(spark, d):
    out = summary.boxplot_stats(load(spark, d, "events").select("event_type", "value"), "value", ["event_type"])
    return rounded(out, ["q1", "median", "q3"])


@query(
    "tail_mean",
    f"""SELECT event_type, {r('avg(value)')} AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn <= 30 GROUP BY 1""",
)
def tail_mean(spark, d):
    rows = load(spark, d, "events").select("event_type", "ts", "event_id", "value")
    return rounded(costs.tail_mean(rows, ["event_type"], ["ts", "event_id"], "value", "mean"), ["mean"])


_FOLD = "least(10, n)"


def fold_sql(source: str, by: str, order: str, columns: str) -> str:
    return f"""SELECT {columns}, CAST(CASE WHEN i < (n % {_FOLD}) * (n // {_FOLD} + 1) THEN i // (n // {_FOLD} + 1)
        ELSE n % {_FOLD} + (i - (n % {_FOLD}) * (n // {_FOLD} + 1)) // (n // {_FOLD}) END AS INTEGER) AS fold
        FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source})"""


@query("kfold_assign", fold_sql("events", "event_type", "ts, event_id", "event_id"))
def kfold_assign(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "ts")
    return folds.kfold_assign(rows, ["event_type"], ["ts", "event_id"]).select("event_id", "fold")


@query(
    "avg_rank",
    """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
       + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rank FROM events""",
)
def avg_rank(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    return ordered.average_rank(rows, ["event_type"], "value").select("event_id", "rank")


@query(
    "qq_points",
    f"""SELECT event_type, value, {r(probit_sql('((i + 0.5::DOUBLE) / n)'))} AS theoretical FROM (SELECT event_type, value,
        row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)""",
)
def qq_points(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    placed = ordered.ordered(rows, ["event_type"], ["value", "event_id"], position="i", size="n")
    return placed.select("event_type", "value", rnd(norm_ppf((F.col("i") + 0.5) / F.col("n"))).alias("theoretical"))


_PAIRS = correlate.effort_pairs()
_CORR_INPUT = f"SELECT project, task, version, coalesce(t_line_p, 0) AS t_line, coalesce(t_module_p, 0) AS t_module, {', '.join(f'coalesce({c}, 0) AS {c}' for c in s.WIDE)} FROM lagged"


def _corr_sql(a: str, b: str, digits: int = 6) -> str:
    return f"CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN {r(f'corr({a}, {b})', digits)} END"


@query(
    "pearson_pairs",
    sql(f"SELECT project, task, {', '.join(f'{_corr_sql(a, b)} AS {a}__{b}' for a, b in _PAIRS)} FROM ci GROUP BY 1, 2", ci=_CORR_INPUT),
)
def pearson_pairs(spark, d):
    rows = correlate.lagged_inputs(s.dataset(spark, d), KEYS, bounded=True)
    return rounded(correlate.pearson_pairs(rows, KEYS, _PAIRS), [f"{a}__{b}" for a, b in _PAIRS])


_RANKED = ", ".join(
    f"rank() OVER (PARTITION BY project, task ORDER BY {c}) + (count(*) OVER (PARTITION BY project, task, {c}) - 1) / 2 AS {c}"
    for c in sorted({c for p in _PAIRS for c in p})
)


@query(
    "spearman_pairs",
    sql(f"SELECT project, task, {', '.join(f'{_corr_sql(a, b)} AS {a}__{b}' for a, b in _PAIRS)} FROM rk GROUP BY 1, 2",
        ci=_CORR_INPUT, rk=f"SELECT project, task, {_RANKED} FROM ci"),
)
def spearman_pairs(spark, d):
    rows = correlate.lagged_inputs(s.pinned_dataset(spark, d), KEYS, bounded=True)
    out = correlate.spearman_pairs(rows, KEYS, ["version"], _PAIRS, bounded=True)
    return rounded(out, [f"{a}__{b}" for a, b in _PAIRS])


_REPORT = ", ".join(f"concat('E_{a} => {b}: ', coalesce(printf('%.4f', {a}__{b}), 'nan'))" for a, b in _PAIRS)


@query(
    "corr_report",
    sql(
        f"SELECT project, task, concat_ws(chr(10), concat(project, ':', task, ' - Pearsons correlation:'), {_REPORT}) AS value FROM pr",
        ci=_CORR_INPUT, pr=f"SELECT project, task, {', '.join(f'{_corr_sql(a, b, 4)} AS {a}__{b}' for a, b in _PAIRS)} FROM ci GROUP BY 1, 2",
    ),
)
def corr_report(spark, d):
    rows = correlate.lagged_inputs(s.dataset(spark, d), KEYS, bounded=True)
    return correlate.correlation_report(correlate.pearson_pairs(rows, KEYS, _PAIRS), KEYS, _PAIRS, "Pearsons")


_M = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS r FROM lineitem GROUP BY 1"
        for i, a in enumerate(_M) for b in _M[i:]
    ),
)
def corr_matrix(spark, d):
    return rounded(correlate.corr_matrix(load(spark, d, "lineitem"), _M, ["l_returnflag"]), ["r"])


def _ss(a, b):
    return f"sum({a} * {b})"


@query(
    "vif2",
    f"SELECT l_returnflag, {r('1 / (1 - power(sum(l_quantity * l_discount), 2) / (sum(l_quantity * l_quantity) * sum(l_discount * l_discount)))')} AS vif_l_quantity, "
    f"{r('1 / (1 - power(sum(l_quantity * l_discount), 2) / (sum(l_quantity * l_quantity) * sum(l_discount * l_discount)))')} AS vif_l_discount "
    "FROM lineitem GROUP BY 1",
)
def vif2(spark, d):
    out = correlate.vif(load(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    return rounded(out, ["vif_l_quantity", "vif_l_discount"])


_V3 = ["l_quantity", "l_discount", "l_tax"]


def _vif3(i: int) -> str:
    j, k = [x for x in range(3) if x != i]
    m = lambda a, b: f"m{min(a, b)}{max(a, b)}"
    det = (f"(m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02))")
    return r(f"{m(i, i)} * ({m(j, j)} * {m(k, k)} - {m(j, k)} * {m(j, k)}) / {det}")


@query(
    "vif3",
    f"""SELECT l_returnflag, {', '.join(f'{_vif3(i)} AS vif_{c}' for i, c in enumerate(_V3))} FROM (SELECT l_returnflag,
        {', '.join(f'sum({_V3[i]} * {_V3[j]}) AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM lineitem GROUP BY 1)""",
)
def vif3(spark, d):
    return rounded(correlate.vif(load(spark, d, "lineitem"), _V3, ["l_returnflag"]), [f"vif_{c}" for c in _V3])


@query(
    "robust_scale",
    f"""SELECT event_id, {r('(value - med) / iqr')} AS scaled, {r('value', 4)} AS back FROM events JOIN (SELECT event_type, median(value) AS med,
        quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1) USING (event_type)""",
)
def robust_scale(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    scaled = scale.robust_scale(rows, "value", ["event_type"], "scaled")
    return scale.robust_unscale(scaled, "scaled", "back").select("event_id", rnd("scaled").alias("scaled"), rnd("back", 4).alias("back"))


@query(
    "standard_scale",
    f"""SELECT event_id, {r('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS scaled FROM events
        WINDOW w AS (PARTITION BY event_type)""",
)
def standard_scale(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    out = clean.standardize(rows, "value", ["event_type"], "scaled", population=True)
    return out.select("event_id", rnd("scaled").alias("scaled"))


@query(
    "minmax_scale",
    f"""SELECT event_id, {r('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)')} AS scaled FROM events
        WINDOW w AS (PARTITION BY event_type)""",
)
def minmax_scale(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    return clean.normalize(rows, "value", ["event_type"], "scaled").select("event_id", rnd("scaled").alias("scaled"))


def uniform_sql(value: str, by: str) -> str:
    """Training values of a quantile transform."""
    w = f"PARTITION BY {by}"
    return (
        f"CASE WHEN {value} = min({value}) OVER ({w}) THEN 0 WHEN {value} = max({value}) OVER ({w}) THEN 1 ELSE "
        f"(rank() OVER ({w} ORDER BY {value}) - 1 + (count(*) OVER ({w}, {value}) - 1) / 2) / nullif(count(*) OVER ({w}) - 1, 0) END"
    )


@query("quantile_transform", f"SELECT event_id, {r(uniform_sql('value', 'event_type'))} AS u FROM events")
def quantile_transform(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    return scale.quantile_transform(rows, ["event_type"], "value").select("event_id", rnd("u").alias("u"))


# Two predictors in closed form, as SQL over centred products.
_B1 = "(sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz)"
_B2 = "(szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz)"


def ols_sql(source: str, by: str, x: str, z: str, y: str, penalty: str = "0") -> str:
    return f"""SELECT {by}, my - b1 * mx - b2 * mz AS b0, b1, b2 FROM (SELECT *, {_B1} AS b1, {_B2} AS b2 FROM (
        SELECT {by}, avg({x}) AS mx, avg({z}) AS mz, avg({y}) AS my,
        covar_pop({x}, {x}) * count(*) + {penalty} AS sxx, covar_pop({z}, {z}) * count(*) + {penalty} AS szz, covar_pop({x}, {z}) * count(*) AS sxz,
        covar_pop({x}, {y}) * count(*) AS sxy, covar_pop({z}, {y}) * count(*) AS szy FROM {source} GROUP BY {by}))"""


def _coef(df, keys, digits=4):
    return df.select(*keys, *[rnd(F.element_at("coef", i + 1), digits).alias(f"b{i}") for i in range(3)])


@query(
    "ols_grouped",
    f"SELECT l_returnflag, {r('b0', 4)} AS b0, {r('b1', 4)} AS b1, {r('b2', 4)} AS b2 FROM ("
    + ols_sql("lineitem", "l_returnflag", "l_quantity", "l_tax", "l_extendedprice") + ")",
)
def ols_grouped(spark, d):
    model = linear.fit_linear(load(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], "l_extendedprice")
    return _coef(model, ["l_returnflag"])


@query(
    "ols_no_intercept",
    f"""SELECT l_returnflag, CAST(0 AS DOUBLE) AS b0, {r(_B1, 4)} AS b1, {r(_B2, 4)} AS b2 FROM (SELECT l_returnflag,
        sum(l_quantity * l_quantity) AS sxx, sum(l_tax * l_tax) AS szz, sum(l_quantity * l_tax) AS sxz,
        sum(l_quantity * l_extendedprice) AS sxy, sum(l_tax * l_extendedprice) AS szy FROM lineitem GROUP BY 1)""",
)
def ols_no_intercept(spark, d):
    model = linear.fit_linear(
        load(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_tax"], "l_extendedprice", intercept=False
    )
    return _coef(model, ["l_returnflag"])


_FOLDED = fold_sql("(SELECT * FROM filled)", "project, task", "date, t_line, version", "*")
_TRAIN = "SELECT f.*, o.fold_out FROM folded f JOIN (SELECT DISTINCT project, task, fold AS fold_out FROM folded) o USING (project, task) WHERE f.fold <> o.fold_out"


def _folded(spark, d):
    rows = s.filled(spark, d)
    return folds.kfold_assign(rows, KEYS, ORDER, bounded=True)


_CV = f"""SELECT f.project, f.task, f.version, f.line_ec AS y, b0 + b1 * nt_ec + b2 * t_line_p AS predicted
    FROM folded f JOIN fits m ON m.project = f.project AND m.task = f.task AND m.fold_out = f.fold"""
_CV_CTES = {
    "folded": _FOLDED, "train": _TRAIN,
    "fits": ols_sql("train", "project, task, fold_out", "nt_ec", "t_line_p", "line_ec"), "cv": _CV,
    "full_fit": ols_sql("folded", "project, task", "nt_ec", "t_line_p", "line_ec"),
    "scored": """SELECT c.*, b0 + b1 * f.nt_ec + b2 * f.t_line_p AS fitted FROM cv c JOIN folded f USING (project, task, version)
                 JOIN full_fit m ON m.project = c.project AND m.task = c.task""",
}


def _cv(spark, d):
    rows = _folded(spark, d)
    held = linear.cv_predict(rows, KEYS, XS, "line_ec")
    full = linear.fit_linear(rows, KEYS, XS, "line_ec")
    return linear.predict_linear(held, full, KEYS, XS, "fitted").withColumn("y", F.col("line_ec").cast("double"))


@query("cv_predict", sql(f"SELECT project, task, version, {r('predicted', 4)} AS predicted FROM cv", **_CV_CTES))
def cv_predict(spark, d):
    out = linear.cv_predict(_folded(spark, d), KEYS, XS, "line_ec")
    return out.select("project", "task", "version", rnd("predicted", 4).alias("predicted"))


_ALPHAS = [0.001, 0.01, 0.1, 1.0]


@query(
    "ridge_cv",
    sql(
        f"""SELECT b.project, b.task, CAST(b.alpha AS DOUBLE) AS alpha, {r('m.b0', 4)} AS b0, {r('m.b1', 4)} AS b1, {r('m.b2', 4)} AS b2
            FROM (SELECT project, task, arg_min(alpha, sse) AS alpha FROM (
                  SELECT f.project, f.task, m.alpha, sum(power(f.line_ec - b0 - b1 * f.nt_ec - b2 * f.no_ec, 2)) AS sse
                  FROM folded f JOIN ridge m ON m.project = f.project AND m.task = f.task AND m.fold_out = f.fold GROUP BY 1, 2, 3)
                  GROUP BY 1, 2) b JOIN ridge_full m ON m.project = b.project AND m.task = b.task AND m.alpha = b.alpha""",
        folded=_FOLDED, train=_TRAIN,
        ridge=" UNION ALL ".join(
            f"SELECT *, {a}::DOUBLE AS alpha FROM ({ols_sql('train', 'project, task, fold_out', 'nt_ec', 'no_ec', 'line_ec', str(a))})" for a in _ALPHAS
        ),
        ridge_full=" UNION ALL ".join(
            f"SELECT *, {a}::DOUBLE AS alpha FROM ({ols_sql('folded', 'project, task', 'nt_ec', 'no_ec', 'line_ec', str(a))})" for a in _ALPHAS
        ),
    ),
)
def ridge_cv(spark, d):
    out = linear.ridge_cv(_folded(spark, d), KEYS, ["nt_ec", "no_ec"], "line_ec", _ALPHAS)
    return out.select(*KEYS, "alpha", *[rnd(F.element_at("coef", i + 1), 4).alias(f"b{i}") for i in range(3)])


@query(
    "error_metrics",
    sql(f"""SELECT project, task, {r('avg(abs(y - predicted))', 4)} AS mae, {r('avg(power(y - predicted, 2))', 4)} AS mse,
            {r('sqrt(avg(power(y - predicted, 2)))', 4)} AS rmse FROM cv GROUP BY 1, 2""", **_CV_CTES),
)
def error_metrics(spark, d):
    out = linear.cv_predict(_folded(spark, d), KEYS, XS, "line_ec").withColumn("y", F.col("line_ec").cast("double"))
    return rounded(metrics.error_metrics(out, KEYS), ["mae", "mse", "rmse"], 4)


_R2 = "1 - sum(power(y - fitted, 2)) / (var_pop(y) * count(*))"


@query("r2", sql(f"SELECT project, task, {r(_R2)} AS r2 FROM scored GROUP BY 1, 2", **_CV_CTES))
def r2(spark, d):
    return _cv(spark, d).groupBy(*KEYS).agg(rnd(metrics.r_squared("y", "fitted")).alias("r2"))


@query(
    "r2_adj",
    sql(f"""SELECT project, task, {r('CASE WHEN n - 2 = 1 THEN r2 ELSE 1 - (1 - r2) * (n - 1) / nullif(n - 3, 0) END')} AS r2_adj
            FROM (SELECT project, task, {_R2} AS r2, count(*) AS n FROM scored GROUP BY 1, 2)""", **_CV_CTES),
)
def r2_adj(spark, d):
    base = _cv(spark, d).groupBy(*KEYS).agg(metrics.r_squared("y", "fitted").alias("r2"), F.count(F.lit(1)).alias("n"))
    return base.select(*KEYS, rnd(metrics.r_squared_adj("r2", "n", 2)).alias("r2_adj"))


_PE = f"CASE WHEN y = 0 THEN abs(predicted) ELSE {r('abs((y - predicted) / y)', 2)} END"
_PRED = f"{{}} AS pred_25, {{}} AS pred_50".format(
    r("count(*) FILTER (pe < 0.25) / nullif(count(pe), 0)", 2), r("count(*) FILTER (pe < 0.5) / nullif(count(pe), 0)", 2)
)


@query("pred_score", sql(f"SELECT project, task, {_PRED} FROM (SELECT *, {_PE} AS pe FROM cv) GROUP BY 1, 2", **_CV_CTES))
def pred_score(spark, d):
    out = linear.cv_predict(_folded(spark, d), KEYS, XS, "line_ec").withColumn("pe", numbers.percent_error("line_ec", "predicted"))
    return out.groupBy(*KEYS).agg(metrics.pred_score("pe", 0.25).alias("pred_25"), metrics.pred_score("pe", 0.5).alias("pred_50"))


@query(
    "performance_table",
    sql(f"""SELECT project, task, {r(_R2, 2)} AS r_squared, count(*) AS t_records, {r('avg(abs(y - predicted))', 2)} AS mae,
            {r('avg(power(y - predicted, 2))', 2)} AS mse, {r('sqrt(avg(power(y - predicted, 2)))', 2)} AS rmse, {_PRED},
            {r(f"CASE WHEN count(*) = 3 THEN {r(_R2, 2)} ELSE 1 - (1 - {r(_R2, 2)}) * (count(*) - 1) / nullif(count(*) - 3, 0) END", 2)} AS r_squared_adj
            FROM (SELECT *, {_PE} AS pe FROM scored) GROUP BY 1, 2""", **_CV_CTES),
)
def performance_table(spark, d):
    return metrics.performance_table(_cv(spark, d), KEYS, 2)


@query(
    "residuals",
    sql(f"SELECT project, task, version, {r('y - fitted', 4)} AS residual, {r('avg(y - fitted) OVER (PARTITION BY project, task)', 4)} AS mean FROM scored", **_CV_CTES),
)
def residuals(spark, d):
    rows = _folded(spark, d)
    model = linear.fit_linear(rows, KEYS, XS, "line_ec")
    scored = linear.predict_linear(rows, model, KEYS, XS, "fitted").withColumn("residual", F.col("line_ec") - F.col("fitted"))
    means = scored.groupBy(*KEYS).agg(F.avg("residual").alias("mean"))
    out = ordered.attach(scored.select(*KEYS, "version", "residual"), means, KEYS)
    return rounded(out, ["residual", "mean"], 4)


@query(
    "best_model",
    sql(f"""SELECT project, task, arg_max(model, (score, model = 'intercept')) AS model, max(score) AS score FROM (
            SELECT project, task, 'linear' AS model, {r('count(*) FILTER (pe < 0.5) / nullif(count(pe), 0)', 2)} AS score FROM (SELECT *, {_PE} AS pe FROM cv) GROUP BY 1, 2
            UNION ALL SELECT project, task, 'intercept', {r('count(*) FILTER (pe < 0.5) / nullif(count(pe), 0)', 2)} FROM (SELECT project, task,
              CASE WHEN line_ec = 0 THEN abs(predicted) ELSE {r('abs((line_ec - predicted) / line_ec)', 2)} END AS pe FROM (
              SELECT f.*, o.m AS predicted FROM folded f JOIN (SELECT project, task, fold_out, avg(line_ec) AS m FROM train GROUP BY 1, 2, 3) o
              ON o.project = f.project AND o.task = f.task AND o.fold_out = f.fold)) GROUP BY 1, 2) GROUP BY 1, 2""", **_CV_CTES),
)
def best_model(spark, d):
    """A linear model against the mean of the other folds."""
    rows = _folded(spark, d)
    fits = linear.cv_predict(rows, KEYS, XS, "line_ec").select(*KEYS, "line_ec", "predicted", F.lit("linear").alias("model"))
    sums = rows.groupBy(*KEYS, "fold").agg(F.sum("line_ec").alias("a"), F.count(F.lit(1)).alias("b"))
    whole = sums.groupBy(*KEYS).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    rest = ordered.attach(sums, whole, KEYS).select(*KEYS, "fold", ((F.col("sa") - F.col("a")) / (F.col("sb") - F.col("b"))).alias("predicted"))
    means = ordered.attach(rows, rest, [*KEYS, "fold"]).select(*KEYS, "line_ec", "predicted", F.lit("intercept").alias("model"))
    both = fits.unionByName(means).withColumn("pe", numbers.percent_error("line_ec", "predicted"))
    scores = both.groupBy(*KEYS, "model").agg(metrics.pred_score("pe", 0.5).alias("score"))
    return metrics.best_model(scores, KEYS, "score")


@query(
    "min_rows_guard",
    sql("""SELECT project, task, version FROM dataset WHERE nt_cc IS NOT NULL
           QUALIFY count(*) OVER (PARTITION BY project, task) >= 2"""),
)
def min_rows_guard(spark, d):
    rows = s.pinned_dataset(spark, d).where(F.col("nt_cc").isNotNull()).select(*KEYS, "version")
    return clean.min_rows(rows, KEYS, 2)


_STUMP_X = ["nt_ec", "no_ec"]


@query(
    "cart_stump",
    sql(
        f"""SELECT project, task, arg_min(feature, (cost, feature, threshold)) AS feature,
            {r('arg_min(threshold, (cost, feature, threshold))')} AS threshold FROM (
            SELECT *, -round((sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt) / nullif(qt - st * st / nt, 0), 10) AS cost,
                   (vp + v) / 2 AS threshold FROM (
              SELECT project, task, feature, v, lag(v) OVER w AS vp, sum(n) OVER w - n AS nl, sum(sy) OVER w - sy AS sl,
                     sum(n) OVER p AS nt, sum(sy) OVER p AS st, sum(q) OVER p AS qt FROM (
                SELECT project, task, feature, v, count(*) AS n, sum(y) AS sy, sum(y * y) AS q FROM (
                  {' UNION ALL '.join(f'SELECT project, task, {i} AS feature, CAST({x} AS DOUBLE) AS v, CAST(line_ec AS DOUBLE) AS y FROM filled' for i, x in enumerate(_STUMP_X))})
                GROUP BY 1, 2, 3, 4)
              WINDOW w AS (PARTITION BY project, task, feature ORDER BY v), p AS (PARTITION BY project, task, feature))
            WHERE vp IS NOT NULL AND nt >= 10) GROUP BY 1, 2""",
    ),
)
def cart_stump(spark, d):
    out = tree.best_splits(s.filled(spark, d), KEYS, _STUMP_X, "line_ec", 10, bounded=True)
    return out.withColumn("threshold", rnd("threshold"))


MODEL_XS = ["nt", "no", "t", "t_line_p"]


def _targets(spark, d, model: str):
    return export.long_targets(s.filled(spark, d)).where(F.col("model") == model)


def cart_ctes(start: str, group: str, xs: list[str], y: str, prefix: str, levels: int = tree.MAX_DEPTH) -> dict[str, str]:
    """A tree level by level: rows of a level, its best splits, rows of the next. ``start`` has is_train."""
    out = {f"{prefix}_r0": f"SELECT *, CAST(1 AS BIGINT) AS node FROM {start}"}
    for k in range(levels):
        cells = " UNION ALL ".join(
            f"SELECT {group}, node, {i} AS feature, CAST({x} AS DOUBLE) AS v, CAST({y} AS DOUBLE) AS t FROM {prefix}_r{k} WHERE is_train"
            for i, x in enumerate(xs)
        )
        out[f"{prefix}_s{k}"] = f"""SELECT {group}, node, arg_min(feature, (cost, feature, cut)) AS feature, arg_min(cut, (cost, feature, cut)) AS cut FROM (
            SELECT *, -round((sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt) / nullif(qt - st * st / nt, 0), 10) AS cost,
                   (vp + v) / 2 AS cut FROM (
              SELECT {group}, node, feature, v, lag(v) OVER w AS vp, sum(n) OVER w - n AS nl, sum(sy) OVER w - sy AS sl,
                     sum(n) OVER p AS nt, sum(sy) OVER p AS st, sum(q) OVER p AS qt FROM (
                SELECT {group}, node, feature, v, count(*) AS n, sum(t) AS sy, sum(t * t) AS q FROM ({cells}) GROUP BY ALL)
              WINDOW w AS (PARTITION BY {group}, node, feature ORDER BY v), p AS (PARTITION BY {group}, node, feature))
            WHERE vp IS NOT NULL AND nt >= {tree.MIN_SPLIT} AND qt - st * st / nt > 1e-12 * qt) GROUP BY ALL"""
        pick = "CASE z.feature " + " ".join(f"WHEN {i} THEN a.{x}" for i, x in enumerate(xs)) + " END"
        on = " AND ".join(f"z.{g.strip()} = a.{g.strip()}" for g in group.split(","))
        out[f"{prefix}_r{k + 1}"] = f"""SELECT a.* REPLACE (CASE WHEN z.feature IS NULL THEN a.node
            ELSE a.node * 2 + CAST({pick} > z.cut AS BIGINT) END AS node) FROM {prefix}_r{k} a
            LEFT JOIN {prefix}_s{k} z ON {on} AND z.node = a.node"""
    return out


_TREE_ROWS = """SELECT project, task, version, date, t_line, {y} AS y, CAST(nt_ec AS DOUBLE) AS x0, CAST(no_ec AS DOUBLE) AS x1,
    CAST(t_ec AS DOUBLE) AS x2, CAST(t_line_p AS DOUBLE) AS x3, true AS is_train FROM filled"""
_X = ["x0", "x1", "x2", "x3"]


@query(
    "cart_grouped",
    sql(
        f"""SELECT project, task, 'Line_EC' AS model, version, node, {r('avg(y) OVER (PARTITION BY project, task, node)')} AS predicted FROM m_c_r10""",
        m_rows=_TREE_ROWS.format(y="line_ec"), **cart_ctes("m_rows", "project, task", _X, "y", "m_c"),
    ),
)
def cart_grouped(spark, d):
    """The production model without the quantile scale: in-sample predictions of a tree per project and task."""
    rows = _targets(spark, d, "Line_EC").withColumn("is_train", F.lit(True))
    out = tree.grouped_cart(rows, [*KEYS, "model"], MODEL_XS, "y", bounded=True)
    return out.select(*KEYS, "model", "version", "node", rnd("predicted").alias("predicted"))


# Every fit with all rows of its series: held-out fold f, or -1 for the fit on everything.
_G = "project, task, fold_out"
_UNIFORM = """CASE WHEN n_lt = 0 THEN 0 WHEN n_le = size THEN 1 WHEN n_le > n_lt THEN (n_lt + n_le - 1) / 2 / (size - 1)
    ELSE (n_le - 1 + (val - lo) / (hi - lo)) / (size - 1) END"""
_MODEL_CTES = {
    "m_rows": _TREE_ROWS.format(y="module_ec").replace(", true AS is_train", ""),
    "m_folded": fold_sql("m_rows", "project, task", "date, t_line, version", "*"),
    "m_fits": f"""SELECT a.*, o.fold_out, o.fold_out = -1 OR a.fold <> o.fold_out AS is_train, o.fold_out = -1 OR a.fold = o.fold_out AS is_test
        FROM m_folded a JOIN (SELECT DISTINCT project, task, fold AS fold_out FROM m_folded UNION ALL SELECT DISTINCT project, task, -1 FROM m_folded) o
        USING (project, task)""",
    "m_cells": " UNION ALL ".join(
        f"SELECT {_G}, '{c}' AS col, CAST({c} AS DOUBLE) AS val, is_train FROM m_fits" for c in [*_X, "y"]
    ),
    "m_place": f"""SELECT {_G}, col, val, CAST({_UNIFORM} AS DOUBLE) AS u FROM (
        SELECT v.project, v.task, v.fold_out, v.col, v.val, count(*) AS size, count(*) FILTER (t.val < v.val) AS n_lt,
               count(*) FILTER (t.val <= v.val) AS n_le, max(t.val) FILTER (t.val <= v.val) AS lo, min(t.val) FILTER (t.val > v.val) AS hi
        FROM (SELECT DISTINCT {_G}, col, val FROM m_cells) v JOIN m_cells t ON t.project = v.project AND t.task = v.task
         AND t.fold_out = v.fold_out AND t.col = v.col AND t.is_train GROUP BY ALL)""",
    "m_scaled": f"""SELECT f.project, f.task, f.fold_out, f.version, f.y, f.fold, f.is_train, f.is_test, {", ".join(f"p{c}.u AS u{c}" for c in [*_X, "y"])}
        FROM m_fits f {" ".join(f"JOIN m_place p{c} ON p{c}.project = f.project AND p{c}.task = f.task AND p{c}.fold_out = f.fold_out AND p{c}.col = '{c}' AND p{c}.val = f.{c}" for c in [*_X, "y"])}""",
    **cart_ctes("m_scaled", _G, [f"u{c}" for c in _X], "uy", "m_t"),
    "m_leaves": f"SELECT {_G}, node, avg(uy) AS u_hat FROM m_t_r10 WHERE is_train GROUP BY ALL",
    "m_knots": f"SELECT {_G}, CAST(y AS DOUBLE) AS y, row_number() OVER (PARTITION BY {_G} ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY {_G}) AS n FROM m_fits WHERE is_train",
    "m_hats": f"""SELECT x.project, x.task, x.fold_out, x.version, a.y + (b.y - a.y) * (x.spot - floor(x.spot)) AS hat, x.y FROM (
        SELECT t.project, t.task, t.fold_out, t.version, t.y, k.n, least(greatest(l.u_hat, 0), 1) * (k.n - 1) AS spot FROM m_t_r10 t
        JOIN m_leaves l USING (project, task, fold_out, node) JOIN (SELECT DISTINCT {_G}, n FROM m_knots) k USING (project, task, fold_out) WHERE t.is_test) x
        JOIN m_knots a ON a.project = x.project AND a.task = x.task AND a.fold_out = x.fold_out AND a.i = floor(x.spot)
        JOIN m_knots b ON b.project = x.project AND b.task = x.task AND b.fold_out = x.fold_out AND b.i = least(floor(x.spot) + 1, x.n - 1)""",
    "m_scored": """SELECT project, task, version, any_value(y) AS y, max(hat) FILTER (fold_out = -1) AS fitted, max(hat) FILTER (fold_out <> -1) AS predicted
        FROM m_hats GROUP BY 1, 2, 3""",
}


@query(
    "effort_model",
    sql(f"""SELECT project, task, 'Module_EC' AS model, {r(_R2, 2)} AS r_squared, count(*) AS t_records, {r('avg(abs(y - predicted))', 2)} AS mae,
            {r('avg(power(y - predicted, 2))', 2)} AS mse, {r('sqrt(avg(power(y - predicted, 2)))', 2)} AS rmse, {_PRED},
            {r(f"1 - (1 - {r(_R2, 2)}) * (count(*) - 1) / nullif(count(*) - 5, 0)", 2)} AS r_squared_adj
            FROM (SELECT *, {_PE} AS pe FROM m_scored) GROUP BY 1, 2""", **_MODEL_CTES),
)
def effort_model(spark, d):
    """The production model: quantile scale, tree, cross-validated and in-sample predictions, accuracy per series."""
    rows = _targets(spark, d, "Module_EC")
    out = pipeline.transformed_regression(rows, [*KEYS, "model"], ORDER, MODEL_XS, "y", "tree", bounded=True)
    return metrics.performance_table(out, [*KEYS, "model"], len(MODEL_XS))


_U = {"nt_ec": "ux", "t_line_p": "uz", "line_ec": "uy"}


@query(
    "ttr_linear",
    sql(
        f"""SELECT project, task, version, {r('a + (b - a) * (spot - floor(spot))', 4)} AS fitted FROM (
            SELECT p.*, (SELECT y FROM knots k WHERE k.project = p.project AND k.task = p.task AND k.i = floor(spot)) AS a,
            (SELECT y FROM knots k WHERE k.project = p.project AND k.task = p.task AND k.i = least(floor(spot) + 1, p.n - 1)) AS b
            FROM (SELECT u.*, least(greatest(b0 + b1 * ux + b2 * uz, 0), 1) * (n - 1) AS spot FROM uniform u JOIN umodel m
                  ON m.project = u.project AND m.task = u.task) p)""",
        uniform=f"SELECT project, task, version, count(*) OVER (PARTITION BY project, task) AS n, "
        + ", ".join(f"CAST({uniform_sql(c, 'project, task')} AS DOUBLE) AS {n}" for c, n in _U.items()) + " FROM filled",
        umodel=ols_sql("uniform", "project, task", "ux", "uz", "uy"),
        knots="SELECT project, task, line_ec AS y, row_number() OVER (PARTITION BY project, task ORDER BY line_ec) - 1 AS i FROM filled",
    ),
)
def ttr_linear(spark, d):
    rows = s.filled(spark, d)
    out = pipeline.transformed_regression(rows, KEYS, ORDER, XS, "line_ec", "linear", bounded=True)
    return out.select(*KEYS, "version", rnd("fitted", 4).alias("fitted"))


@query(
    "knn_regress",
    sql(f"""SELECT project, task, version, {r('avg(yy)')} AS predicted FROM (
            SELECT a.project, a.task, a.version, b.line_ec AS yy, row_number() OVER (PARTITION BY a.project, a.task, a.version
              ORDER BY power(a.nt_ec - b.nt_ec, 2) + power(a.no_ec - b.no_ec, 2), b.date, b.t_line, b.version) AS rn
            FROM filled a JOIN filled b ON a.project = b.project AND a.task = b.task) WHERE rn <= 5 GROUP BY 1, 2, 3"""),
)
def knn_regress(spark, d):
    out = neighbors.knn_regress(s.filled(spark, d), KEYS, ORDER, ["nt_ec", "no_ec"], "line_ec", bounded=True)
    return out.select(*KEYS, "version", rnd("predicted").alias("predicted"))


def _pooled(spark, d):
    return s.filled(spark, d).select("project", "task", "version", "nt_ec", "no_ec", "t_ec", "t_line_p", F.col("line_ec").cast("double").alias("y"))


_FOREST = _TREE_ROWS.format(y="line_ec").replace(", true AS is_train", "")
_DRAWN = """SELECT r.*, tree, copy, w > 0 AS is_train FROM (SELECT *,
    CAST(u >= exp(-1) AS INT) + CAST(u >= 2 * exp(-1) AS INT) + CAST(u >= 2.5 * exp(-1) AS INT) + CAST(u >= 8 / 3.0 * exp(-1) AS INT)
    + CAST(u >= 65 / 24.0 * exp(-1) AS INT) + CAST(u >= 163 / 60.0 * exp(-1) AS INT) AS w FROM (
    SELECT r.*, tree, CAST(('0x' || substr(md5(concat_ws('|', '0', CAST(tree AS VARCHAR), project, task, version)), 1, 8)) AS BIGINT) / 4294967296.0 AS u
    FROM forest_rows r, range(10) t(tree))) r, range(1, 8) c(copy) WHERE copy <= greatest(w, 1)"""


@query(
    "random_forest",
    sql(
        f"""SELECT project, task, {r('avg(abs(y - hat))', 4)} AS mae, {r('avg(power(y - hat, 2))', 4)} AS mse, {r('sqrt(avg(power(y - hat, 2)))', 4)} AS rmse
        FROM (SELECT project, task, version, any_value(y) AS y, avg(leaf) AS hat FROM f_t_r10
              JOIN (SELECT project, task, tree, node, avg(y) AS leaf FROM f_t_r10 WHERE is_train GROUP BY ALL) USING (project, task, tree, node)
              WHERE copy = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        forest_rows=_FOREST, forest_drawn=_DRAWN, **cart_ctes("forest_drawn", "project, task, tree", _X, "y", "f_t"),
    ),
)
def random_forest(spark, d):
    out = models.random_forest(_pooled(spark, d), KEYS, ["version"], ["nt_ec", "no_ec", "t_ec", "t_line_p"], "y", bounded=True)
    return rounded(metrics.error_metrics(out, KEYS), ["mae", "mse", "rmse"], 4)


BOOST_ROUNDS, BOOST_DEPTH = 8, 3


def boost_ctes(start: str, group: str, xs: list[str], y: str, rounds: int, depth: int, rate: str) -> dict[str, str]:
    """Boosting round by round: a tree on the residuals, then the fit moved by ``rate`` times its leaf means."""
    same = " AND ".join(f"a.{g.strip()} = z.{g.strip()}" for g in group.split(","))
    out = {"m_b0": f"SELECT *, avg({y}) OVER (PARTITION BY {group}) AS f, true AS is_train FROM {start}"}
    for k in range(rounds):
        out[f"m_q{k}"] = f"SELECT *, {y} - f AS res FROM m_b{k}"
        out |= {n: c.replace(f"nt >= {tree.MIN_SPLIT}", "nt >= 2") for n, c in cart_ctes(f"m_q{k}", group, xs, "res", f"m_g{k}", depth).items()}
        out[f"m_v{k}"] = f"SELECT {group}, node, avg(res) AS step FROM m_g{k}_r{depth} GROUP BY ALL"
        out[f"m_b{k + 1}"] = f"""SELECT a.* EXCLUDE (res, node, f), f + {rate} * z.step AS f FROM m_g{k}_r{depth} a
            JOIN m_v{k} z ON {same} AND a.node = z.node"""
    return out


@query(
    "gbt",
    sql(
        f"""SELECT project, task, {r('avg(abs(y - f))', 4)} AS mae, {r('avg(power(y - f, 2))', 4)} AS mse, {r('sqrt(avg(power(y - f, 2)))', 4)} AS rmse
        FROM m_b{BOOST_ROUNDS} GROUP BY 1, 2""",
        m_boost=_FOREST, **boost_ctes("m_boost", "project, task", _X, "y", BOOST_ROUNDS, BOOST_DEPTH, "0.3::DOUBLE"),
    ),
)
def gbt(spark, d):
    """Boosted trees per project and task: in-sample errors."""
    xs = ["nt_ec", "no_ec", "t_ec", "t_line_p"]
    out = models.gradient_boosting(_pooled(spark, d), KEYS, ["version"], xs, "y", BOOST_ROUNDS, BOOST_DEPTH, 0.3, bounded=True)
    return rounded(metrics.error_metrics(out, KEYS), ["mae", "mse", "rmse"], 4)


# The closed form of a monotone fit: the largest over starts of the smallest over ends of the mean in between.
@query(
    "isotonic",
    sql(
        f"""SELECT project, task, x AS nt_ec, {r('max(low)')} AS predicted, any_value(c) AS n FROM (
            SELECT p.project, p.task, p.x, p.c, a.x AS start, min((b.sy - a.sy + a.y) / (b.sc - a.sc + a.c)) AS low
            FROM steps p JOIN steps a ON a.project = p.project AND a.task = p.task AND a.x <= p.x
            JOIN steps b ON b.project = p.project AND b.task = p.task AND b.x >= p.x GROUP BY ALL) GROUP BY 1, 2, 3""",
        steps="""SELECT project, task, nt_ec AS x, count(*) AS c, CAST(sum(line_ec) AS DOUBLE) AS y, sum(count(*)) OVER w AS sc,
                 CAST(sum(sum(line_ec)) OVER w AS DOUBLE) AS sy FROM filled GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY project, task ORDER BY nt_ec)""",
    ),
)
def isotonic(spark, d):
    """Monotone fit of external lines on external commits per project and task."""
    out = monotone.isotonic(_pooled(spark, d), KEYS, "nt_ec", "y")
    fitted = out.groupBy(*KEYS, "nt_ec").agg(F.max("predicted").alias("predicted"), F.count(F.lit(1)).alias("n"))
    return rounded(fitted, ["predicted"])


# Cost model ---------------------------------------------------------------------------------------------------------

_CALENDAR = f"""SELECT day, open, CAST(sum(CAST(open AS INT)) OVER (ORDER BY day) AS BIGINT) - CAST(open AS INT) AS before FROM (
    SELECT day, dayofweek(day) NOT IN (0, 6) AND NOT {holiday('day')} AS open FROM (
    SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM release_table))"""
_DATED = """SELECT *, coalesce(lag(date) OVER (PARTITION BY project, task ORDER BY date, t_line, version), min(date) OVER (PARTITION BY project, task)) AS date_p
    FROM filled"""
_HOURS = """SELECT x.*, (b.before - a.before) * 9 AS hours_diff FROM dated x JOIN cal a ON a.day = x.date_p JOIN cal b ON b.day = x.date"""


def _calendar(spark, d):
    return business_calendar(s.commits(spark, d).select(F.last_day("date").alias("date")), "date", "date")


@query("business_calendar", sql("SELECT CAST(day AS VARCHAR) AS day, open, before FROM cal", cal=_CALENDAR))
def business_calendar_days(spark, d):
    return _calendar(spark, d).withColumn("day", F.col("day").cast("string"))


@query("business_hours", sql("SELECT project, task, version, hours_diff FROM hours", cal=_CALENDAR, dated=_DATED, hours=_HOURS))
def business_hours_query(spark, d):
    rows = previous_date(s.filled(spark, d), KEYS, ORDER, bounded=True)
    return business_hours(rows, _calendar(spark, d), "date_p", "date", "hours_diff").select(*KEYS, "version", "hours_diff")


_AVG = """SELECT project, task, avg(module_ec) FILTER (rn <= 30) / nullif(avg(people), 0) AS avg_effort FROM (
    SELECT *, CASE WHEN t_ec = 0 AND module_ec > 0 THEN 1 ELSE t_ec END AS people,
    row_number() OVER (PARTITION BY project, task ORDER BY date DESC, t_line DESC, version DESC) AS rn FROM filled) GROUP BY 1, 2"""


@query("avg_effort", sql(f"SELECT project, task, {r('avg_effort')} AS avg_effort FROM ae", ae=_AVG))
def avg_effort(spark, d):
    rows = s.filled(spark, d).withColumn("t_ec", costs.min_contrib("t_ec", "module_ec"))
    return rounded(costs.average_effort(rows, KEYS, ORDER, "module_ec", "t_ec"), ["avg_effort"])


_COSTED = f"""SELECT *, {r('people - contribs', 2)} AS contrib_diff, {r('hours_diff * contribs', 2)} AS billed,
    {r(r('hours_diff * contribs', 2) + ' * 100', 2)} AS cost FROM (
    SELECT h.*, CASE WHEN avg_effort = 0 THEN 0 ELSE {r('least(module_ec / avg_effort, people)', 2)} END AS contribs FROM (
      SELECT *, CASE WHEN t_ec = 0 AND module_ec > 0 THEN 1 ELSE t_ec END AS people FROM hours) h JOIN ae USING (project, task))"""
COST_CTES = {"cal": _CALENDAR, "dated": _DATED, "hours": _HOURS, "ae": _AVG, "costed": _COSTED}


def costed(spark, d, effort="module_ec", people="t_ec"):
    return costs.release_costs(s.filled(spark, d), _calendar(spark, d), KEYS, ORDER, effort, people, bounded=True)


@query(
    "release_costs",
    sql("SELECT project, task, version, contribs AS avg_contribs, contrib_diff, billed AS billed_hours, cost FROM costed", **COST_CTES),
)
def release_costs(spark, d):
    return costed(spark, d).select(*KEYS, "version", "avg_contribs", "contrib_diff", "billed_hours", "cost")


@query(
    "prediction_results",
    sql(
        f"""SELECT CAST(c.date AS VARCHAR) AS date, c.project, 'Module_EC' AS model, c.task, c.nt_ec AS nt, c.no_ec AS no,
            c.people AS t_contributors, c.t_line_p AS t_line, c.line_ec AS line, c.module_ec AS module, c.contribs AS avg_module_contribs,
            c.hours_diff, c.contrib_diff, c.billed AS billed_hours, c.cost, {r('c.module_ec', 2)} AS observed,
            {r('v.p', 2)} AS predicted, {r('abs(c.module_ec - v.p)', 2)} AS difference,
            CASE WHEN c.module_ec = 0 THEN 0 ELSE {r('abs(c.module_ec - v.p) / c.module_ec', 2)} END AS percent_error
            FROM costed c JOIN (SELECT f.project, f.task, f.version, b0 + b1 * nt_ec + b2 * t_line_p AS p FROM folded f JOIN mfits m
              ON m.project = f.project AND m.task = f.task AND m.fold_out = f.fold) v USING (project, task, version)""",
        **COST_CTES, folded=_FOLDED, train=_TRAIN,
        mfits=ols_sql("train", "project, task, fold_out", "nt_ec", "t_line_p", "module_ec"),
    ),
)
def prediction_results(spark, d):
    rows = folds.kfold_assign(costed(spark, d), KEYS, ORDER, bounded=True)
    out = linear.cv_predict(rows, KEYS, XS, "module_ec", name="p")
    return out.select(
        F.col("date").cast("string").alias("date"), "project", F.lit("Module_EC").alias("model"), "task",
        F.col("nt_ec").alias("nt"), F.col("no_ec").alias("no"), F.col("t_ec").alias("t_contributors"),
        F.col("t_line_p").alias("t_line"), F.col("line_ec").alias("line"), F.col("module_ec").alias("module"),
        F.col("avg_contribs").alias("avg_module_contribs"), "hours_diff", "contrib_diff", "billed_hours", "cost",
        rnd("module_ec", 2).alias("observed"), rnd("p", 2).alias("predicted"),
        rnd(F.abs(F.col("module_ec") - F.col("p")), 2).alias("difference"),
        numbers.percent_error("module_ec", "p", "zero").alias("percent_error"),
    )
