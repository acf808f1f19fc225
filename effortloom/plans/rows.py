"""Scans, projections, cleaning, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortloom.functions import numbers, text
from effortloom.functions.numbers import rnd
from effortloom.operators import clean, costs, export, sample
from effortloom.plans import standins as s
from effortloom.plans.registry import query
from effortloom.plans.standins import big, r, sql
from effortloom.sources import gitlogs
from effortloom.sources.tables import load, run_sql

POPULAR = ["1-URGENT", "2-HIGH"]


@query("scan_table", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_table(spark, d):
    return load(spark, d, "supplier")


@query(
    "scan_pruned",
    f"SELECT l_returnflag, count(*) AS n, {big('sum(l_quantity)')} AS line FROM lineitem "
    "WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1",
)
def scan_pruned(spark, d):
    lines = load(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"))
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("line"))


@query(
    "param_query",
    f"SELECT o_orderstatus, count(*) AS n, {r('sum(o_totalprice)', 2)} AS total FROM orders "
    "WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1",
)
def param_query(spark, d):
    grouped = run_sql(
        spark,
        "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM {orders} "
        "WHERE o_orderpriority = :project AND o_orderdate >= to_timestamp(:since) GROUP BY o_orderstatus",
        d, ["orders"], project="1-URGENT", since="1997-01-01",
    )
    return grouped.withColumn("total", rnd("total", 2))


@query(
    "tag_list", sql("SELECT project, version, CAST(date AS VARCHAR) AS date FROM release_effort ORDER BY date, project"))
def tag_list(spark, d):
    tags = s.release_effort(spark, d).select("project", "version", F.col("date").cast("string").alias("date"))
    lines = tags.select(F.concat_ws(",", "project", F.concat(F.lit(" "), "version"), "date").alias("line"))
    return gitlogs.parse_tags(lines).withColumn("date", F.col("date").cast("string")).orderBy("date", "project")


@query(
    "changelog_parse",
    sql("""SELECT version, CAST(sha AS VARCHAR) AS sha, coalesce(p.p_name, 'none') AS subject, u.c_name AS author
           FROM commits LEFT JOIN changes USING (sha) LEFT JOIN part p USING (p_partkey)
           JOIN customer u ON u.c_custkey = commits.author"""),
)
def changelog_parse(spark, d):
    names = load(spark, d, "customer").select(F.col("c_custkey").alias("author"), "c_name")
    noted = s.commits(spark, d).join(s.messages(spark, d).select("sha", "message"), "sha", "left").join(names, "author")
    lines = noted.select(
        "version", F.format_string("%d - %s (%s)", "sha", F.coalesce("message", F.lit("none")), "c_name").alias("line")
    )
    return gitlogs.parse_changelog(lines).drop("line")


@query("commit_stats", sql("SELECT sha, e_module, e_line FROM changes"))
def commit_stats(spark, d):
    """The counts rendered as ``--stat`` text, one text a commit, and parsed."""
    body = F.concat(
        F.lit("@"), F.lower(F.hex("sha")), F.lit("\n src/file.txt | 9 +-\n "), F.col("e_module"),
        F.when(F.col("e_module") == 1, " file changed, ").otherwise(" files changed, "),
        F.floor(F.col("e_line") / 3), F.lit(" insertions(+), "), F.col("e_line") - F.floor(F.col("e_line") / 3), F.lit(" deletions(-)\n"),
    )
    parsed = gitlogs.parse_commit_stats(s.changes(spark, d).select(body.alias("value")))
    return parsed.withColumn("sha", F.conv("sha", 16, 10).cast("bigint"))


@query(
    "repo_list",
    """SELECT 'https://github.com/' || replace(c_mktsegment, ' ', '-') || '/' || replace(c_name, '#', '-') AS url,
       replace(c_mktsegment, ' ', '-') AS owner, replace(c_name, '#', '-') AS name, count(*) AS orders
       FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def repo_list(spark, d):
    """Repository lines parsed, and joined to the work on them by the key cut out of the address."""
    slug = F.concat(F.replace("c_mktsegment", F.lit(" "), F.lit("-")), F.lit("/"), F.replace("c_name", F.lit("#"), F.lit("-")))
    owners = load(spark, d, "customer").select("c_custkey", slug.alias("slug"))
    repos = gitlogs.parse_repos(owners.select(F.concat(F.lit("https://github.com/"), "slug").alias("line")))
    api = F.concat(F.lit("https://api.github.com/repos/"), "slug").alias("api_url")
    work = load(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).groupBy(api).agg(F.count(F.lit(1)).alias("orders"))
    return repos.join(work, text.repo_key("api_url") == F.concat("owner", F.lit("/"), "name")).select("url", "owner", "name", "orders")


@query(
    "commit_messages",
    "SELECT CAST(p_partkey AS VARCHAR) AS sha, p_name AS message FROM part",
)
def commit_messages(spark, d):
    lines = load(spark, d, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("line"))
    return gitlogs.parse_commit_messages(lines).drop("line")


_KEY = "project, version, task"
_T = ["project", "version", "task"]


@query(
    "combine_roles",
    sql(f"""SELECT {_KEY}, coalesce(nt_cc + nt_ec + nt_uc, 0) AS nt, coalesce(no_cc + no_ec + no_uc, 0) AS no,
            coalesce(line_cc + line_ec + line_uc, 0) AS line, coalesce(module_cc + module_ec + module_uc, 0) AS module,
            coalesce(t_cc + t_ec + t_uc + 2, 0) AS t_contributors FROM dataset"""),
)
def combine_roles(spark, d):
    combined = export.combine_roles(s.dataset(spark, d))
    return combined.select(*_T, "nt", "no", "line", "module", "t_contributors").fillna(0)


_GAPS = "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0.05) AS discount, nullif(l_tax, 0.0) AS tax FROM lineitem"


def _gaps(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.nullif("l_discount", F.lit(0.05)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )


@query(
    "few_missing",
    f"""SELECT g.* FROM ({_GAPS}) g JOIN (SELECT l_orderkey, avg(CAST(discount IS NULL AS INT) + CAST(tax IS NULL AS INT)) / 2 AS share
        FROM ({_GAPS}) GROUP BY 1) s ON s.l_orderkey = g.l_orderkey WHERE s.share <= 0.1""",
)
def few_missing(spark, d):
    """Rows of the orders with at most a tenth of the cells missing."""
    return clean.few_missing(_gaps(spark, d), ["discount", "tax"], ["l_orderkey"], 0.1)


@query("clean_dropna", f"SELECT * FROM ({_GAPS}) WHERE discount IS NOT NULL AND tax IS NOT NULL")
def clean_dropna(spark, d):
    return _gaps(spark, d).dropna(subset=["discount", "tax"])


@query(
    "clean_fillna",
    f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce(discount, 0) AS discount, coalesce(tax, 0) AS tax FROM ({_GAPS})",
)
def clean_fillna(spark, d):
    return _gaps(spark, d).fillna(0)


@query(
    "clean_nonfinite",
    f"SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE {r('c_acctbal / (c_custkey % 7)', 4)} END AS rate FROM customer",
)
def clean_nonfinite(spark, d):
    part = F.pmod("c_custkey", F.lit(7))
    rate = F.when(part == 0, F.col("c_acctbal") * float("inf")).otherwise(F.col("c_acctbal") / F.nullif(part, F.lit(0)))
    rows = load(spark, d, "customer").select("c_custkey", rate.alias("rate"))
    return numbers.zero_nonfinite(rows, ["rate"]).withColumn("rate", rnd("rate", 4))


@query(
    "clean_cast",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, "
    "TRY_CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS priority, "
    "TRY_CAST(o_orderstatus AS BIGINT) AS dirty, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price FROM orders",
)
def clean_cast(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"),
        F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).try_cast("bigint").alias("priority"),
        F.col("o_orderstatus").try_cast("bigint").alias("dirty"),
        F.col("o_totalprice").cast("float").cast("double").alias("price"),
    )


@query(
    "log_transform",
    f"SELECT o_orderkey, {r('ln(1 + o_totalprice)')} AS log_price, {r('o_totalprice', 2)} AS back FROM orders",
)
def log_transform(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", numbers.log_transform("o_totalprice").alias("log_price"))
    return rows.select("o_orderkey", rnd("log_price").alias("log_price"), rnd(numbers.reverse_log_transform("log_price"), 2).alias("back"))


@query(
    "normalize",
    f"""SELECT o_orderkey, {r('(o_totalprice - min(o_totalprice) OVER w) / nullif(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 0)')}
        AS price FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""",
)
def normalize(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price"))
    return clean.normalize(rows, "price", ["o_orderpriority"]).select("o_orderkey", rnd("price").alias("price"))


@query(
    "standardize",
    f"""SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w')} AS price
        FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""",
)
def standardize(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price"))
    return clean.standardize(rows, "price", ["o_orderpriority"]).select("o_orderkey", rnd("price").alias("price"))


@query(
    "one_hot",
    "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"{v}\"" for v in "FOP") + " FROM orders",
)
def one_hot(spark, d):
    return clean.hot_encode(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


_VERSION = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN concat('v', strftime(o_orderdate, '%-m.%-d'), '.', o_custkey % 1000) "
    "WHEN o_orderstatus = 'F' THEN concat(strftime(o_orderdate, '%-m.%-d'), '-rc', o_custkey % 10) END AS version FROM orders"
)


@query(
    "regular_version",
    f"SELECT o_orderkey, version, regexp_matches(version, '{text.LOOSE_VERSION}') AS loose FROM ({_VERSION}) "
    f"WHERE regexp_matches(version, '{text.REGULAR_VERSION}')",
)
def regular_version(spark, d):
    day = F.concat_ws(".", F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    version = F.when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("v"), day, F.lit("."), F.pmod("o_custkey", F.lit(1000)))
    ).when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("-rc"), F.pmod("o_custkey", F.lit(10))))
    rows = load(spark, d, "orders").select("o_orderkey", version.alias("version"))
    return rows.where(text.is_regular_version("version")).withColumn("loose", text.is_regular_version("version", loose=True))


@query(
    "mask_filter",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') "
    "AND o_orderpriority <> '5-LOW' AND o_totalprice <= 250000",
)
def mask_filter(spark, d):
    o = load(spark, d, "orders")
    model = (F.col("o_orderstatus") == "F") | (F.col("o_orderstatus") == "O")
    return o.where(model & (F.col("o_orderpriority") != "5-LOW") & (F.col("o_totalprice") <= 250000)).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@query("project_in", sql("SELECT project, version, commits AS n FROM release_effort WHERE project IN ('1-URGENT', '2-HIGH')"))
def project_in(spark, d):
    rows = s.release_effort(spark, d).where(F.col("project").isin(POPULAR))
    return rows.select("project", "version", F.col("commits").alias("n"))


@query("project_not_in", sql("SELECT project, version, commits AS n FROM release_effort WHERE project NOT IN ('1-URGENT', '2-HIGH')"))
def project_not_in(spark, d):
    rows = s.release_effort(spark, d).where(~F.col("project").isin(POPULAR))
    return rows.select("project", "version", F.col("commits").alias("n"))


def _fences(table: str, value: str, by: str) -> str:
    return f"""SELECT t.* FROM {table} t JOIN (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3
        FROM {table} GROUP BY 1) q USING ({by}) WHERE t.{value} > q1 - 1.5 * (q3 - q1) AND t.{value} < q3 + 1.5 * (q3 - q1)"""


@query("iqr_filter", f"SELECT event_id, event_type, value FROM ({_fences('events', 'value', 'event_type')})")
def iqr_filter(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    return clean.remove_outliers(rows, "value", ["event_type"])


@query(
    "iqr_filter_chain",
    f"WITH once AS ({_fences('events', 'value', 'event_type')}) "
    f"SELECT event_id, event_type, value FROM ({_fences('once', 'value', 'event_type')})",
)
def iqr_filter_chain(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "value")
    once = clean.remove_outliers(rows, "value", ["event_type"])
    return clean.remove_outliers(once, "value", ["event_type"])


_YHAT = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 1 AS y, l_discount * 200 AS p FROM lineitem"


@query(
    "percent_error",
    f"""SELECT y, p, {r('abs(y - p)', 2)} AS difference,
        CASE WHEN y = 0 THEN abs(p) ELSE {r('abs(y - p) / y', 2)} END AS absolute,
        CASE WHEN y = 0 THEN 0 ELSE {r('abs(y - p) / y', 2)} END AS zeroed,
        CASE WHEN y = 0 AND p <> 0 THEN -1 WHEN y = 0 THEN 0 ELSE {r('abs(y - p) / y', 2)} END AS infinite, count(*) AS n
        FROM (SELECT {r('y', 2)} AS y, {r('p', 2)} AS p FROM ({_YHAT})) GROUP BY ALL""",
)
def percent_error(spark, d):
    rows = load(spark, d, "lineitem").select(
        rnd(F.col("l_quantity") - 1, 2).alias("y"), rnd(F.col("l_discount") * 200, 2).alias("p")
    )
    pairs = rows.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    endless = numbers.percent_error("y", "p", "infinite")
    return pairs.select(
        "y", "p", rnd(F.abs(F.col("y") - F.col("p")), 2).alias("difference"),
        numbers.percent_error("y", "p", "absolute").alias("absolute"),
        numbers.percent_error("y", "p", "zero").alias("zeroed"),
        F.when(endless == float("inf"), F.lit(-1.0)).otherwise(endless).alias("infinite"), "n",
    )


@query(
    "contrib_floor",
    sql(f"SELECT {_KEY}, CASE WHEN coalesce(t_cc, 0) = 0 AND module_ec > 0 THEN 1 ELSE coalesce(t_cc, 0) END AS people FROM dataset"),
)
def contrib_floor(spark, d):
    rows = s.dataset(spark, d).withColumn("t_cc", F.coalesce("t_cc", F.lit(0)))
    return rows.select(*_T, costs.min_contrib("t_cc", "module_ec").alias("people"))


@query(
    "effort_contribs",
    sql(f"""SELECT {_KEY}, {r('least(module_ec / (avg(module_ec) OVER w / avg(t_ec) OVER w), t_ec)', 2)} AS people
            FROM filled WINDOW w AS (PARTITION BY project, task)"""),
)
def effort_contribs(spark, d):
    from effortloom.operators.ordered import attach

    rows = s.filled(spark, d)
    rate = rows.groupBy("project", "task").agg(numbers.ratio(F.avg("module_ec"), F.avg("t_ec")).alias("rate"))
    return attach(rows, rate, ["project", "task"]).select(
        *_T, costs.calculate_contribs("module_ec", "rate", "t_ec").alias("people")
    )


def _share(top: str, unit: str) -> str:
    return r(f"{unit}_{top} / nullif(CAST({unit}_cc + {unit}_ec AS DOUBLE), 0)", 2) + f" AS {unit}_{top}_p"


@query(
    "effort_shares",
    sql(f"SELECT {_KEY}, {', '.join(_share(t, u) for u in ('line', 'module') for t in ('cc', 'ec'))} FROM dataset"),
)
def effort_shares(spark, d):
    return export.effort_shares(s.dataset(spark, d)).select(*_T, "line_cc_p", "line_ec_p", "module_cc_p", "module_ec_p")


@query("repo_key", "SELECT page_id, substr(url, 30) AS repo FROM pages")
def repo_key(spark, d):
    return load(spark, d, "pages").select("page_id", text.repo_key("url").alias("repo"))


@query("repo_short", "SELECT page_id, split_part(substr(url, 30), '/', 2) AS repo FROM pages")
def repo_short(spark, d):
    return load(spark, d, "pages").select("page_id", text.repo_short(text.repo_key("url")).alias("repo"))


@query(
    "format_metrics",
    """SELECT o_orderkey, format('Pred - PRED (25): {:.2f}%', o_totalprice / 5000) AS pred,
       concat('Model - R Squared: ', CAST(round_even(o_totalprice / 5000, 0) AS VARCHAR)) AS metric,
       CASE WHEN o_orderstatus = 'F' THEN 'Files' ELSE 'LOC' END AS unit,
       strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
)
def format_metrics(spark, d):
    model = F.when(F.col("o_orderstatus") == "F", F.lit("Module_CC")).otherwise(F.lit("Line_CC"))
    return load(spark, d, "orders").select(
        "o_orderkey", text.format_pred("25", F.col("o_totalprice") / 5000 / 100).alias("pred"),
        text.format_metric("Model - R Squared", F.rint(F.col("o_totalprice") / 5000)).alias("metric"),
        text.effort_unit(model).alias("unit"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
    )


_SAMPLE = "md5(concat_ws('|', '0', CAST(o_orderkey AS VARCHAR)))"


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_n(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "seeded_sample",
    f"""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_SAMPLE}, o_orderkey) AS rn
        FROM orders) WHERE rn <= 64""",
)
def seeded_sample(spark, d):
    return sample.seeded_sample(
        load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 64, ["o_orderpriority"]
    )


@query(
    "train_test_split",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_SAMPLE}, o_orderkey) - 1 < ceil(count(*) OVER () * 0.124::DOUBLE) AS is_test FROM orders""",
)
def train_test_split(spark, d):
    return sample.train_test_split(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.124)


@query(
    "concat_results",
    sql(f"""SELECT project, 'CC' AS role, count(nt_cc) AS n, {big('sum(nt_cc)')} AS nt FROM dataset GROUP BY 1
            UNION ALL SELECT project, 'EC', count(nt_ec), {big('sum(nt_ec)')} FROM dataset GROUP BY 1"""),
)
def concat_results(spark, d):
    rows = s.pinned_dataset(spark, d)
    sides = [
        rows.groupBy("project").agg(F.count(f"nt_{x}").alias("n"), F.sum(f"nt_{x}").alias("nt")).withColumn("role", F.lit(x.upper()))
        for x in ("cc", "ec")
    ]
    return sides[0].unionByName(sides[1]).select("project", "role", "n", "nt")


@query(
    "ordered_export",
    sql(f"""SELECT {_KEY}, CAST(date AS VARCHAR) AS date, t_module, t_line, {', '.join(s.WIDE)} FROM dataset
            ORDER BY project, date, t_line, coalesce(task, 'Z'), version DESC"""),
)
def ordered_export(spark, d):
    rows = s.dataset(spark, d).orderBy(*export.export_order())
    return rows.select(*_T, F.col("date").cast("string").alias("date"), "t_module", "t_line", *s.WIDE)
