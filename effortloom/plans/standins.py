"""The given tables read as software history, once with DataFrames and once as SQL for the checks.

orders are commits (customer = committer, priority = project, month = release), line items are the touched files,
part names are commit messages, customers are users, events are pull-request history and comments.
"""

from __future__ import annotations

from decimal import Decimal

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effortloom.functions.special import PROBIT_A, PROBIT_B, PROBIT_C, PROBIT_D
from effortloom.operators import classify, export, releases, roles
from effortloom.session import pin
from effortloom.sources.tables import load

# Words found in part names, so that several classes are populated.
PART_RULES = [("BUG", ["widget"]), ("DOCS", ["ring", "bolt"]), ("REFACTOR", ["gear", "small"])]
PART_TASKS = ["BUG", "DOCS", "REFACTOR", "OTHER"]


def r(expression: str, digits: int = 6) -> str:
    """SQL text of the half-even rounding the DataFrame side uses."""
    return f"(round_even(CAST(({expression}) AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + CAST(0 AS DOUBLE))"


def big(expression: str) -> str:
    return f"CAST(({expression}) AS BIGINT)"


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Pending orders have no recorded committer."""
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("sha"),
        F.col("o_orderpriority").alias("project"),
        F.col("o_custkey").alias("author"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("committer_id"),
        F.to_date("o_orderdate").alias("date"),
        F.date_format("o_orderdate", "yyyy-MM").alias("version"),
        F.col("o_totalprice").alias("price"),
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines per commit and the part of its first line (smallest line number, then smallest part).

    The pair is one decimal, line number times 2^63 plus part, which holds any two such numbers and, unlike a struct, can
    be kept in a hash aggregation.
    """
    shift = F.lit(Decimal(1 << 63)).cast("decimal(19,0)")
    first = (F.col("l_linenumber").cast("decimal(10,0)") * shift + F.col("l_partkey").cast("decimal(19,0)")).cast("decimal(30,0)")
    return (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("sha"))
        .agg(
            F.count(F.lit(1)).alias("e_module"),
            F.sum("l_quantity").cast("bigint").alias("e_line"),
            F.min(first).alias("_first"),
        )
        .select("sha", "e_module", "e_line", (F.col("_first") % shift).cast("bigint").alias("p_partkey"))
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    parts = load(spark, d, "part").select("p_partkey", F.col("p_name").alias("message"))
    return changes(spark, d).join(parts, "p_partkey", "left")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Classified commits with their effort; commits that touch no file take no part."""
    noted = classify.with_task(messages(spark, d), "message", "task", PART_RULES).select(
        "sha", F.col("e_module").alias("module"), F.col("e_line").alias("line"), "task"
    )
    return commits(spark, d).select("sha", "project", "version", "date", "committer_id").join(noted, "sha")


def users(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("login"), (F.col("c_acctbal") < 0).alias("fake")
    )


def projects(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderpriority").alias("id")).distinct()


def contributor_commits(spark: SparkSession, d: str) -> DataFrame:
    return commits(spark, d).select(F.col("project").alias("project_id"), "committer_id", "sha")


def merge_requests(spark: SparkSession, d: str) -> DataFrame:
    """One pull request per order."""
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("base_repo_id"))


def _action():
    kind = F.col("event_type")
    return F.when(kind == "purchase", "merged").when(kind == "error", "closed").otherwise(kind).alias("action")


def merge_history(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("event_id").alias("pull_request_id"), F.col("user_id").alias("actor_id"), _action()
    )


def everyone(spark: SparkSession, d: str) -> DataFrame:
    return roles.all_contributors(contributor_commits(spark, d), users(spark, d))


def core(spark: SparkSession, d: str) -> DataFrame:
    return roles.core_contributors(merge_requests(spark, d), merge_history(spark, d), users(spark, d))


def external(spark: SparkSession, d: str) -> DataFrame:
    return roles.external_contributors(everyone(spark, d), core(spark, d))


def role_table(spark: SparkSession, d: str) -> DataFrame:
    return roles.role_table(core(spark, d), everyone(spark, d))


def role_rollup(spark: SparkSession, d: str) -> DataFrame:
    return roles.role_rollup(facts(spark, d), role_table(spark, d))


def release_effort(spark: SparkSession, d: str) -> DataFrame:
    """One row per project and month, dated at the month's end: the number of rows is bounded by the calendar."""
    joined = commits(spark, d).select("sha", "project", "version", "date").join(
        changes(spark, d).select("sha", "e_module", "e_line"), "sha", "left"
    )
    return joined.groupBy("project", "version", F.last_day("date").alias("date")).agg(
        F.count(F.lit(1)).alias("commits"),
        F.coalesce(F.sum("e_module"), F.lit(0)).alias("e_module"),
        F.coalesce(F.sum("e_line"), F.lit(0)).alias("e_line"),
    )


def release_table(spark: SparkSession, d: str) -> DataFrame:
    return releases.running_totals(release_effort(spark, d), bounded=True)


def dataset(spark: SparkSession, d: str) -> DataFrame:
    """The wide release dataset; a series has one row per month, so its windows are bounded by the calendar."""
    rollup = roles.role_rollup_wide(facts(spark, d), role_table(spark, d))
    return export.wide_export(release_table(spark, d), rollup, PART_TASKS)


def pinned_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The dataset for plans that read it more than once: the scans of the large tables run a single time."""
    return pin(dataset(spark, d))


def filled(spark: SparkSession, d: str) -> DataFrame:
    """The dataset with the totals of the release before, and 0 for everything missing; pinned."""
    return pin(releases.lag_totals(dataset(spark, d), ["project", "task"], bounded=True).fillna(0))


def review_requests(spark: SparkSession, d: str) -> DataFrame:
    """One pull request per committer: base at its first, head at its last commit."""
    return (
        load(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min(F.struct("o_orderkey", "o_orderpriority")).alias("a"),
            F.max(F.struct("o_orderkey", "o_orderpriority")).alias("b"),
        )
        .select(
            F.col("o_custkey").alias("id"), F.col("o_custkey").alias("pullreq_id"),
            F.col("a.o_orderpriority").alias("base_repo_id"), F.col("a.o_orderkey").alias("base_commit_id"),
            F.col("b.o_orderpriority").alias("head_repo_id"), F.col("b.o_orderkey").alias("head_commit_id"),
        )
    )


def review_history(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("user_id").alias("pull_request_id"), _action()
    )


def review_comments(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("event_type") == kind).select(
        F.col("event_id").alias("comment_id"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("user_id"),
        F.col("user_id").alias("thread_id"),
    )


def changelog_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents, the source standing for the release."""
    return load(spark, d, "documents").select(
        F.col("source").alias("version"), F.explode(F.split("text", "\n")).alias("line")
    )


def holiday(expression: str) -> str:
    """SQL text of the public holiday rules."""
    m, dom, dow = f"month({expression})", f"dayofmonth({expression})", f"dayofweek({expression})"  # 0 is Sunday
    nth = f"(({dom} - 1) // 7 + 1)"
    return (
        f"(({m} = 1 AND {dom} = 1) OR ({m} = 7 AND {dom} = 4) OR ({m} = 11 AND {dom} = 11) OR ({m} = 12 AND {dom} = 25)"
        f" OR ({m} = 1 AND {dow} = 1 AND {nth} = 3) OR ({m} = 2 AND {dow} = 1 AND {nth} = 3)"
        f" OR ({m} = 5 AND {dow} = 1 AND {dom} > 24) OR ({m} = 9 AND {dow} = 1 AND {nth} = 1)"
        f" OR ({m} = 11 AND {dow} = 4 AND {nth} = 4))"
    )


def probit_sql(p: str) -> str:
    """The rational approximation the DataFrame side uses, written out."""
    r2 = f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"

    def poly(coefficients, x):
        out = f"{coefficients[0]!r}::DOUBLE"
        for k in coefficients[1:]:
            out = f"({out} * {x} + {k!r}::DOUBLE)"
        return out

    middle = f"({poly(PROBIT_A, r2)} * ({p} - 0.5) / {poly(PROBIT_B, r2)})"
    outer = f"({poly(PROBIT_C, tail)} / {poly(PROBIT_D, tail)})"
    return f"(CASE WHEN {p} > 0.02425 AND {p} < 0.97575 THEN {middle} WHEN {p} <= 0.5 THEN {outer} ELSE -{outer} END)"


def case_task(column: str, rules=PART_RULES, suffix: str = "OTHER") -> str:
    arms = " ".join(f"WHEN regexp_matches(lower({column}), '({'|'.join(words)})') THEN '{task}'" for task, words in rules)
    return f"CASE {arms} ELSE '{suffix}' END"


def case_rank(column: str, rules=PART_RULES) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(lower({column}), '({'|'.join(words)})') THEN {i}" for i, (_, words) in enumerate(rules)
    )
    return f"CASE {arms} ELSE {len(rules)} END"


_MEASURES = "nt_{r}, no_{r}, module_{r}, line_{r}, t_{r}"
_SIDES = ", ".join(
    f"max({source}) FILTER (role = '{role.upper()}') AS {name}_{role}"
    for role in ("cc", "ec", "uc")
    for name, source in (("nt", "n_t"), ("no", "n_o"), ("module", "module"), ("line", "line"), ("t", "contributors"))
)
WIDE = [f"{m}_{role}" for role in ("cc", "ec", "uc") for m in ("nt", "no", "module", "line", "t")]

CTES: dict[str, str] = {
    "commits": """
        SELECT o_orderkey AS sha, o_orderpriority AS project, o_custkey AS author,
               CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS committer_id,
               CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y-%m') AS version, o_totalprice AS price
        FROM orders""",
    "changes": """
        SELECT l_orderkey AS sha, count(*) AS e_module, CAST(sum(l_quantity) AS BIGINT) AS e_line,
               min(struct_pack(a := l_linenumber, b := l_partkey)).b AS p_partkey
        FROM lineitem GROUP BY 1""",
    "facts": f"""
        SELECT c.sha, c.project, c.version, c.date, c.committer_id, h.e_module AS module, h.e_line AS line,
               {case_task("p.p_name")} AS task
        FROM commits c JOIN changes h ON h.sha = c.sha LEFT JOIN part p ON p.p_partkey = h.p_partkey""",
    "everyone": """
        SELECT DISTINCT c.project AS project_id, u.c_custkey AS committer_id, u.c_name AS committer_login
        FROM commits c, customer u WHERE u.c_custkey = c.committer_id AND NOT u.c_acctbal < 0""",
    "core": """
        SELECT DISTINCT o.o_orderpriority AS project_id, u.c_custkey AS committer_id, u.c_name AS committer_login
        FROM events e, orders o, customer u
        WHERE o.o_orderkey = e.event_id AND u.c_custkey = e.user_id AND e.event_type = 'purchase'""",
    "external": """
        SELECT * FROM everyone e WHERE (e.project_id, e.committer_id) NOT IN (SELECT (project_id, committer_id) FROM core)""",
    "role_rows": """
        SELECT f.*, 'CC' AS role FROM facts f JOIN core k ON k.project_id = f.project AND k.committer_id = f.committer_id
        UNION ALL
        SELECT f.*, 'EC' FROM facts f JOIN external k ON k.project_id = f.project AND k.committer_id = f.committer_id
        UNION ALL
        SELECT f.*, 'UC' FROM facts f WHERE f.committer_id IS NULL""",
    "rollup": """
        SELECT x.project, x.version, x.task, x.role, count(*) AS n_t,
               CASE WHEN x.role = 'UC'
                    THEN (SELECT count(*) FROM facts f WHERE f.project = x.project AND f.version = x.version
                          AND f.task <> x.task AND f.committer_id IS NULL)
                    ELSE (SELECT count(*) FROM facts f WHERE f.project = x.project AND f.version = x.version
                          AND f.task <> x.task) END AS n_o,
               CAST(sum(x.module) AS BIGINT) AS module, CAST(sum(x.line) AS BIGINT) AS line,
               CASE WHEN x.role = 'UC' THEN -1 ELSE count(DISTINCT x.committer_id) END AS contributors
        FROM role_rows x GROUP BY 1, 2, 3, 4""",
    "release_effort": """
        SELECT c.project, c.version, last_day(c.date) AS date, count(*) AS commits,
               CAST(coalesce(sum(h.e_module), 0) AS BIGINT) AS e_module,
               CAST(coalesce(sum(h.e_line), 0) AS BIGINT) AS e_line
        FROM commits c LEFT JOIN changes h ON h.sha = c.sha GROUP BY 1, 2, 3""",
    "release_table": """
        SELECT *, CAST(sum(e_module) OVER w AS BIGINT) AS t_module, CAST(sum(e_line) OVER w AS BIGINT) AS t_line
        FROM release_effort WINDOW w AS (PARTITION BY project ORDER BY date, version
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "sides": f"SELECT project, version, task, {_SIDES} FROM rollup GROUP BY 1, 2, 3",
    "dataset": f"""
        SELECT v.project, v.version, v.date, t.task, v.t_module, v.t_line, {", ".join("s." + c for c in WIDE)}
        FROM release_table v CROSS JOIN (SELECT unnest({PART_TASKS!r}) AS task) t
        LEFT JOIN sides s ON s.project = v.project AND s.version = v.version AND s.task = t.task""",
    "lagged": """
        SELECT *, lag(t_module) OVER w AS t_module_p, lag(t_line) OVER w AS t_line_p
        FROM dataset WINDOW w AS (PARTITION BY project, task ORDER BY date, t_line, version)""",
    "filled": f"""
        SELECT project, version, date, task, t_module, t_line, coalesce(t_module_p, 0) AS t_module_p,
               coalesce(t_line_p, 0) AS t_line_p, {", ".join(f"coalesce({c}, 0) AS {c}" for c in WIDE)}
        FROM lagged""",
    "review_requests": """
        SELECT o_custkey AS id, o_custkey AS pullreq_id,
               arg_min(o_orderpriority, o_orderkey) AS base_repo_id, min(o_orderkey) AS base_commit_id,
               arg_max(o_orderpriority, o_orderkey) AS head_repo_id, max(o_orderkey) AS head_commit_id
        FROM orders GROUP BY 1""",
    "prs": """
        SELECT DISTINCT f.project, f.version, f.task, p.id AS pr_id, p.pullreq_id
        FROM facts f JOIN review_requests p
          ON (p.base_repo_id = f.project AND p.base_commit_id = f.sha)
          OR (p.head_repo_id = f.project AND p.head_commit_id = f.sha)
        WHERE p.id IN (SELECT user_id FROM events WHERE event_type = 'error')""",
    "comments": r"""
        SELECT event_id AS comment_id, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS user_id,
               user_id AS pull_request_id FROM events WHERE event_type = 'view'
        UNION ALL
        SELECT e.event_id, CAST(regexp_extract(e.props, '(\d+)', 1) AS BIGINT), c.c_custkey
        FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'click'""",
    "doc_lines": "SELECT source AS version, unnest(string_split(text, chr(10))) AS line FROM documents",
}


def sql(body: str, **more: str) -> str:
    """``body`` with the stand-in tables it mentions in front, each once and in dependency order."""
    known = {**CTES, **more}
    chosen: list[str] = []

    def need(text: str) -> None:
        for name, definition in known.items():
            if name not in chosen and re.search(rf"\b{name}\b(?!\s*\()", text):
                if definition is not text:
                    need(definition)
                    if name not in chosen:
                        chosen.append(name)

    need(body)
    if not chosen:
        return body
    # Tables named m_... are read many times by the check and computed once.
    once = {n: "AS MATERIALIZED" if n.startswith("m_") else "AS" for n in chosen}
    return "WITH " + ",\n".join(f"{n} {once[n]} ({known[n]})" for n in chosen) + "\n" + body
