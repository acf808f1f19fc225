"""Classification, contributors, releases, pull requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from effortloom.operators import ancestry, classify, export, releases, reviews, roles
from effortloom.operators.calendar import previous_date
from effortloom.operators.ordered import ordered
from effortloom.plans import standins as s
from effortloom.plans.registry import query
from effortloom.plans.standins import big, case_rank, case_task, sql
from effortloom.session import pin
from effortloom.sources.tables import load

_NAMES = "['BUG', 'DOCS', 'REFACTOR', 'OTHER']"


@query(
    "classify_tasks",
    f"""WITH msg AS (SELECT l.l_returnflag AS key, strftime(l.l_shipdate, '%Y-%m') AS version, l.l_orderkey AS sha,
                     {case_rank('p.p_name')} AS rnk FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
             fst AS (SELECT key, sha, min(rnk) AS rnk FROM msg GROUP BY 1, 2)
        SELECT m.key, m.version, m.sha, ({_NAMES})[m.rnk + 1] AS task
        FROM msg m JOIN fst f ON f.key = m.key AND f.sha = m.sha AND f.rnk = m.rnk""",
)
def classify_tasks(spark, d):
    lines = load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("key"), F.date_format("l_shipdate", "yyyy-MM").alias("version"),
        F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("p_partkey"),
    )
    parts = load(spark, d, "part").select("p_partkey", F.col("p_name").alias("message"))
    return classify.classify_tasks(lines.join(parts, "p_partkey"), rules=s.PART_RULES)


@query(
    "classify_tasks_docs",
    f"SELECT source AS key, lang AS version, doc_id AS sha, {case_task('text', classify.TASK_RULES)} AS task FROM documents",
)
def classify_tasks_docs(spark, d):
    docs = load(spark, d, "documents").select(
        F.col("source").alias("key"), F.col("lang").alias("version"), F.col("doc_id").alias("sha"), F.col("text").alias("message")
    )
    return classify.classify_tasks(docs)


@query(
    "corrective_counts",
    sql("""SELECT version, count(*) FILTER (regexp_matches(line, 'fix|bug|defect')) AS nt,
           count(*) FILTER (NOT regexp_matches(line, 'fix|bug|defect')) AS no FROM doc_lines GROUP BY 1"""),
)
def corrective_counts(spark, d):
    return classify.corrective_counts(s.changelog_lines(spark, d), ["version"])


@query(
    "task_histogram",
    sql("SELECT project, version, " + ", ".join(f"count(*) FILTER (task = '{t}') AS {t.lower()}" for t in classify.TASKS)
        + " FROM facts GROUP BY 1, 2"),
)
def task_histogram(spark, d):
    return classify.task_counts(s.facts(spark, d), ["project", "version"])


@query("all_contributors", sql("SELECT * FROM everyone"))
def all_contributors(spark, d):
    return roles.all_contributors(s.contributor_commits(spark, d), s.users(spark, d), s.projects(spark, d))


@query("core_contributors", sql("SELECT * FROM core"))
def core_contributors(spark, d):
    return roles.core_contributors(s.merge_requests(spark, d), s.merge_history(spark, d), s.users(spark, d), s.projects(spark, d))


@query("external_contributors", sql("SELECT * FROM external"))
def external_contributors(spark, d):
    return s.external(spark, d)


@query("unknown_commits", sql("SELECT sha, project FROM commits WHERE committer_id IS NULL"))
def unknown_commits(spark, d):
    made = s.commits(spark, d).select("sha", "project", "committer_id")
    return roles.unknown_commits(made.select("sha", "project"), made)


_ROLLUP = "project, version, task, n_t, n_o, module, line, contributors"


@query("role_rollup_all", sql(f"SELECT role, {_ROLLUP} FROM rollup"))
def role_rollup_all(spark, d):
    return s.role_rollup(spark, d)


def _one_role(spark, d, role):
    return s.role_rollup(spark, d).where(F.col("role") == role).drop("role")


@query("core_commits", sql(f"SELECT {_ROLLUP} FROM rollup WHERE role = 'CC'"))
def core_commits(spark, d):
    return _one_role(spark, d, roles.CORE)


@query("external_commits", sql(f"SELECT {_ROLLUP} FROM rollup WHERE role = 'EC'"))
def external_commits(spark, d):
    return _one_role(spark, d, roles.EXTERNAL)


@query("unknown_commits_rollup", sql(f"SELECT {_ROLLUP} FROM rollup WHERE role = 'UC'"))
def unknown_commits_rollup(spark, d):
    return _one_role(spark, d, roles.UNKNOWN)


@query(
    "role_rollup_fanout",
    sql(f"""SELECT f.project, f.version, f.task, count(*) AS n_t, {big('sum(f.module)')} AS module, {big('sum(f.line)')} AS line,
            count(DISTINCT f.committer_id) AS contributors
            FROM facts f JOIN core k ON k.committer_id = f.committer_id GROUP BY 1, 2, 3"""),
)
def role_rollup_fanout(spark, d):
    """Core effort with the contributor join not scoped to the project."""
    spread = roles.role_rollup(s.facts(spark, d), s.role_table(spark, d), fanout=True)
    return spread.where(F.col("role") == roles.CORE).drop("role", "n_o")


@query(
    "other_task_count",
    sql("""SELECT project, version, task, count(*) AS n_t,
           CAST(sum(count(*)) OVER (PARTITION BY project, version) AS BIGINT) - count(*) AS n_o FROM facts GROUP BY 1, 2, 3"""),
)
def other_task_count(spark, d):
    return roles.other_task_count(s.facts(spark, d))


@query("wide_export", sql(f"SELECT project, version, CAST(date AS VARCHAR) AS date, task, t_module, t_line, {', '.join(s.WIDE)} FROM dataset"))
def wide_export(spark, d):
    return s.dataset(spark, d).withColumn("date", F.col("date").cast("string"))


@query(
    "assign_release",
    sql("""SELECT c.sha, t.version AS version FROM commits c
           ASOF LEFT JOIN (SELECT project, last_day(date) AS date, min(strftime(date, 'r%Y-%m')) AS version FROM commits
                           WHERE month(date) % 2 = 0 GROUP BY 1, 2) t
           ON t.project = c.project AND t.date >= c.date"""),
)
def assign_release(spark, d):
    """Releases at the end of every second month; commits of the months between belong to the next one."""
    made = s.commits(spark, d).select("sha", "project", "date")
    tags = (
        made.where(F.month("date") % 2 == 0)
        .groupBy("project", F.last_day("date").alias("date"))
        .agg(F.min(F.concat(F.lit("r"), F.date_format("date", "yyyy-MM"))).alias("version"))
    )
    return releases.assign_release(made, tags).select("sha", "version")


@query(
    "commits_of_ranges",
    """WITH RECURSIVE c AS (SELECT o_orderkey AS sha, o_orderpriority AS project, strftime(o_orderdate, '%Y-%m') AS version,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders),
             e AS (SELECT project, n, greatest(n - 4, 0) AS p FROM c WHERE n > 0
                   UNION SELECT project, n, n - 1 FROM c WHERE n > 0 AND n % 12 = 0
                   UNION SELECT project, n, n - 6 FROM c WHERE n % 20 = 6),
             t AS (SELECT project, version, max(n) AS n FROM c GROUP BY 1, 2),
             g AS (SELECT *, lag(n) OVER (PARTITION BY project ORDER BY version) AS old FROM t),
             a(project, tag, n) AS (SELECT project, n, n FROM t
                   UNION SELECT a.project, a.tag, e.p FROM a JOIN e ON e.project = a.project AND e.n = a.n)
        SELECT g.project, g.version, c.sha FROM g JOIN a ON a.project = g.project AND a.tag = g.n
        JOIN c ON c.project = a.project AND c.n = a.n
        LEFT JOIN a b ON b.project = g.project AND b.tag = g.old AND b.n = a.n WHERE b.n IS NULL""",
)
def commits_of_ranges(spark, d):
    """Four lines of work take turns at the commits of a project: the fourth is merged into the first every twelve
    commits, the first into the third every twenty. The tag of a month is its newest commit."""
    made = s.commits(spark, d).select("project", "sha", "version")
    made = pin(ordered(made, ["project"], ["sha"], position="n"))
    n = F.col("n")
    older = F.array(
        F.struct(F.lit(0).alias("place"), F.when(n > 0, F.greatest(n - 4, F.lit(0))).alias("n")),
        F.struct(F.lit(1).alias("place"), F.when((n > 0) & (n % 12 == 0), n - 1).when(n % 20 == 6, n - 6).alias("n")),
    )
    asked = made.select("project", "sha", F.explode(older).alias("p")).select("project", "sha", "p.place", "p.n").where("n IS NOT NULL")
    parents = asked.join(made.select("project", "n", F.col("sha").alias("parent")), ["project", "n"])
    newest = made.groupBy("project", "version").agg(F.max("sha").alias("sha"))
    tags = ordered(newest, ["project"], ["version"], previous={"previous_sha": "sha"}, bounded=True)
    return ancestry.commits_of_ranges(tags, parents)


@query(
    "tag_pairs",
    sql("""SELECT * FROM (SELECT project, lag(version) OVER (PARTITION BY project ORDER BY date, version) AS from_version,
           version AS to_version FROM release_effort) WHERE from_version IS NOT NULL"""),
)
def tag_pairs(spark, d):
    tags = s.release_effort(spark, d).select("project", "version", "date")
    return releases.tag_pairs(tags, bounded=True).select("project", "from_version", "to_version")


@query("release_metrics", sql("SELECT project, version, CAST(date AS VARCHAR) AS date, commits AS n, e_module, e_line FROM release_effort"))
def release_metrics(spark, d):
    rows = s.release_effort(spark, d)
    return rows.select("project", "version", F.col("date").cast("string").alias("date"), F.col("commits").alias("n"), "e_module", "e_line")


@query(
    "release_totals",
    sql(f"""SELECT c.project, c.version, count(*) AS t_module, {big('sum(x.lines)')} AS t_line
            FROM commits c JOIN (SELECT l_orderkey AS sha, l_partkey AS path, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2) x
            USING (sha) GROUP BY 1, 2"""),
)
def release_totals(spark, d):
    files = (
        load(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))
        .agg(F.sum("l_quantity").cast("bigint").alias("lines"))
    )
    snapshot = s.commits(spark, d).select("sha", "project", "version").join(files, "sha")
    return releases.release_totals(snapshot, ["project", "version"])


@query(
    "release_paths",
    sql(f"""SELECT c.project, c.version, count(DISTINCT l_partkey) AS e_module, {big('sum(l_quantity)')} AS e_line
            FROM commits c JOIN lineitem ON l_orderkey = c.sha GROUP BY 1, 2"""),
)
def release_paths(spark, d):
    lines = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").alias("lines")
    )
    touched = s.commits(spark, d).select("sha", "project", "version").join(lines, "sha")
    return releases.release_paths(touched, ["project", "version"])


@query("running_totals", sql("SELECT project, version, t_module, t_line FROM release_table"))
def running_totals(spark, d):
    return s.release_table(spark, d).select("project", "version", "t_module", "t_line")


@query("lag_totals", sql("SELECT project, version, task, t_module_p, t_line_p FROM lagged"))
def lag_totals(spark, d):
    rows = releases.lag_totals(s.dataset(spark, d), ["project", "task"], bounded=True)
    return rows.select("project", "version", "task", "t_module_p", "t_line_p")


@query(
    "lag_date",
    sql("""SELECT project, version, CAST(coalesce(lag(date) OVER (PARTITION BY project ORDER BY date, t_line, version),
           min(date) OVER (PARTITION BY project)) AS VARCHAR) AS date_p FROM release_table"""),
)
def lag_date(spark, d):
    rows = previous_date(s.release_table(spark, d), ["project"], releases.SERIES_ORDER, bounded=True)
    return rows.select("project", "version", F.col("date_p").cast("string").alias("date_p"))


@query("row_index", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events")
def row_index(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "ts")
    return ordered(rows, ["event_type"], ["ts", "event_id"], position="i").select("event_id", F.col("i").cast("bigint").alias("i"))


@query(
    "quarterly_rollup",
    sql(f"SELECT year(date) AS year, quarter(date) AS quarter, {big('sum(e_module)')} AS e_module, {big('sum(e_line)')} AS e_line "
        "FROM release_effort GROUP BY 1, 2"),
)
def quarterly_rollup(spark, d):
    return releases.quarterly_rollup(s.release_effort(spark, d), ["e_module", "e_line"])


@query(
    "yearly_effort",
    sql(f"""SELECT * EXCLUDE (age) FROM (SELECT project, year(date) AS year, {big('sum(e_module)')} AS e_module, {big('sum(e_line)')} AS e_line,
            row_number() OVER (PARTITION BY project ORDER BY year(date) DESC) AS age FROM release_effort GROUP BY 1, 2) WHERE age <= 4"""),
)
def yearly_effort(spark, d):
    return releases.yearly_totals(s.release_effort(spark, d), ["project"], ["e_module", "e_line"], years=3)


def _tagged(spark, d):
    return s.facts(spark, d).select(
        F.col("project").alias("project_id"), F.col("sha").alias("commit_id"), "project", "version", "task"
    )


def _prs(spark, d):
    matched = reviews.pr_commit_match(_tagged(spark, d), s.review_requests(spark, d))
    return reviews.with_action(matched, s.review_history(spark, d)).select("project", "version", "task", "pr_id", "pullreq_id")


def _comments(spark, d):
    own = s.review_comments(spark, d, "view").withColumnRenamed("thread_id", "pull_request_id")
    issue = s.review_comments(spark, d, "click").withColumnRenamed("thread_id", "issue_id")
    issues = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("pull_request_id"))
    return reviews.comment_union(own, issue, issues)


@query("pr_commit_match", sql("SELECT project, version, task, pr_id, pullreq_id FROM prs"))
def pr_commit_match(spark, d):
    return _prs(spark, d)


@query("comment_union", sql("SELECT comment_id, user_id, pull_request_id FROM comments"))
def comment_union(spark, d):
    return _comments(spark, d)


@query("comment_semi", sql("SELECT comment_id, user_id, pull_request_id FROM comments WHERE pull_request_id IN (SELECT pr_id FROM prs)"))
def comment_semi(spark, d):
    ids = _prs(spark, d).select(F.col("pr_id").alias("pull_request_id")).distinct()
    return _comments(spark, d).join(ids, "pull_request_id", "left_semi").select("comment_id", "user_id", "pull_request_id")


@query(
    "comment_rollup",
    sql("SELECT pull_request_id, count(comment_id) AS comments, count(DISTINCT user_id) AS commenters FROM comments GROUP BY 1"),
)
def comment_rollup(spark, d):
    return reviews.comment_rollup(_comments(spark, d))


_TALK = "SELECT pull_request_id, count(comment_id) AS n_c, count(DISTINCT user_id) AS n_u FROM comments GROUP BY 1"


@query(
    "pr_rollup",
    sql(f"""SELECT x.project, x.version, x.task, count(DISTINCT x.pr_id) AS n_t, {big('sum(t_commits)')} AS t_commits,
            {big('sum(module)')} AS module, {big('sum(line)')} AS line, {big('sum(contributions)')} AS contributions,
            {big('sum(contributors)')} AS contributors, {big('sum(n_c)')} AS comments, {big('sum(n_u)')} AS commenters
            FROM (SELECT p.project, p.version, p.task, p.pr_id, count(*) AS t_commits, sum(f.module) AS module, sum(f.line) AS line,
                  count(f.committer_id) AS contributions, count(DISTINCT f.committer_id) AS contributors
                  FROM prs p JOIN orders o ON o.o_custkey = p.pr_id JOIN facts f ON f.sha = o.o_orderkey AND f.project = p.project
                  AND f.version = p.version AND f.task = p.task GROUP BY 1, 2, 3, 4) x
            LEFT JOIN ({_TALK}) t ON t.pull_request_id = x.pr_id GROUP BY 1, 2, 3"""),
)
def pr_rollup(spark, d):
    commits = s.facts(spark, d).select("project", "version", "task", F.col("sha").alias("commit_id"), "committer_id", "module", "line")
    links = load(spark, d, "orders").select(F.col("o_custkey").alias("pull_request_id"), F.col("o_orderkey").alias("commit_id"))
    prs = _prs(spark, d)
    return reviews.pr_rollup(prs.drop("pullreq_id"), commits, links, reviews.comment_rollup(_comments(spark, d), prs))


@query(
    "pr_rollup_releases",
    sql("""SELECT v.project, v.version, count(DISTINCT p.pr_id) AS n_t FROM release_table v
           LEFT JOIN prs p ON p.project = v.project AND p.version = v.version GROUP BY 1, 2"""),
)
def pr_rollup_releases(spark, d):
    """Every release with its pull requests; releases without any stay."""
    counts = _prs(spark, d).select("project", "version", "pr_id").distinct().groupBy("project", "version").agg(F.count(F.lit(1)).alias("n_t"))
    return s.release_table(spark, d).select("project", "version").join(counts, ["project", "version"], "left").fillna(0)
