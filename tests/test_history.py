"""Classification, contributors, releases, reviews and costs on small frames with awkward cases."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from effortloom.operators import ancestry, calendar, classify, costs, export, releases, reviews, roles

D = dt.date


def rows(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


def test_first_matching_class_claims_the_commit_everywhere(spark):
    messages = spark.createDataFrame(
        [
            ("p", "v1", "1", "Fix the docs"), ("p", "v1", "2", "Update DOCS"), ("p", "v2", "2", "Bugfix for docs"),
            ("p", "v1", "3", "add tests"), ("p", "v1", "4", None), ("p", "v2", "5", "contest of features"),
            ("q", "v1", "2", "Update documentation"), ("p", "v3", "6", "reinstall"), ("p", "v3", "7", "words"),
        ],
        "key string, version string, sha string, message string",
    )
    got = rows(classify.classify_tasks(messages), "key", "version", "sha", "task")
    assert got == sorted(
        [
            ("p", "v1", "1", "BUG"), ("p", "v2", "2", "BUG"), ("p", "v1", "3", "TESTING"), ("p", "v1", "4", "OTHER"),
            ("p", "v2", "5", "TESTING"), ("q", "v1", "2", "DOCS"), ("p", "v3", "6", "UPGRADE"), ("p", "v3", "7", "OTHER"),
        ],
        key=str,
    )


def test_corrective_lines_keep_their_case(spark):
    lines = spark.createDataFrame([("v", "fix it (a)"), ("v", "Fix it (a)"), ("v", "x (bugsy)"), ("w", "y")], "version string, line string")
    assert rows(classify.corrective_counts(lines, ["version"]), "version", "nt", "no") == [("v", 2, 1), ("w", 0, 1)]


@pytest.fixture(scope="module")
def people(spark):
    commits = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (1, None), (1, 11), (3, 11)], "project_id int, committer_id int")
    users = spark.createDataFrame([(10, "a", False), (11, "b", False), (12, "c", True), (13, "d", True)], "id int, login string, fake boolean")
    projects = spark.createDataFrame([(1,), (2,)], "id int")
    prs = spark.createDataFrame([(100, 1), (101, 1), (102, 9)], "id int, base_repo_id int")
    history = spark.createDataFrame(
        [(100, 10, "merged"), (100, 10, "merged"), (101, 13, "merged"), (101, 11, "closed"), (102, 11, "merged")],
        "pull_request_id int, actor_id int, action string",
    )
    everyone = roles.all_contributors(commits, users, projects)
    core = roles.core_contributors(prs, history, users, projects)
    return everyone, core, roles.external_contributors(everyone, core)


def test_contributors(people):
    everyone, core, external = people
    assert rows(everyone, "project_id", "committer_login") == [(1, "a"), (1, "b"), (2, "a")]
    assert rows(core, "project_id", "committer_login") == [(1, "a"), (1, "d")]  # fake users may be core
    assert rows(external, "project_id", "committer_login") == [(1, "b"), (2, "a")]


def test_roll_up(spark):
    facts = spark.createDataFrame(
        [
            ("p", "v", "BUG", 1, 1, 10), ("p", "v", "BUG", 1, 2, 20), ("p", "v", "BUG", 2, 3, 30), ("p", "v", "DOCS", None, 4, 40),
            ("p", "v", "BUG", None, 5, 50), ("p", "v", "DOCS", 3, 6, 60), ("p", "v", "OTHER", 99, 7, 70),
        ],
        "project string, version string, task string, committer_id int, module int, line int",
    )
    table = roles.role_table(
        spark.createDataFrame([("p", 1), ("q", 1), ("q", 2)], "project_id string, committer_id int"),
        spark.createDataFrame([("p", 2), ("p", 3), ("p", 1)], "project_id string, committer_id int"),
    )
    names = ("task", "role", "n_t", "n_o", "module", "line", "contributors")
    assert rows(roles.role_rollup(facts, table), *names) == [
        ("BUG", "CC", 2, 3, 3, 30, 1), ("BUG", "EC", 1, 3, 3, 30, 1), ("BUG", "UC", 1, 1, 5, 50, -1),
        ("DOCS", "EC", 1, 5, 6, 60, 1), ("DOCS", "UC", 1, 1, 4, 40, -1),
    ]
    wide = roles.role_rollup(facts, table, fanout=True)
    assert ("BUG", "CC", 5, 9) in rows(wide, "task", "role", "n_t", "module")  # committer 1 twice, committer 2 once


def test_unknown_commits(spark):
    commits = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3)], "project string, sha int")
    known = spark.createDataFrame([("p", 1, 7), ("p", 2, None), ("q", 3, 7)], "project string, sha int, committer_id int")
    assert rows(roles.unknown_commits(commits, known), "sha") == [(2,), (3,)]


def test_release_of_a_commit(spark):
    commits = spark.createDataFrame(
        [("p", 1, D(2020, 1, 1)), ("p", 2, D(2020, 1, 5)), ("p", 3, D(2020, 1, 6)), ("p", 4, D(2020, 2, 1)), ("q", 5, D(2020, 1, 1))],
        "project string, sha int, date date",
    )
    tags = spark.createDataFrame([("p", "a", D(2020, 1, 5)), ("p", "b", D(2020, 1, 20)), ("p", "c", D(2019, 1, 1))], "project string, version string, date date")
    assert rows(releases.assign_release(commits, tags), "sha", "version") == [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)]


def test_ancestry_of_a_range(spark):
    # 1 <- 2 <- 3 <- 5 with a side branch 2 <- 4 <- 5; tags: a at 3, b at 5
    edges = spark.createDataFrame([("p", 1, None), ("p", 2, 1), ("p", 3, 2), ("p", 4, 2), ("p", 5, 3), ("p", 5, 4)], "project string, sha int, parent int")
    tags = spark.createDataFrame([("p", "a", 3, None), ("p", "b", 5, 3)], "project string, version string, sha int, previous_sha int")
    got = rows(ancestry.commits_of_ranges(tags, edges), "version", "sha")
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5)]


def test_tag_pairs_and_lags(spark):
    tags = spark.createDataFrame([("p", "b", D(2020, 2, 1)), ("p", "a", D(2020, 1, 1)), ("q", "x", D(2020, 1, 1))], "project string, version string, date date")
    assert rows(releases.tag_pairs(tags), "project", "from_version", "to_version") == [("p", "a", "b")]
    dated = calendar.previous_date(tags, ["project"], ["date", "version"])
    assert rows(dated, "version", "date_p") == [("a", D(2020, 1, 1)), ("b", D(2020, 1, 1)), ("x", D(2020, 1, 1))]


def test_or_join_finds_each_pull_request_once(spark):
    tagged = spark.createDataFrame([(1, 10, "p", "v", "BUG"), (1, 11, "p", "v", "BUG")], "project_id int, commit_id int, project string, version string, task string")
    prs = spark.createDataFrame(
        [(100, 1, 1, 10, 1, 11), (101, 2, 2, 10, 1, 11), (102, 3, 1, 99, 1, 98), (103, 4, 1, 11, None, None)],
        "id int, pullreq_id int, base_repo_id int, base_commit_id int, head_repo_id int, head_commit_id int",
    )
    assert rows(reviews.pr_commit_match(tagged, prs), "pr_id") == [(100,), (101,), (103,)]


def test_pull_request_roll_up(spark):
    prs = spark.createDataFrame([("p", "v", "BUG", 1), ("p", "v", "BUG", 2)], "project string, version string, task string, pr_id int")
    commits = spark.createDataFrame(
        [("p", "v", "BUG", 10, 7, 1, 5), ("p", "v", "BUG", 11, 7, 1, 5), ("p", "v", "BUG", 12, None, 2, 6), ("p", "w", "BUG", 13, 8, 9, 9)],
        "project string, version string, task string, commit_id int, committer_id int, module int, line int",
    )
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 11), (2, 13)], "pull_request_id int, commit_id int")
    talk = reviews.comment_rollup(spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 6, 1)], "comment_id int, user_id int, pull_request_id int"))
    names = ("n_t", "t_commits", "module", "line", "contributions", "contributors", "comments", "commenters")
    assert rows(reviews.pr_rollup(prs, commits, links, talk), *names) == [(2, 4, 5, 21, 3, 2, 3, 2)]
    assert rows(reviews.pr_rollup(prs, commits, links, talk, every_commit=True), *names) == [(2, 4, 8, 32, 4, 2, 3, 2)]


def test_business_days(spark):
    span = spark.createDataFrame([(D(2019, 12, 30), D(2020, 1, 8))], "a date, b date")
    days = calendar.business_calendar(span, "a", "b")
    opened = [r["day"].day for r in days.where("open").orderBy("day").collect()]
    assert opened == [30, 31, 2, 3, 6, 7, 8]
    hours = calendar.business_hours(span.union(spark.createDataFrame([(D(2020, 1, 3), D(2020, 1, 3))], span.schema)), days, "a", "b")
    assert rows(hours, "hours") == [(0,), (54,)]
    own = calendar.business_calendar(span, "a", "b", spark.createDataFrame([(D(2020, 1, 2),)], "day date"))
    assert [r["day"].day for r in own.where("open").orderBy("day").collect()] == [30, 31, 1, 3, 6, 7, 8]


def test_costs(spark):
    df = spark.createDataFrame(
        [("p", D(2020, 1, 6), 1, "a", 10, 2), ("p", D(2020, 1, 8), 2, "b", 30, 0), ("p", D(2020, 1, 8), 3, "c", 0, 1)],
        "project string, date date, t_line int, version string, module int, t int",
    )
    days = calendar.business_calendar(df, "date", "date")
    out = costs.release_costs(df, days, ["project"], ["date", "t_line", "version"], "module", "t", 100.0)
    # average effort 40/3 over average people 4/3 is 10
    assert rows(out, "version", "hours_diff", "avg_contribs", "contrib_diff", "billed_hours", "cost") == [
        ("a", 0, 1.0, 1.0, 0.0, 0.0), ("b", 18, 1.0, 0.0, 18.0, 1800.0), ("c", 0, 0.0, 1.0, 0.0, 0.0),
    ]


def test_wide_export_keeps_empty_releases(spark):
    versions = spark.createDataFrame([("p", "a", D(2020, 1, 1), 5, 50), ("p", "b", D(2020, 1, 1), 5, 50)], "project string, version string, date date, t_module long, t_line long")
    facts = spark.createDataFrame([("p", "a", "BUG", 1, 1, 10)], "project string, version string, task string, committer_id int, module int, line int")
    table = spark.createDataFrame([("p", 1, "EC")], "project_id string, committer_id int, role string")
    out = export.wide_export(versions, roles.role_rollup_wide(facts, table))
    assert out.count() == 18
    assert rows(out.where("nt_ec is not null"), "version", "task", "nt_ec", "nt_cc", "t_ec") == [("a", "BUG", 1, None, 1)]
    order = [(r["version"], r["task"]) for r in out.orderBy(*export.export_order()).limit(2).collect()]
    assert order == [("b", "BUG"), ("a", "BUG")]


def test_year_tail(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "date": [D(y, 5, 1) for y in range(2010, 2020)], "x": range(10)}))
    out = releases.yearly_totals(df.withColumn("date", F.to_date("date")), ["k"], ["x"], years=3)
    assert rows(out, "year", "x") == [(2016, 6), (2017, 7), (2018, 8), (2019, 9)]
