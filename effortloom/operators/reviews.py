"""Pull requests: which releases and tasks they touch, and the commits and comments they gather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pr_commit_match(tagged: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Pull requests whose base or head commit is one of the tagged commits.

    ``tagged`` (project_id, commit_id, project, version, task). Either-or becomes one equality join: a pull request is
    listed under each of its ends first. A join on the disjunction itself would compare every pair.
    """
    ends = F.array(
        *[
            F.struct(F.col(f"{end}_repo_id").alias("project_id"), F.col(f"{end}_commit_id").alias("commit_id"))
            for end in ("base", "head")
        ]
    )
    listed = pull_requests.select(F.col("id").alias("pr_id"), "pullreq_id", F.explode(F.array_distinct(ends)).alias("_end"))
    listed = listed.select("pr_id", "pullreq_id", "_end.*").where(F.col("commit_id").isNotNull())
    matched = tagged.join(listed, ["project_id", "commit_id"])
    return matched.select("project_id", "project", "version", "task", "pr_id", "pullreq_id").distinct()


def with_action(prs: DataFrame, history: DataFrame, action: str = "closed") -> DataFrame:
    acts = history.where(F.col("action") == action).select(F.col("pull_request_id").alias("pr_id")).distinct()
    return prs.join(acts, "pr_id", "left_semi")


def comment_union(pr_comments: DataFrame, issue_comments: DataFrame, issues: DataFrame) -> DataFrame:
    """Review comments and the comments of the issue that belongs to the pull request, duplicates kept."""
    linked = issue_comments.join(
        issues.select(F.col("id").alias("issue_id"), "pull_request_id"), "issue_id"
    ).select("comment_id", "user_id", "pull_request_id")
    return pr_comments.select("comment_id", "user_id", "pull_request_id").unionByName(linked)


def comment_rollup(comments: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """Comments and distinct commenters per pull request, optionally of the given pull requests only.

    Comments collapse per pull request and user first; a pull request with very many comments is then only as large
    as its number of commenters.
    """
    if prs is not None:
        comments = comments.join(prs.select(F.col("pr_id").alias("pull_request_id")).distinct(), "pull_request_id", "left_semi")
    people = comments.groupBy("pull_request_id", "user_id").agg(F.count("comment_id").alias("n"))
    return people.groupBy("pull_request_id").agg(
        F.sum("n").alias("comments"), F.count("user_id").alias("commenters")
    )


def pr_rollup(
    prs: DataFrame,
    commits: DataFrame,
    pr_commits: DataFrame,
    comments: DataFrame,
    *,
    every_commit: bool = False,
) -> DataFrame:
    """Two levels: commits, effort and people per pull request, then per release and task.

    ``prs`` (project, version, task, pr_id); ``commits`` (project, version, task, commit_id, committer_id, module,
    line); ``pr_commits`` (pull_request_id, commit_id); ``comments`` as from :func:`comment_rollup`. People are
    distinct per pull request and then summed. ``every_commit=True`` lets each pull request count all commits of its
    release and task, as an unmatched left join does.
    """
    links = pr_commits.select(F.col("pull_request_id").alias("pr_id"), "commit_id").distinct()
    if every_commit:
        group = ["project", "version", "task"]
        people = commits.groupBy(*group, "committer_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("module").alias("module"), F.sum("line").alias("line")
        )
        whole = people.groupBy(*group).agg(
            F.sum("module").alias("module"),
            F.sum("line").alias("line"),
            F.sum(F.when(F.col("committer_id").isNotNull(), F.col("n"))).alias("contributions"),
            F.count("committer_id").alias("contributors"),
        )
        own = (
            prs.join(links, "pr_id")
            .join(commits.select(*group, "commit_id"), [*group, "commit_id"])
            .groupBy(*group, "pr_id")
            .agg(F.count(F.lit(1)).alias("t_commits"))
        )
        per_pr = prs.join(whole, group).join(own, [*group, "pr_id"], "left").fillna({"t_commits": 0})
    else:
        group = ["project", "version", "task"]
        matched = prs.join(links, "pr_id").join(commits, [*group, "commit_id"])
        people = matched.groupBy(*group, "pr_id", "committer_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("module").alias("module"), F.sum("line").alias("line")
        )
        per_pr = people.groupBy(*group, "pr_id").agg(
            F.sum("n").alias("t_commits"),
            F.sum("module").alias("module"),
            F.sum("line").alias("line"),
            F.coalesce(F.sum(F.when(F.col("committer_id").isNotNull(), F.col("n"))), F.lit(0)).alias("contributions"),
            F.count("committer_id").alias("contributors"),
        )
    talk = comments.withColumnRenamed("pull_request_id", "pr_id")
    return (
        per_pr.join(talk, "pr_id", "left")
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n_t"),
            *[
                F.sum(c).alias(c)
                for c in (
                    "t_commits", "module", "line", "contributions", "contributors", "comments", "commenters",
                )
            ],
        )
    )
