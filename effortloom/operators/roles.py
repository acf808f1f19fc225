"""Who made a commit: core, external or unknown contributor, and the effort each role put into a release."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORE, EXTERNAL, UNKNOWN = "CC", "EC", "UC"


def all_contributors(commits: DataFrame, users: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Real (not fake) committers per project, of all projects or those listed. Commits collapse to distinct pairs
    before they meet the users."""
    pairs = commits.select("project_id", "committer_id").where(F.col("committer_id").isNotNull()).distinct()
    real = users.where(~F.col("fake")).select(F.col("id").alias("committer_id"), F.col("login").alias("committer_login"))
    named = _of_projects(pairs, projects).join(real, "committer_id")
    return named.select("project_id", "committer_id", "committer_login")


def core_contributors(
    pull_requests: DataFrame,
    history: DataFrame,
    users: DataFrame,
    projects: DataFrame | None = None,
    action: str = "merged",
) -> DataFrame:
    """Users who merged a pull request of the project."""
    acts = history.where(F.col("action") == action).select("pull_request_id", "actor_id").distinct()
    base = pull_requests.select(F.col("id").alias("pull_request_id"), F.col("base_repo_id").alias("project_id"))
    names = users.select(F.col("id").alias("committer_id"), F.col("login").alias("committer_login"))
    pairs = acts.join(base, "pull_request_id").select("project_id", F.col("actor_id").alias("committer_id")).distinct()
    return _of_projects(pairs, projects).join(names, "committer_id").select("project_id", "committer_id", "committer_login")


def _of_projects(pairs: DataFrame, projects: DataFrame | None) -> DataFrame:
    if projects is None:
        return pairs
    return pairs.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")


def external_contributors(everyone: DataFrame, core: DataFrame) -> DataFrame:
    """Contributors of a project who are not core in that project."""
    return everyone.join(core.select("project_id", "committer_id"), ["project_id", "committer_id"], "left_anti")


def unknown_commits(commits: DataFrame, known: DataFrame, key: str = "project", sha: str = "sha") -> DataFrame:
    """Commits without a recorded committer, either because no record exists or because its committer is empty."""
    recorded = known.where(F.col("committer_id").isNotNull()).select(key, sha).distinct()
    return commits.join(recorded, [key, sha], "left_anti")


def role_table(core: DataFrame, others: DataFrame) -> DataFrame:
    """Project and committer with the role. ``others`` may be the external contributors or simply everyone: whoever
    is core in a project counts as core there, so the roll-up does not need the difference of the two."""
    return core.select("project_id", "committer_id", F.lit(CORE).alias("role")).unionByName(
        others.select("project_id", "committer_id", F.lit(EXTERNAL).alias("role"))
    )


def role_rollup_wide(facts: DataFrame, roles: DataFrame, *, fanout: bool = False) -> DataFrame:
    """Effort per project, version and task with the measures of all three roles side by side, in one pass.

    ``facts`` holds one row per classified commit: project, version, task, committer_id, module, line. Commits are
    summed per committer before the role join, so a busy committer is a few rows by then and the commits without a
    committer are one row per task. ``no`` counts the commits of other tasks in the version (for unknown commits: the
    unknown ones); unknown contributors number -1. ``fanout=True`` matches the committer in any project, once per
    project that gives the role, which is how effort gets counted several times when roles are not scoped.
    """
    group = ["project", "version", "task"]
    per_person = facts.groupBy(*group, "committer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("module").alias("module"), F.sum("line").alias("line")
    )
    is_core = F.bool_or(F.col("role") == CORE)
    scoped = roles.groupBy(F.col("project_id").alias("project"), "committer_id").agg(
        is_core.cast("bigint").alias("is_cc"), (~is_core).cast("bigint").alias("is_ec")
    )
    if fanout:
        times = scoped.groupBy("committer_id").agg(F.sum("is_cc").alias("is_cc"), F.sum("is_ec").alias("is_ec"))
        matched = per_person.join(times, "committer_id", "left")
    else:
        matched = per_person.join(scoped, ["project", "committer_id"], "left")
    matched = matched.withColumn("is_uc", F.col("committer_id").isNull().cast("bigint"))

    def side(role, source):
        weight = F.col(f"is_{role}")
        return F.sum(F.when(weight > 0, F.col(source) * weight))

    effort = matched.groupBy(*group).agg(
        F.sum("n").alias("_all"),
        *[side(x, c).alias(f"{name}_{x}") for x in ("cc", "ec", "uc") for name, c in (("nt", "n"), ("module", "module"), ("line", "line"))],
        *[F.count_if(F.col(f"is_{x}") > 0).alias(f"t_{x}") for x in ("cc", "ec")],
    )
    version = Window.partitionBy("project", "version")  # one row per task class
    unknown = F.coalesce("nt_uc", F.lit(0))
    others = {"uc": F.sum(unknown).over(version) - unknown}
    others["cc"] = others["ec"] = F.sum("_all").over(version) - F.col("_all")
    people = {"cc": F.col("t_cc"), "ec": F.col("t_ec"), "uc": F.lit(-1).cast("bigint")}
    columns = []
    for x in ("cc", "ec", "uc"):
        seen = F.col(f"nt_{x}").isNotNull()
        columns += [
            F.col(f"nt_{x}"),
            F.when(seen, others[x]).alias(f"no_{x}"),
            F.col(f"module_{x}"),
            F.col(f"line_{x}"),
            F.when(seen, people[x]).alias(f"t_{x}"),
        ]
    return effort.select(*group, *columns)


def role_rollup(facts: DataFrame, roles: DataFrame, *, fanout: bool = False) -> DataFrame:
    """The wide roll-up as one row per project, version, task and role that made a commit."""
    wide = role_rollup_wide(facts, roles, fanout=fanout)
    sides = F.array(
        *[
            F.struct(
                F.lit(x).alias("role"),
                F.col(f"nt_{x.lower()}").alias("n_t"),
                F.col(f"no_{x.lower()}").alias("n_o"),
                F.col(f"module_{x.lower()}").alias("module"),
                F.col(f"line_{x.lower()}").alias("line"),
                F.col(f"t_{x.lower()}").alias("contributors"),
            )
            for x in (CORE, EXTERNAL, UNKNOWN)
        ]
    )
    rows = wide.select("project", "version", "task", F.explode(sides).alias("_s")).where(F.col("_s.n_t").isNotNull())
    return rows.select("project", "version", "task", "_s.*")


def other_task_count(tasks: DataFrame) -> DataFrame:
    """Per project, version and task: its commits and the commits of all other tasks of the version."""
    counts = tasks.groupBy("project", "version", "task").agg(F.count(F.lit(1)).alias("n_t"))
    version = Window.partitionBy("project", "version")  # one row per task class
    return counts.withColumn("n_o", F.sum("n_t").over(version) - F.col("n_t"))
