"""Text sources and sinks on temporary folders, with small made-up files."""

import uuid

from pyspark.sql import functions as F

from effortloom.operators import classify, correlate, esp, export, releases
from effortloom.sources import datasets, gitlogs, sinks

STATS = """@a1f
 src/one.py | 3 ++-
 docs/a@b.txt | 1 +
 2 files changed, 3 insertions(+), 1 deletion(-)

@b2
 x | 1 -
 1 file changed, 7 deletions(-)
@c3
"""


def test_commit_statistics(spark, tmp_path):
    (tmp_path / "v1.0.txt").write_text(STATS)
    got = gitlogs.read_commit_stats(spark, str(tmp_path)).orderBy("sha").collect()
    assert [tuple(r) for r in got] == [("v1.0", "a1f", 2, 4), ("v1.0", "b2", 1, 7), ("v1.0", "c3", 0, 0)]


def test_messages_tags_and_repositories(spark, tmp_path):
    lines = spark.createDataFrame([("ab12 Fix-the-thing",), ("cd34",)], "line string")
    assert [(r["sha"], r["message"]) for r in gitlogs.parse_commit_messages(lines).collect()] == [("ab12", "Fix-the-thing"), ("cd34", None)]
    log = gitlogs.parse_changelog(spark.createDataFrame([("ab1 - Fix (again) (A. Body)",)], "line string")).first()
    assert (log["sha"], log["subject"], log["author"]) == ("ab1", "Fix (again)", "A. Body")
    (tmp_path / "tags.csv").write_text("Key,Version,Date\no/n, v1, 2020-01-02\no/n, v2,\n")
    assert [(r["version"], str(r["date"])) for r in gitlogs.read_tags(spark, str(tmp_path / "tags.csv")).collect()] == [("v1", "2020-01-02"), ("v2", "None")]
    (tmp_path / "repos.txt").write_text("https://github.com/owner/name\n\n")
    assert [tuple(r)[1:] for r in gitlogs.read_repos(spark, str(tmp_path / "repos.txt")).collect()] == [("owner", "name")]


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id") % 3).alias("project"), F.lit("BUG").alias("task"))
    out = str(tmp_path / "out")
    sinks.write_partitioned(df, out, ["project", "task"], "parquet", salt=4)
    assert spark.read.parquet(out).where("project = 'p1'").count() == 13
    sinks.append_results(df, str(tmp_path / "res"))
    sinks.append_results(df, str(tmp_path / "res"))
    assert spark.read.option("header", True).csv(str(tmp_path / "res")).count() == 80
    sinks.write_report(df.select("project", F.col("id").cast("string").alias("value")), str(tmp_path / "rep"), ["project"])
    assert spark.read.text(str(tmp_path / "rep")).count() == 40


def test_insert_creates_then_appends(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    try:
        sinks.insert_into(df, name)
        sinks.insert_into(df.select("y", "x"), name)
        assert [tuple(r) for r in spark.table(name).collect()] == [(1, "a"), (1, "a")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_datasets(spark, tmp_path):
    """Two projects and two tasks; the file name and the column agree on the task."""
    head = ["", "Project", "Version", "Date", "Task", "T_Module", "T_Line", *export.ROLE_COLUMNS]
    for name in ("alpha", "beta"):
        (tmp_path / name).mkdir()
        for task in ("Corrective", "Adaptive"):
            lines = [",".join(head)]
            for i in range(6):
                values = [str((i + 1) * (k + 2) % 7) + ".0" for k in range(len(export.ROLE_COLUMNS))]
                lines.append(",".join([str(i), f"owner/{name}", f"v1.{i}", f"2020-0{i + 1}-15", task, str(10 + i), str(100 * i), *values]))
            (tmp_path / name / f"{name}_dataset_{task}.csv").write_text("\n".join(lines) + "\n")
    df = datasets.read_datasets(spark, str(tmp_path))
    assert df.count() == 24 and df.select("repo", "file_task").distinct().count() == 4
    assert df.where("date is null or task <> file_task or project <> concat('owner/', repo)").count() == 0
    lagged = correlate.lagged_inputs(df, ["repo", "task"], bounded=True)
    assert correlate.pearson_pairs(lagged, ["repo", "task"], correlate.effort_pairs()).count() == 4
    one = datasets.read_dataset(spark, str(tmp_path / "beta" / "beta_dataset_Adaptive.csv"))
    assert one.columns[:4] == ["project", "version", "date", "task"] and one.agg(F.sum("t_line")).first()[0] == 1500


def test_changelogs(spark, tmp_path):
    (tmp_path / "v1.0_changelog.txt").write_text("a1 - net: fix leak (A. One)\nb2 - add driver (B. Two)\nc3 - debugging aid (A. One)\n")
    (tmp_path / "v1.1-rc1_changelog.txt").write_text("d4 - Fix case (C. Three)\ne5 - clean up (B. Fixture)\nf6 - handle defects (D. Four)\n")
    counts = classify.corrective_counts(gitlogs.read_changelogs(spark, f"{tmp_path}/*_changelog.txt"), ["version"])
    assert {r["version"]: (r["nt"], r["no"]) for r in counts.collect()} == {"v1.0": (2, 1), "v1.1-rc1": (1, 2)}


def test_quarters(spark):
    """Quarterly sums against sums by hand."""
    import datetime

    days = [datetime.date(2019, 1, 1) + datetime.timedelta(days=23 * i) for i in range(40)]
    df = spark.createDataFrame([(d, i, 2 * i) for i, d in enumerate(days)], "date date, nc long, e_line long")
    want = {}
    for i, d in enumerate(days):
        old = want.get((d.year, (d.month + 2) // 3), (0, 0))
        want[d.year, (d.month + 2) // 3] = (old[0] + i, old[1] + 2 * i)
    got = releases.quarterly_rollup(df, ["nc", "e_line"]).collect()
    assert {(r["year"], r["quarter"]): (r["nc"], r["e_line"]) for r in got} == want


def test_savings(spark):
    """Measures worked out by hand: gain, rate, and the yearly rate of three years."""
    rows = [("a", 100.0, 240.0), ("b", 0.0, 5.0), ("c", 80.0, 10.0), ("d", 50.0, 50.0)]
    df = spark.createDataFrame(rows, "project string, effort_incurred double, effort_saved double")
    got = {r["project"]: (r["net_saved"], r["esp"], r["annualized_esp"]) for r in esp.with_esp(df).collect()}
    assert got == {"a": (140.0, 1.4, 0.339), "b": (5.0, 5.0, 0.817), "c": (-70.0, -0.875, -0.5), "d": (0.0, 0.0, 0.0)}
    first = esp.with_esp(df).select("project", F.col("annualized_esp").alias("rate"))
    second = first.withColumn("rate", F.when(F.col("project") == "a", 3.0).otherwise(F.col("rate")))
    agreed = esp.esp_agreement(esp.esp_join(first, second), "rate", "rate_line")
    assert {r["project"]: r["agrees"] for r in agreed.collect()} == {"a": False, "b": True, "c": True, "d": True}
