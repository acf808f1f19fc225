"""Text exported from repositories: tags, changelogs, commit statistics, commit messages and repository lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


TAG_SCHEMA = "project string, version string, date string"
TAG_OPTIONS = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


def _dated(tags: DataFrame) -> DataFrame:
    return tags.withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))


def read_tags(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """``key,version,date`` rows with a header."""
    tags = spark.read.schema(TAG_SCHEMA).options(header=True, **TAG_OPTIONS).csv(path)
    if key:
        tags = tags.withColumn("project", F.lit(key))
    return _dated(tags)


def parse_tags(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same from lines of text without a header."""
    return _dated(lines.select(F.from_csv(line, TAG_SCHEMA, TAG_OPTIONS).alias("_t")).select("_t.*"))


def parse_changelog(lines: DataFrame, line: str = "line") -> DataFrame:
    """Split ``<sha> - <subject> (<author>)``; the author is the last bracket of the line."""
    pattern = r"^(\S+) - (.*) \(([^()]*)\)$"
    return lines.withColumns(
        {
            "sha": F.regexp_extract(line, pattern, 1),
            "subject": F.regexp_extract(line, pattern, 2),
            "author": F.regexp_extract(line, pattern, 3),
        }
    )


def read_changelogs(spark: SparkSession, path: str) -> DataFrame:
    """Changelog lines with the version taken from ``<version>_changelog.txt``."""
    return _text(spark, path).select(
        F.regexp_extract(F.url_decode("file"), r"/([^/]+)_changelog\.txt$", 1).alias("version"),
        F.col("value").alias("line"),
    )


def parse_commit_stats(texts: DataFrame, text: str = "value") -> DataFrame:
    """Commit, files and lines from ``--stat`` output, any number of commits in a row of text.

    A commit starts with ``@<sha>`` at the start of a line; per-file lines (with a bar) are dropped; lines are
    insertions plus deletions. The text before the first commit is no commit. A row may be the rest of a file after a
    cut at a line start with ``@``, so the first mark may lack its ``@``; its line holds the hash alone.
    """
    others = [c for c in texts.columns if c != text]
    body = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.contains("|")), "\n")
    parts = texts.select(*others, F.explode(F.split(body, r"(?:^|\n)@")).alias("_commit"))

    def number(pattern):
        return F.coalesce(F.regexp_extract("_commit", pattern, 1).try_cast("bigint"), F.lit(0))

    return parts.select(
        *others,
        F.regexp_extract("_commit", r"^@?([0-9a-f]+)[ \t\r]*(?:\n|$)", 1).alias("sha"),
        number(r"(\d+) files? changed").alias("e_module"),
        (number(r"(\d+) insertions?\(\+\)") + number(r"(\d+) deletions?\(-\)")).alias("e_line"),
    ).where("sha <> ''")


def read_commit_stats(spark: SparkSession, path: str) -> DataFrame:
    """One file per release range; the file name is the version. Each commit is a record of its own, because records end
    where a line starts with ``@``, so a file of any size is cut into many tasks."""
    texts = spark.read.text(path, lineSep="\n@").select("value", F.col("_metadata.file_path").alias("file"))
    return parse_commit_stats(texts.select(F.regexp_extract("file", r"/([^/]+)\.[^./]+$", 1).alias("version"), "value"))


def parse_commit_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """``<sha> <subject>``: the first word and the rest."""
    pieces = F.split(F.col(line), " ", 2)
    return lines.withColumns({"sha": pieces[0], "message": F.try_element_at(pieces, F.lit(2))})


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return parse_repos(_text(spark, path), "value")


def parse_repos(lines: DataFrame, line: str = "line") -> DataFrame:
    """Owner and name from lines such as ``https://github.com/owner/name``."""
    pattern = r"^https?://[^/]+/([^/]+)/([^/\s]+)"
    lines = lines.select(F.trim(line).alias("url"))
    return lines.select(
        "url", F.regexp_extract("url", pattern, 1).alias("owner"), F.regexp_extract("url", pattern, 2).alias("name")
    ).where("name <> ''")
