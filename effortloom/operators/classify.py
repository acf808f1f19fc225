"""Task classes of commits from their messages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ColumnLike, as_col
from effortloom.operators.ordered import attach
from effortloom.session import pin

Rules = Sequence[tuple[str, Sequence[str]]]

# The task classes in matching order and the words whose presence assigns them.
TASK_RULES: Rules = [
    ("BUG", ["bug", "defect", "fix"]),
    ("DOCS", ["docs", "documentation"]),
    ("REFACTOR", ["refactor", "refactoring"]),
    ("TESTING", ["testing", "test", "qa"]),
    ("FEATURE", ["feat", "feature", "enhancement"]),
    ("UPGRADE", ["install", "upgrade"]),
    ("RELEASE", ["release"]),
    ("SUPPORT", ["support", "question", "faq"]),
]
OTHER = "OTHER"
TASKS = [task for task, _ in TASK_RULES] + [OTHER]

# The words that make a changelog line corrective, matched in the case given.
CORRECTIVE_WORDS = ["fix", "bug", "defect"]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _rank(text: Column, rules: Rules) -> Column:
    found = reduce(
        lambda chain, rule: chain.when(contains_any(text, rule[1][1]), F.lit(rule[0])),
        enumerate(rules[1:], 1),
        F.when(contains_any(text, rules[0][1]), F.lit(0)),
    )
    return found.otherwise(F.lit(len(rules)))


def with_task_rank(df: DataFrame, message: str, name: str, rules: Rules = TASK_RULES) -> DataFrame:
    """Add the index of the first rule with a word in the lower-cased message, ``len(rules)`` when there is none.

    The lower-cased text is a column of its own, so that a long text is converted once and not once per word.
    """
    return df.withColumn("_text", F.lower(message)).withColumn(name, _rank(F.col("_text"), rules)).drop("_text")


def task_name(rank: ColumnLike, rules: Rules = TASK_RULES) -> Column:
    names = F.array(*[F.lit(task) for task, _ in rules], F.lit(OTHER))
    return F.element_at(names, as_col(rank) + 1)


def with_task(df: DataFrame, message: str, name: str = "task", rules: Rules = TASK_RULES) -> DataFrame:
    """Add the class of each message taken alone."""
    return with_task_rank(df, message, "_rank", rules).withColumn(name, task_name("_rank", rules)).drop("_rank")


def classify_tasks(
    messages: DataFrame,
    key: str = "key",
    sha: str = "sha",
    message: str = "message",
    rules: Rules = TASK_RULES,
    keep: Sequence[str] = ("version",),
) -> DataFrame:
    """Exclusive classes: within a project a SHA belongs to the earliest class any of its messages matches, in every
    version, and its messages of later classes are dropped.

    The texts are read once: what is left of them, a rank per message, is pinned and then read twice. The earliest
    class is a ``min`` with map-side partial results and is joined back, so a SHA copied into very many versions never
    gathers in one task.
    """
    ranked = pin(with_task_rank(messages, message, "_rank", rules).select(key, sha, *keep, "_rank"))
    first = ranked.groupBy(key, sha).agg(F.min("_rank").alias("_first"))
    kept = attach(ranked, first, [key, sha]).where(F.col("_rank") == F.col("_first"))
    return kept.select(key, *keep, sha, task_name("_rank", rules).alias("task"))


def corrective_counts(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Corrective lines NT and other lines NO per key. Case matters and the author name is part of the line."""
    hit = contains_any(F.col(line), CORRECTIVE_WORDS)
    return lines.groupBy(*keys).agg(F.count_if(hit).alias("nt"), F.count_if(~hit).alias("no"))


def task_counts(tasks: DataFrame, keys: Sequence[str], names: Sequence[str] = TASKS) -> DataFrame:
    """One column per task class with its number of commits."""
    return tasks.groupBy(*keys).agg(
        *[F.count_if(F.col("task") == F.lit(t)).alias(t.lower()) for t in names]
    )
