"""The wide release dataset: one row per release and task with the effort of all three roles side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ratio, rnd
from effortloom.operators.classify import TASKS
from effortloom.operators.roles import CORE, EXTERNAL, UNKNOWN

# Measure names of the export.
MEASURES = ["nt", "no", "module", "line", "t"]
ROLES = [CORE, EXTERNAL, UNKNOWN]
ROLE_COLUMNS = [f"{m}_{r.lower()}" for r in ROLES for m in MEASURES]


def wide_export(releases: DataFrame, rollup: DataFrame, tasks: Sequence[str] = TASKS) -> DataFrame:
    """Every release times every task class, with NULL measures where a role made no such commit.

    ``rollup`` already has the roles as columns, so the releases take part in a single left join instead of three.
    """
    grid = releases.select("project", "version", "date", "t_module", "t_line").withColumn(
        "task", F.explode(F.array(*[F.lit(t) for t in tasks]))
    )
    return grid.join(rollup, ["project", "version", "task"], "left").select(
        "project", "version", "date", "task", "t_module", "t_line", *ROLE_COLUMNS
    )


def export_order(task: str = "task") -> list:
    """Sort keys of the written export: missing tasks last, later version names first on ties."""
    return [
        F.col("project"),
        F.col("date"),
        F.col("t_line"),
        F.coalesce(F.col(task), F.lit("Z")),
        F.col("version").desc(),
    ]


def combine_roles(df: DataFrame) -> DataFrame:
    """Totals over the roles; missing in one role means missing in total. Contributors carry a constant of two."""

    def total(measure):
        return sum((F.col(f"{measure}_{r.lower()}") for r in ROLES[1:]), F.col(f"{measure}_{ROLES[0].lower()}"))

    return df.withColumns(
        {
            "nt": total("nt"),
            "no": total("no"),
            "line": total("line"),
            "module": total("module"),
            "t_contributors": total("t") + 2,
        }
    )


def effort_shares(df: DataFrame) -> DataFrame:
    """Core and external share of lines and files, NULL when neither changed anything."""
    added = {}
    for unit in ("line", "module"):
        both = F.col(f"{unit}_cc") + F.col(f"{unit}_ec")
        added[f"{unit}_cc_p"] = rnd(ratio(f"{unit}_cc", both), 2)
        added[f"{unit}_ec_p"] = rnd(ratio(f"{unit}_ec", both), 2)
    return df.withColumns(added)


def long_targets(df: DataFrame, keys: Sequence[str] = ("project", "task")) -> DataFrame:
    """The six fitted targets as rows: model name, target ``y`` and the predictors of its role.

    One pass over the wide rows; the model name becomes a grouping key for every later fit.
    """
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{unit.capitalize()}_{r}").alias("model"),
                    F.col(f"{unit}_{r.lower()}").cast("double").alias("y"),
                    F.col(f"nt_{r.lower()}").cast("double").alias("nt"),
                    F.col(f"no_{r.lower()}").cast("double").alias("no"),
                    F.col(f"t_{r.lower()}").cast("double").alias("t"),
                )
                for unit in ("line", "module")
                for r in ROLES
            ]
        )
    )
    keep = [c for c in ("version", "date", "t_module", "t_line", "t_line_p") if c in df.columns]
    return df.select(*keys, *keep, rows.alias("_r")).select(*keys, *keep, "_r.*")
