"""Correlations per key and the collinearity of predictors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ratio, rnd
from effortloom.operators.ordered import attach, mid_ranks, ordered

Pair = tuple[str, str]


def effort_pairs() -> list[Pair]:
    """Effort against the counts of its own role and against the totals of the previous release."""
    pairs = []
    for unit in ("module", "line"):
        for role in ("cc", "ec"):
            pairs += [(f"{unit}_{role}", f"{m}_{role}") for m in ("nt", "no", "t")]
            pairs += [(f"{unit}_{role}", total) for total in ("t_line", "t_module")]
    return pairs


def lagged_inputs(df: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Totals replaced by those of the previous release, then 0 for every missing number."""
    order = ["date", "t_line", "version"]
    lagged = ordered(df, keys, order, previous={"_m": "t_module", "_l": "t_line"}, bounded=bounded)
    return lagged.withColumns({"t_module": F.col("_m"), "t_line": F.col("_l")}).drop("_m", "_l").fillna(0)


def safe_corr(a: str, b: str):
    """Pearson r; NULL when either column is constant. Constancy is tested on the values, not on a variance that
    rounding may leave above zero."""
    varies = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    return F.when(varies, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def pearson_pairs(df: DataFrame, keys: Sequence[str], pairs: Sequence[Pair]) -> DataFrame:
    """All pairs of all keys in one aggregation."""
    return df.groupBy(*keys).agg(*[safe_corr(a, b).alias(f"{a}__{b}") for a, b in pairs])


def spearman_pairs(
    df: DataFrame, keys: Sequence[str], identity: Sequence[str], pairs: Sequence[Pair], **kwargs
) -> DataFrame:
    """Rank correlation: all columns are ranked together in long form, brought back to rows, and correlated."""
    keys, identity = list(keys), list(identity)
    cols = sorted({c for pair in pairs for c in pair})
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("val")) for c in cols]))
    long = df.select(*keys, *identity, cells.alias("_c")).select(*keys, *identity, "_c.*")
    ranks = mid_ranks(long, [*keys, "col"], "val", **kwargs).select(*keys, "col", "val", "rank")
    ranked = attach(long, ranks, [*keys, "col", "val"])
    wide = ranked.groupBy(*keys, *identity).agg(*[F.max(F.when(F.col("col") == c, F.col("rank"))).alias(c) for c in cols])
    return pearson_pairs(wide, keys, pairs)


def corr_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The upper triangle and the diagonal as rows (a, b, r)."""
    cols = list(cols)
    pairs = [(c, c) for c in cols] + list(combinations(cols, 2))
    flat = pearson_pairs(df, keys, pairs)
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    )
    return flat.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def correlation_report(
    df: DataFrame, keys: Sequence[str], pairs: Sequence[Pair], title: str, digits: int = 4
) -> DataFrame:
    """One text block per key: a heading and a line per pair, plain decimals with ``digits`` places."""
    heading = F.concat(F.concat_ws(":", *keys), F.lit(f" - {title} correlation:"))
    shown = {p: F.format_string(f"%.{digits}f", rnd(f"{p[0]}__{p[1]}", digits)) for p in pairs}
    known = {p: F.when(F.col(f"{p[0]}__{p[1]}").isNotNull(), shown[p]).otherwise(F.lit("nan")) for p in pairs}
    lines = [F.concat(F.lit(f"E_{a} => {b}: "), known[a, b]) for a, b in pairs]
    return df.select(*keys, F.concat_ws("\n", heading, *lines).alias("value"))


def vif(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Variance inflation of two or three predictors without intercept, from uncentred cross-products."""
    cols = list(cols)
    if len(cols) not in (2, 3):
        raise ValueError("two or three predictors")
    s = {
        (i, j): f"_s{i}{j}"
        for i in range(len(cols))
        for j in range(i, len(cols))
    }
    sums = df.groupBy(*keys).agg(
        *[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(n) for (i, j), n in s.items()]
    )

    def m(i, j):
        return F.col(s[min(i, j), max(i, j)])

    if len(cols) == 2:
        det = m(0, 0) * m(1, 1) - m(0, 1) * m(0, 1)
        values = [ratio(m(0, 0) * m(1, 1), det)] * 2
    else:
        det = (
            m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(1, 2))
            - m(0, 1) * (m(0, 1) * m(2, 2) - m(1, 2) * m(0, 2))
            + m(0, 2) * (m(0, 1) * m(1, 2) - m(1, 1) * m(0, 2))
        )
        values = []
        for i in range(3):
            j, k = [x for x in range(3) if x != i]
            minor = m(j, j) * m(k, k) - m(j, k) * m(j, k)
            values.append(ratio(m(i, i) * minor, det))
    return sums.select(*keys, *[v.alias(f"vif_{c}") for c, v in zip(cols, values)])
