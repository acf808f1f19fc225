"""Hypothesis tests per key. Rows are reduced to distinct values and their copies before they are ranked; the test
statistic and its p-value are expressions on one aggregated row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effortloom.functions.numbers import ratio
from effortloom.functions.special import binomial_cdf, chi2_sf, norm_cdf, norm_ppf, norm_sf, student_two_sided
from effortloom.operators.ordered import attach, counted, ordered


def _moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def t_test(df: DataFrame, value: str, mean: float, keys: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """One-sample t against ``mean``, two-sided."""
    stats = _moments(df, value, keys)
    statistic = ratio(F.col("mean") - mean, F.col("sd") / F.sqrt("n"))
    out = stats.select(*keys, "n", statistic.alias("statistic"))
    return out.withColumn("p", student_two_sided("statistic", F.col("n") - 1)) if p_value else out


def z_test(df: DataFrame, value: str, mean: float, keys: Sequence[str] = ()) -> DataFrame:
    """One-sample z with the sample deviation, alternative: smaller."""
    stats = _moments(df, value, keys)
    out = stats.select(*keys, "n", ratio(F.col("mean") - mean, F.col("sd") / F.sqrt("n")).alias("statistic"))
    return out.withColumn("p", norm_cdf("statistic"))


def _tie_term(n: str = "n") -> Column:
    t = F.col(n).cast("double")
    return F.sum(t * t * t - t)


def signed_rank(
    df: DataFrame, value: str, median: float, keys: Sequence[str] = (), bounded: bool = False, rows_per_task: int | None = None
) -> DataFrame:
    """Signed ranks of ``value - median``, alternative: less; zeros dropped, normal approximation with ties."""
    keys = list(keys)
    gaps = df.select(*keys, (F.col(value) - median).alias("_d")).where("_d <> 0")
    signed = gaps.groupBy(*keys, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).alias("copies"), F.count_if(F.col("_d") > 0).alias("plus"))
    signed, small = counted(signed, gaps, keys, bounded, rows_per_task)
    placed = ordered(
        signed, keys, ["_a"], running={"upto": "copies"}, totals={"size": "copies"}, bounded=small, rows_per_task=rows_per_task
    )
    rank = F.col("upto") - (F.col("copies") - 1) / 2
    stats = placed.groupBy(*keys).agg(
        F.max("size").alias("n"), F.sum(rank * F.col("plus")).alias("statistic"), _tie_term("copies").alias("ties")
    )
    n = F.col("n").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = ratio(F.col("statistic") - n * (n + 1) / 4, se)
    return stats.select(*keys, "n", "statistic", z.alias("z")).withColumn("p", norm_cdf("z"))


def _sample_ranks(df, value, sample, keys, samples, bounded=False, rows_per_task=None):
    """One row per key: its size and tie term, and for every sample its size and rank sum.

    ``samples`` maps column suffixes to sample values. Each distinct value keeps its copies per sample in columns, so
    the ranked values are summed up in place.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(sample) == F.lit(v)).alias(f"k_{t}") for t, v in samples.items()]
    )
    counts, small = counted(counts, known, keys, bounded, rows_per_task)
    placed = ordered(
        counts, keys, [value], running={"upto": "n"}, totals={"size": "n"}, bounded=small, rows_per_task=rows_per_task
    )
    rank = F.col("upto") - (F.col("n") - 1) / 2
    return placed.groupBy(*keys).agg(
        F.max("size").cast("double").alias("size"),
        _tie_term().alias("ties"),
        *[F.sum(f"k_{t}").cast("double").alias(f"n_{t}") for t in samples],
        *[F.sum(rank * F.col(f"k_{t}")).alias(f"r_{t}") for t in samples],
    )


def mann_whitney(df: DataFrame, value: str, sample: str, first, second, keys: Sequence[str] = (), **kwargs) -> DataFrame:
    """Two-sided rank test of two samples with tie and continuity correction; U belongs to ``first``."""
    keys = list(keys)
    both = df.where(F.col(sample).isin(first, second))
    sums = _sample_ranks(both, value, sample, keys, {"1": first, "2": second}, **kwargs)
    size, n1, n2 = F.col("size"), F.col("n_1"), F.col("n_2")
    u1 = F.col("r_1") - n1 * (n1 + 1) / 2
    spread = F.sqrt((1 - F.col("ties") / (size * size * size - size)) * n1 * n2 * (size + 1) / 12)
    z = ratio(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, spread)
    out = sums.select(*keys, n1.alias("n1"), n2.alias("n2"), u1.alias("statistic"), z.alias("z"))
    return out.withColumn("p", F.least(2 * norm_sf("z"), F.lit(1.0)))


def kruskal(df: DataFrame, value: str, sample: str, samples: Sequence, keys: Sequence[str] = (), **kwargs) -> DataFrame:
    """Rank test of the listed samples: H with tie correction and its chi-square tail."""
    keys, tags = list(keys), {str(i): v for i, v in enumerate(samples)}
    sums = _sample_ranks(df.where(F.col(sample).isin(*samples)), value, sample, keys, tags, **kwargs)
    size = F.col("size")
    squares = sum((F.coalesce(ratio(F.col(f"r_{t}") * F.col(f"r_{t}"), f"n_{t}"), F.lit(0.0)) for t in tags), F.lit(0.0))
    present = sum(((F.col(f"n_{t}") > 0).cast("bigint") for t in tags), F.lit(0).cast("bigint"))
    raw = 12 / (size * (size + 1)) * squares - 3 * (size + 1)
    h = ratio(raw, 1 - F.col("ties") / (size * size * size - size))
    out = sums.select(*keys, present.alias("samples"), size.cast("bigint").alias("n"), h.alias("statistic"))
    return out.withColumn("p", chi2_sf("statistic", len(tags) - 1))


def proportion_z(count: Column, nobs: Column, p0: float) -> tuple[Column, Column]:
    """z and lower tail for a share; the variance uses the observed share."""
    share = ratio(count, nobs)
    z = ratio(share - p0, F.sqrt(share * (1 - share) / nobs))
    return z, norm_cdf(z)


def binomial_test(count: Column, nobs: Column, p0: float) -> Column:
    """Exact lower tail."""
    return binomial_cdf(count, nobs, F.lit(p0))


def clt_check(count: Column, nobs: Column) -> tuple[Column, Column]:
    """Whether expected successes and failures both exceed five."""
    share = ratio(count, nobs)
    return nobs * share > 5, nobs * (1 - share) > 5


def shapiro(df: DataFrame, value: str, identity: Sequence[str], keys: Sequence[str] = (), **kwargs) -> DataFrame:
    """Normality statistic W and p-value by Royston's published approximation, for three or more values per key: exact
    for three, one corrected coefficient for four and five, two beyond. A constant sample has no W."""
    keys = list(keys)
    placed = ordered(
        df.where(F.col(value).isNotNull()).select(*keys, *identity, F.col(value).cast("double").alias("_x")),
        keys, ["_x", *identity], position="_i", size="_n", **kwargs,
    )
    m = norm_ppf((F.col("_i") + 1 - 0.375) / (F.col("_n") + 0.25))
    scored = placed.withColumn("_m", m)
    at = lambda offset: F.max(F.when(F.col("_i") == offset, F.col("_x")))
    back = lambda offset: F.max(F.when(F.col("_i") == F.col("_n") - offset, F.col("_x")))
    ends = F.when(F.col("_n") > 5, 2).otherwise(1)  # values at either end with a coefficient of their own
    inner = (F.col("_i") >= ends) & (F.col("_i") < F.col("_n") - ends)
    sums = scored.groupBy(*keys).agg(
        F.max("_n").cast("double").alias("n"),
        F.sum(F.col("_m") * F.col("_m")).alias("mm"),
        F.sum(F.when(inner, F.col("_m") * F.col("_x"))).alias("mx"),
        (F.var_pop("_x") * F.count("_x")).alias("ss"),
        F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_m"))).alias("m1"),
        F.max(F.when(F.col("_i") == F.col("_n") - 2, F.col("_m"))).alias("m2"),
        at(0).alias("x1"), at(1).alias("x2"), back(1).alias("xn"), back(2).alias("xn1"),
    )
    u = 1 / F.sqrt("n")

    def poly(coefficients, x):
        out = F.lit(0.0)
        for c in coefficients:
            out = out * x + c
        return out

    # Royston's polynomials, highest power first.
    a1 = poly((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0), u) + F.col("m1") / F.sqrt("mm")
    a2 = poly((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0), u) + F.col("m2") / F.sqrt("mm")
    left = F.col("mm") - 2 * F.col("m1") * F.col("m1")
    outer = a1 * (F.col("xn") - F.col("x1"))
    many = F.col("mx") / F.sqrt(ratio(left - 2 * F.col("m2") * F.col("m2"), 1 - 2 * a1 * a1 - 2 * a2 * a2)) + outer + a2 * (
        F.col("xn1") - F.col("x2")
    )
    five = F.col("mx") / F.sqrt(ratio(left, 1 - 2 * a1 * a1)) + outer
    three = F.sqrt(F.lit(0.5)) * (F.col("xn") - F.col("x1"))
    top = F.when(F.col("n") > 5, many).when(F.col("n") > 3, five).otherwise(three)
    w = F.when((F.col("n") >= 3) & (F.col("xn") > F.col("x1")), F.least(ratio(top * top, "ss"), F.lit(1.0)))
    n, log_n, gap = F.col("n"), F.log("n"), F.log(1 - F.col("statistic"))
    few = n < 12
    mean = F.when(few, poly((-0.0006714, 0.025054, -0.39978, 0.5440), n)).otherwise(
        poly((0.0038915, -0.083751, -0.31082, -1.5861), log_n)
    )
    spread = F.exp(
        F.when(few, poly((-0.0020322, 0.062767, -0.77857, 1.3822), n)).otherwise(poly((0.0030302, -0.082676, -0.4803), log_n))
    )
    bound = poly((0.459, -2.273), n)
    small = F.when(few & (gap < bound), -F.log(bound - gap))
    z = (F.when(few, small).otherwise(gap) - mean) / spread
    exact = 6 / F.lit(math.pi) * (F.asin(F.sqrt("statistic")) - F.asin(F.sqrt(F.lit(0.75))))
    p = F.when(n > 3, norm_sf(z)).otherwise(F.greatest(exact, F.lit(0.0)))
    out = sums.select(*keys, "n", w.alias("statistic")).withColumn("p", F.when(F.col("statistic").isNotNull(), p))
    return out.withColumn("n", F.col("n").cast("bigint"))


def choose_one_sample(
    df: DataFrame, value: str, identity: Sequence[str], mean: float, keys: Sequence[str] = (), alpha: float = 0.05, **kwargs
) -> DataFrame:
    """Normal samples take t (30 rows or fewer) or z, others signed ranks; ``likely`` tells whether p exceeds alpha."""
    keys = list(keys)
    normal = shapiro(df, value, identity, keys, **kwargs).select(
        *keys, "n", F.col("p").alias("normal_p")
    )
    tests = [
        (t_test(df, value, mean, keys), "t"), (z_test(df, value, mean, keys), "z"),
        (signed_rank(df, value, mean, keys, **kwargs), "s"),
    ]
    for frame, tag in tests:
        normal = attach(normal, frame.select(*keys, F.col("p").alias(f"_p_{tag}")), keys, "left")
    gaussian = F.coalesce(F.col("normal_p") > alpha, F.lit(False))
    test = F.when(~gaussian, "signed_rank").when(F.col("n") <= 30, "t").otherwise("z")
    p = F.when(F.col("test") == "t", F.col("_p_t")).when(F.col("test") == "z", F.col("_p_z")).otherwise(F.col("_p_s"))
    return (
        normal.withColumn("test", test).withColumn("p", p).withColumn("likely", F.col("p") > alpha)
        .select(*keys, "n", "normal_p", "test", "p", "likely")
    )
