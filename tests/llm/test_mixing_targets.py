"""Rates meet the stated targets, of scarce domains too."""

import numpy as np
import pytest

from effortloom.llm import mixing
from effortloom.llm.queries import TARGETS


def table_of(spark, tokens, p):
    return spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "_n bigint, _p array<double>")


def test_scarce_domains_are_raised_to_the_first_targets(spark):
    assert TARGETS == {"clean": 0.94, "low": 0.04, "toxic": 0.02}
    rng = np.random.default_rng(6)
    p = rng.dirichlet([30, 0.06, 0.3], 500)  # low text is a few thousandths of the tokens
    p[:5] = [[0.1, 0.9, 0]] * 5
    tokens = rng.integers(1, 900, 500)
    weights = list(TARGETS.values())
    assert (tokens @ p)[1] < 0.5 * weights[1] * tokens.sum()
    table = table_of(spark, tokens, p)
    pull, shares = mixing.fit(table, weights)
    rates = np.array([r[0] for r in table.select(mixing.rate(pull)).collect()])
    sums = (tokens * rates) @ p
    assert sums / sums.sum() == pytest.approx(weights, abs=1e-4) and shares == pytest.approx(weights, abs=1e-4)
    assert rates.max() > 2 and rates.min() >= 0
    # nearest to one copy each: no change of the rates that keeps the totals lies nearer (conditions of Karush, Kuhn, Tucker)
    free = rates > 0
    dual = np.linalg.lstsq(p[free], 1 - rates[free], rcond=None)[0]
    assert np.abs(p[free] @ dual - (1 - rates[free])).max() < 1e-3
    assert (1 - p[~free] @ dual <= 1e-3).all()


def test_shares_tell_a_target_that_no_rates_meet(spark):
    table = table_of(spark, [100, 100, 50], [[0.9999, 0.0001], [0.99, 0.01], [1.0, 0.0]])
    pull, shares = mixing.fit(table, [0.5, 0.5], passes=10)
    assert shares == pytest.approx([1 - 1.01 / 250, 1.01 / 250], abs=1e-6)
