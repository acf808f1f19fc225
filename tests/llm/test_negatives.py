"""Hard negatives against brute force, with broken, repeated and unlike vectors."""

import math
import random

import numpy as np
import pytest

from effortloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, slot string"


def brute(rows, anchors, positives=5, count=5):
    """Rows as (id, vector, label); every row is its own, equal anchor rows are mined once."""
    taking = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({(i, tuple(v), y) for i, v, y in taking if i in anchors}):
        def score(v, a=anchor):
            return sum(x * z for x, z in zip(a[1], v, strict=False))

        others = [(score(v), i, y) for i, v, y in taking if (i, tuple(v), y) != anchor]
        same = sorted(((-s, i) for s, i, y in others if y == anchor[2]))[:positives]
        for p, pid in ((-s, i) for s, i in same):
            band = sorted((-s, i) for s, i, y in others if y != anchor[2] and 80 * p <= 100 * s <= 100 * p)[:count]
            out += [(anchor[0], pid, k + 1, i, p, -s) for k, (s, i) in enumerate(band)]
    return sorted(out)


def run(spark, rows, **settings):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(table, "vec_id % 10 = 0", **settings)
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, width=6):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    out = []
    for i in range(n):
        c = rng.choice(middle)
        out.append((i, [x + rng.gauss(0, 0.4) for x in c], rng.randrange(4)))
    return out


@pytest.mark.parametrize("portion", [7, 4096])
def test_against_brute_force(spark, portion):
    rows = vectors(1, 400)
    rows += [(500 + k, rows[k][1], rows[k][2]) for k in range(40)]  # ties: equal vectors under other ids
    assert run(spark, rows, portion=portion) == brute(rows, set(range(0, 600, 10)))


def test_broken_and_repeated_rows(spark):
    rows = vectors(2, 60)
    rows += [(70, None, 1), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (90, [float("nan")] * 6, 2), (100, [float("inf")] + [0.0] * 5, 2)]
    rows += [(110, [0.5] * 6, None), (None, [0.5] * 6, 1), (120, [0.0] * 6, 1), (130, [], 1), (141, [0.7, 0.1], 3), (150, [0.4] * 8, 3)]
    rows += [rows[0], rows[0], rows[11], (20, [0.3] * 6, 2)]
    assert run(spark, rows) == brute(rows, set(range(0, 200, 10)))


def test_one_vector_many_times_and_large_components(spark):
    rows = [(i, [0.25, 0.5], i % 2) for i in range(300)] + [(1000, [1e6, -1e6], 0), (1001, [1e6, -1e6], 0), (1003, [9e5, -9e5], 1)]
    assert run(spark, rows) == brute(rows, set(range(0, 1010, 10)))


def test_empty_and_alone(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, [1.0], 1)]) == []
    assert run(spark, [(11, [1.0], 1), (12, [1.0], 2)]) == []


def test_walk_ends_early():
    rng = np.random.default_rng(0)
    a = np.tile([100.0, 0.0], (4, 1)) + rng.normal(0, 1, (4, 2)).round()
    x = np.concatenate(([[100.0, 0.0]] * 5, rng.normal(0, 5, (5000, 2)).round()))
    portion = negatives.Portion(np.arange(4), np.arange(4), np.zeros(4, dtype=int), a, np.zeros(4, dtype=int), np.array([[1.0, 0.0]]))
    best, seen = negatives.Best(4, 5), []

    def step(members, scores, some):
        seen.append(len(some[0]))
        r, c = np.nonzero(scores >= best.last[members][:, None])
        best.add(members[r], scores[r, c].astype(int), some[0][c])

    negatives._walk(portion, (np.arange(len(x)), np.zeros(len(x)), x, np.arange(len(x))), step, lambda m: best.last[m])
    assert sum(seen) == 128 and sorted(best.id[best.slot == 0].tolist()) == [0, 1, 2, 3, 4]
