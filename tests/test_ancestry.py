"""Ranges between tags against plain sets of ancestors."""

import math
import random

import pytest

from effortloom.operators import ancestry

TAGS = "project string, version string, sha int, previous_sha int"
EDGES = "project string, sha int, parent int, place int, version string"


def plain(tags, edges):
    below = {}
    for project, sha, parent, *_ in edges:
        below.setdefault((project, sha), set()).add(parent)

    def ancestors(project, sha):
        seen, open_ = set(), [sha]
        while open_:
            at = open_.pop()
            if at is not None and at not in seen:
                seen.add(at)
                open_ += below.get((project, at), ())
        return seen

    return sorted((p, v, s) for p, v, sha, old in set(tags) for s in ancestors(p, sha) - ancestors(p, old))


def found(spark, tags, edges, **kwargs):
    got = ancestry.commits_of_ranges(spark.createDataFrame(tags, TAGS), spark.createDataFrame(edges, EDGES), **kwargs)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    tags, edges = [], []
    for project in ("p", "q"):
        for sha in range(60):
            some = rng.sample(range(max(0, sha - 9), sha), min(sha, rng.choice([0, 1, 1, 1, 2, 3])))
            edges += [(project, sha, parent, k, "x") for k, parent in enumerate(some)] or [(project, sha, None, 0, "x")]
        heads = rng.sample(range(60), 6)
        tags += [(project, f"v{k}", sha, heads[k - 1] if k else None) for k, sha in enumerate(heads)]
    edges += edges[:5]
    assert found(spark, tags + tags[:2], edges, width=4) == plain(tags, edges)


def test_rounds_do_not_grow_with_depth(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ancestry, "pin", lambda df, pin=ancestry.pin: written.append(1) or pin(df))
    n = 6000  # a main line, and a side line merged every 100 commits
    edges = [("p", k, k - 1, 0, None) for k in range(1, n)] + [("p", n + k, n + k - 1, 0, None) for k in range(1, n)]
    edges += [("p", k, n + k, 1, None) for k in range(0, n, 100)]
    tags = [("p", str(k), k, k - 1000 if k > 1000 else None) for k in range(999, n, 1000)]
    assert found(spark, tags, edges) == plain(tags, edges)
    assert len(written) < math.log2(n) + 12


def test_odd_input(spark):
    edges = [("p", 2, 1, 0, None), ("p", None, 1, 0, None), (None, 2, 1, 0, None), ("p", 3, 99, 0, None)]
    tags = [("p", "a", 2, None), ("p", "b", 3, 2), ("p", "c", 3, 3), ("p", "d", 7, 8), ("p", None, 2, 3), (None, "e", 2, None), ("p", "f", None, None)]
    want = [("p", "a", 1), ("p", "a", 2), ("p", "b", 3), ("p", "b", 99), ("p", "d", 7), ("p", None, 1), ("p", None, 2)]
    got = ancestry.commits_of_ranges(spark.createDataFrame(tags, TAGS), spark.createDataFrame(edges, EDGES)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert found(spark, [], edges) == [] and found(spark, [("p", "a", 5, None)], []) == [("p", "a", 5)]
    with pytest.raises(ValueError):
        found(spark, tags, [("p", 1, 2, 0, None), ("p", 2, 1, 0, None)])
