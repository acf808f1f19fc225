"""The n-gram join against brute force, with crowded lists, chains and texts without words."""

import random
from collections import Counter

import pytest

from effortloom.llm import ngramjoin

LIKE = (90, 100)


def plain_set(text, k=3):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def brute(rows, like=LIKE):
    """(id, set size, smallest id reachable) of every row."""
    sets = [plain_set(t) for _, t in rows]
    part, whole = like
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and whole * both >= part * (len(sets[x]) + len(sets[y]) - both):
                group[top(x)] = top(y)
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(x)] = min(ids.get(top(x), i), i)
    return Counter((i, len(sets[x]), ids.get(top(x)) if sets[x] else i) for x, (i, _) in enumerate(rows))


def edited(rng, words, n):
    out = words.copy()
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def corpus(crowd=60):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = [" ".join(fresh(rng.randrange(1, 200))) for _ in range(60)]
    for n, edits in ((60, 1), (60, 2), (120, 2), (400, 4), (400, 8), (300, 5)):
        base = fresh(n)
        texts += [" ".join(base), " ".join(edited(rng, base, edits)), " ".join(base[:-3]), " ".join(base).upper()]
    chain = fresh(150)  # each like the next, the ends unlike
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 1)
    many = fresh(200)  # near copies, partly below the likeness: every list of theirs is crowded
    texts += [" ".join(edited(rng, many, rng.randrange(9))) for _ in range(crowd)]
    passage = fresh(60)  # a passage that many texts share; two of them are near copies all the same
    texts += [" ".join(fresh(80) + passage) for _ in range(50)]
    texts += [texts[-1] + " more", texts[-2].replace(passage[0], "other", 1)]
    small = [f"s{k}" for k in range(12)]
    texts += [" ".join(small[:n]) for n in range(1, 13)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowded", [2, 4, 32])
def test_components(spark, crowded):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = ngramjoin.near_duplicates(docs, crowded=crowded).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_other_thresholds(spark):
    rows = corpus(30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngramjoin.near_duplicates(docs, likeness=(3, 5), crowded=3).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute(rows, (3, 5))


def test_blocks_alone(spark, monkeypatch):
    """The last step by itself finds what brute force finds, in blocks of few sets."""
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", 9)
    rows = corpus(30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    like = ngramjoin.Likeness(*LIKE)
    marks = ngramjoin._marks(docs, "doc_id", "text", 3, like).where("n > 0")
    sets = ngramjoin._sets(docs, marks.select("node", "digest").distinct(), "text", 3)
    sets = sets.join(marks.select("node", "n").distinct(), "node").selectExpr("node", "n", "node AS root", "s")
    found = {frozenset(r) for r in ngramjoin._blocks(sets, like).collect()}
    by_node = {r["node"]: set(r["s"]) for r in sets.collect()}

    def groups(pairs):
        group = {n: n for n in by_node}

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in pairs:
            group[top(a)] = top(b)
        return {frozenset(n for n in by_node if top(n) == top(m)) for m in by_node}

    nodes = sorted(by_node)
    want = [(a, b) for a in nodes for b in nodes if a < b and 100 * len(by_node[a] & by_node[b]) >= 90 * len(by_node[a] | by_node[b])]
    assert groups([tuple(p) for p in found]) == groups(want)
    assert all(tuple(sorted(p)) in want for p in found)


def test_divide_skip():
    rng = random.Random(1)
    for _ in range(800):
        lists = [sorted(rng.sample(range(40), rng.randrange(30))) for _ in range(rng.randrange(12))]
        need = rng.randrange(1, 9)
        counts = Counter(x for some in lists for x in some)
        assert ngramjoin.divide_skip(lists, need) == {x: n for x, n in counts.items() if n >= need}


def test_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One "), (6, "one two"), (None, "one"), (4, "one"), (7, long), (8, long + " x"), (7, "else"), (None, None)]
    docs = spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id bigint, text string, n bigint, node string")
    got = ngramjoin.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == brute(rows)
    assert ngramjoin.near_duplicates(docs.limit(0)).count() == 0
