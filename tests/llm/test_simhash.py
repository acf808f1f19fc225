"""Fingerprints, links and components against plain loops."""

import random

import pytest
import xxhash

from effortloom.llm import simhash
from effortloom.llm.components import connected_components

COLUMNS = "doc_id bigint, text string, kept string"


def plain_simhash(text, n=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_fingerprint_of_texts():
    texts = [None, "", " \n", "one", "Two words", "a b c", "É È a\xa0b c\x1cd E", "x " * 50, " ".join(map(str, range(300)))]
    for t in texts:
        assert simhash.simhash(t) % 2**64 == plain_simhash(t)


@pytest.mark.parametrize("crowded", [1, 4, 64])
def test_links_find_every_pair(spark, crowded):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:6]:
        for _ in range(15):
            values.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))}))
    ball = rng.getrandbits(64)  # many fingerprints in few bits: every key of the first level is crowded
    spots = rng.sample(range(64), 8)
    values |= {ball ^ sum(1 << s for s in spots if rng.random() < 0.5) for _ in range(120)}
    signed = sorted(simhash._signed(v) for v in values)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    rows = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {tuple(r) for r in simhash.links(rows, 3, crowded).distinct().collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)]
    pairs += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(pairs)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    near = base.copy()
    near[7] = "other"
    rows = [(5, " ".join(base), "x"), (3, " ".join(near), None), (9, " ".join(base), ""), (9, " ".join(base), "")]
    rows += [(i, " ".join(rng.choice(words) for _ in range(80)), None) for i in range(20, 40)]
    rows += [(50, None, None), (41, "", None), (42, "  ", None), (None, " ".join(base), None), (60, None, "z"), (61, "LONG " * 30000, None)]
    fps = [(i, plain_simhash(t)) for i, t, _ in rows]
    distinct = sorted({f for _, f in fps})
    root = roots(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3])
    smallest = {}
    for i, f in fps:
        if i is not None:
            smallest[root[f]] = min(i, smallest.get(root[f], i))
    want = sorted(((i, f"{f:016x}", smallest[root[f]]) for i, f in fps), key=str)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert {r[0]: r[2] for r in got}[9] == 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
