"""Fingerprints and shards against plain loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from effortloom.llm import minhash, shards


def word_hash(data, seed=42):
    x = xxhash.xxh64(data, seed=seed & (2**64 - 1)).intdigest()
    return x - 2**64 if x >> 63 else x


def chain(*longs):
    """Spark's hash of several bigints: the hash of one seeds the next."""
    seed = 42
    for x in longs:
        seed = word_hash(int(x).to_bytes(8, "little", signed=True), seed)
    return seed


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    hs = [word_hash(w.encode()) for w in re.findall("[^\x20\x09-\x0d]+", low)]
    if not hs:
        return []
    if len(hs) < 5:
        # an array is hashed element by element, like a row of columns
        keys = [(chain(*hs) % 2**64) >> 1]
    else:
        keys = [(chain(*hs[i : i + 5]) % 2**64) >> 1 for i in range(len(hs) - 4)]
    bins = {}
    for k in keys:
        bins[k >> 56] = min(k, bins.get(k >> 56, k))
    values = []
    for b in range(minhash.BINS):
        if b not in bins:
            b = next(j for j in sorted(range(minhash.BINS), key=lambda j: xxhash.xxh64(bytes([b, j])).intdigest()) if j in bins)  # noqa: B023
        values.append(bins[b] & 255)
    return values


def plain_rows(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, word_hash(r[1].encode())))
    out = []
    for at, (i, text) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        fps = [plain_fingerprint(t) for t in (text, edited, after)]

        def near(a, b):
            if not a or not b:
                return float(not a and not b)
            share = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
            return max(0.0, (share - 1 / 256) / (1 - 1 / 256))

        hexes = ["".join(f"{v:02x}" for v in f) for f in fps]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexes[:2], near(fps[0], fps[1]), near(fps[0], fps[2])))
    return out


@pytest.mark.parametrize("buckets", [1, 5, 40])
def test_edited_likeness(spark, buckets):
    rng = random.Random(4)
    words = ["Wörd%d" % i for i in range(200)] + ["the", "OF"]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))) for i in range(40)]
    rows += [(9, rows[3][1]), (9, rows[3][1]), (9, "other"), (None, "no id here"), (None, None), (None, "second without"), (500, ""), (501, None)]
    rows += [(502, "a b c"), (503, "x"), (504, "\n many \t blanks\x1c here and there "), (505, "long text " * 20_000 + "end")]
    docs = spark.createDataFrame([(i, t, 0, "f") for i, t in rows], "doc_id bigint, text string, n_chars int, fp string")
    got = minhash.edited_likeness(docs, buckets=buckets).collect()
    key = lambda r: tuple(str(x) for x in r)[:5]
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain_rows(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert minhash.edited_likeness(docs.limit(0)).count() == 0
    assert [r["near_next"] for r in minhash.edited_likeness(docs.where("doc_id = 502")).collect()] == [1.0]


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(9)
    rows, truth = [], []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        other = base.copy()
        for at in rng.sample(range(400), i // 2):
            other[at] = f"v{rng.randrange(10**6)}"
        a, b = ({" ".join(t[k : k + 5]) for k in range(396)} for t in (base, other))
        truth.append(len(a & b) / len(a | b))
        rows.append((" ".join(base), " ".join(other)))
    df = spark.createDataFrame(rows, "a string, b string")
    df = minhash.add_fingerprint(minhash.add_fingerprint(df, "a", "fa"), "b", "fb")
    from pyspark.sql import functions as F

    found = [r[0] for r in df.select(minhash.likeness(F.col("fa"), F.col("fb"))).collect()]
    off = np.array(found) - np.array(truth)
    assert np.abs(off).max() < 0.2 and abs(off.mean()) < 0.02


def plain_places(rows, n=24, overhead=8):
    items = []
    for i, t in rows:
        data = (t or "").encode()
        items.append((word_hash(data), -(2**63) if i is None else i, zlib.crc32(data), len(data) + overhead, i))
    items.sort(key=lambda x: x[:3])
    total, run, slots, out = sum(x[3] for x in items), 0, defaultdict(int), []
    for *_, crc, size, i in items:
        s = (2 * run + size) * n // (2 * total)
        out.append((i, size, crc, s, slots[s]))
        slots[s] += 1
        run += size
    return out


@pytest.mark.parametrize("rows_per_range", [3, 1_000_000])
def test_shards(spark, rows_per_range):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(0, 200) + str(rng.randrange(50))) for i in range(600)]
    rows += [(1000 + i, "one text that a third of all rows hold") for i in range(300)]
    rows += [(5, "repeated"), (5, "repeated"), (None, None), (None, ""), (None, "é" * 5), (9999, "y" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, shard int, key int")
    got = shards.shard(docs, rows_per_range=rows_per_range).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_places(rows), key=str)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 24
    assert all(abs(s - mean) <= 3008 for s in sizes.values())
    assert shards.shard(docs.limit(0)).count() == 0
    assert [tuple(r) for r in shards.shard(docs.where("doc_id = 9999")).collect()] == [(9999, 3008, zlib.crc32(b"y" * 3000), 12, 0)]


def test_ranges_are_lexicographic():
    rng = np.random.default_rng(1)
    cuts = np.unique(np.array([(a, b) for a, b in rng.integers(0, 6, (20, 2))], dtype=shards.SPLITTER))
    keys, ids = rng.integers(-1, 7, 500), rng.integers(-1, 7, 500)
    want = [sum((c["key"], c["id"]) <= (k, i) for c in cuts) for k, i in zip(keys, ids, strict=True)]
    assert shards.range_of(keys, ids, cuts).tolist() == want
