"""Collocations against plain counting, over several rounds of growth."""

import random
import re
from collections import Counter

import pytest

from effortloom.llm import phrases


def brute(rows, least=30, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[k : k + m])] += 1
    out = []
    for lang, f in counts.items():
        alive = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            alive.append((p, a, f[p[:k]], f[p[k:]], score))
        most = Counter()
        for p, a, *_ in alive:
            for q in range(2, len(p)):
                for s in range(len(p) - q + 1):
                    most[p[s : s + q]] = max(most[p[s : s + q]], a)
        kept = [x for x in alive if 100 * most[x[0]] < 80 * x[1]]
        kept.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out += [(lang, k + 1, " ".join(p), a, l, r, total[lang], s) for k, (p, a, l, r, s) in enumerate(kept[:top])]
    return sorted(out)


def corpus(seed=7, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "été", "ß"]
    fixed = [["New", "york", "city"], ["at", "the", "end", "of"], ["a", "priori"], ["w1", "w2"], ["w3", "w4", "w5", "w6", "w7"]]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(5, 40)):
            text += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(words)]
            if rng.random() < 0.2:
                text.append(rng.choice([".", ",", "\n", " ! ", "\t", "\r\n", "\x0b"]))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und", ""]), " ".join(text)))
    return rows + [("en", None), ("en", ""), ("fr", " \t.,"), ("zz", "alone"), ("en", "x " * 3000 + "  y"), ("fr", rows[0][1])]


@pytest.mark.parametrize("top, least", [(5, 8), (40, 8), (2000, 30)])
def test_against_plain_counts(spark, top, least):
    rows = corpus()
    docs = spark.createDataFrame([(lang, text, 1, "p") for lang, text in rows], "lang string, text string, f bigint, phrase string").repartition(4)
    got = phrases.collocations(docs, top=top, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_settling_goes_on(spark):
    """Where longer phrases cover nearly all good pairs, the first guess leaves too few and the frontier grows."""
    rows = [("en", f"p{k} q{k} r{k} s{k}. ") for k in range(60) for _ in range(10)] + [("en", f"u{k} v{k}. u{k}.") for k in range(30) for _ in range(10)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, top=20, least=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 20)
    got = phrases.collocations(docs, top=80, least=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 80)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "some few words")], "lang string, text string")).count() == 0


def test_counts_beyond_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 9_100_000_000_000_000)], "f bigint, l bigint")
    assert rows.select(phrases._score("f", "l")).first()[0] == 2_000_000 * 9_000_000_000_000_000 // 9_100_000_000_000_000
