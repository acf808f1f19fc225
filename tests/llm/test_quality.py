"""Quality counts, references and verdicts against plain loops."""

import math
import random
import re
from collections import Counter

from effortloom.llm import quality

COMMON = {"en": "the of and to in that is was for it".split(), "de": "der die und in den von zu das mit sich".split()}


def prose(rng, lang, n):
    rare = ["".join(rng.choice("abdegilmnorstu") for _ in range(6)) for _ in range(n)]
    text = " ".join(rng.choice(COMMON[lang]) if rng.random() < 0.5 else w for w in rare)
    return ". ".join(re.findall(".{1,70}(?: |$)", text)) + "."


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    symbols = len(re.findall("[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def plain_js(p, q):
    keys = set(p) | set(q)
    sp, sq = sum(p.values()) or 1, sum(q.values()) or 1
    total = 0.0
    for k in keys:
        a, b = p.get(k, 0) / sp, q.get(k, 0) / sq
        for x in (a, b):
            if x:
                total += x * math.log2(2 * x / (a + b)) / 2
    return math.sqrt(max(0.0, total))


def histograms(text, vocabulary):
    classes = Counter()
    for c in text or "":
        classes[next((k for k, s in enumerate(quality.CLASSES) if c in s.decode()), 7 if ord(c) < 128 else 8)] += 1
    words = Counter()
    for w in re.findall("[^\x20\x09-\x0d]+", (text or "").lower()):
        w = w.strip(quality.EDGES.decode())
        words[w if vocabulary is None or w in vocabulary else None] += 1
    return classes, words


def test_counts_and_verdicts(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, "de" if i % 3 == 0 else "en", rng.randrange(60, 400)), "de" if i % 3 == 0 else "en") for i in range(90)]
    rows += [(i, rows[1][1], "en") for i in range(100, 160)]  # many copies of one text
    bad = [(200, " ".join(f"{w}$$$" for w in prose(rng, "en", 200).split()), "en"), (201, prose(rng, "en", 300).upper(), "en")]
    bad += [(202, "echo " * 30000, "en"), (203, " | ".join("".join(rng.choice("xyzq") for _ in range(9)) for _ in range(300)), "de")]
    odd = [(None, rows[0][1], None), (204, prose(rng, "en", 80), None), (210, None, None), (211, "", "xx"), (212, "a\nb\na\n \na", "en"), (213, "a b c a b c d", "en")]
    odd += [(214, "naïve £ text\x1cone\x85two " * 40, "en"), (214, "tie", "en"), (214, "tie", "en")]
    rows += bad + odd
    docs = spark.createDataFrame([(i, t, g, True, 1) for i, t, g in rows], "doc_id bigint, text string, lang string, kept boolean, n_words int")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *plain_counts(t)) for i, t, _ in rows), key=str)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in [*range(90), *range(100, 160)]) and not any(kept[i] for i, _, _ in bad)

    # distances by loops, from references that count each distinct text once
    good = {(g or "", t) for i, t, g in rows if not plain_counts(t)[-1]}
    references = {}
    for g in {g for g, _ in good}:
        texts = [t for x, t in good if x == g]
        total, every = sum(len(t.split()) for t in texts), sum((histograms(t, None)[1] for t in texts), Counter())
        if total >= quality.REFERENCE_WORDS:
            vocabulary = {w for w, n in every.items() if w and n >= quality.COMMON_SHARE * total}
            assert g not in COMMON or set(COMMON[g]) <= vocabulary
            both = [histograms(t, vocabulary) for t in texts]
            references[g] = vocabulary, sum((c for c, _ in both), Counter()), sum((w for _, w in both), Counter())
    assert set(references) == {"en", "de"}
    by_id = {i: (t, g or "") for i, t, g in rows}
    for r in got:
        if r["doc_id"] not in by_id or r["doc_id"] in (None, 214):
            continue
        text, lang = by_id[r["doc_id"]]
        if lang not in references:
            assert r["class_distance"] is None and r["word_distance"] is None and r["kept"] == (not r["base_failed"])
            continue
        vocabulary, rc, rw = references[lang]
        c, w = histograms(text, vocabulary)
        distances = plain_js(c, rc), plain_js(w, rw)
        slack = 1 / math.sqrt(max(r["n_words"], 1))
        assert math.isclose(distances[0], r["class_distance"], abs_tol=1e-9) and math.isclose(distances[1], r["word_distance"], abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and distances[0] <= 0.15 + slack and distances[1] <= 0.25 + 2.5 * slack)


def test_other_languages_change_nothing(spark):
    """A small language among many texts of another one, and one under the least size."""
    rng = random.Random(9)
    few = [(i, prose(rng, "de", 300), "de") for i in range(30)] + [(i, prose(rng, "de", 200).upper(), "de") for i in range(30, 35)]
    tiny = [(i, prose(rng, "en", 100).upper(), "xx") for i in range(40, 45)]
    many = [(i, prose(rng, "en", 300), "en") for i in range(100, 1300)]
    schema = "doc_id bigint, text string, lang string"
    columns = ["doc_id", "class_distance", "word_distance", "kept"]
    alone = quality.judge(spark.createDataFrame(few + tiny, schema)).select(columns).collect()
    among = quality.judge(spark.createDataFrame(few + many + tiny, schema)).where("doc_id < 100").select(columns).collect()
    assert sorted(alone) == sorted(among)
    assert {r["doc_id"] for r in alone if r["kept"]} == {*range(30), *range(40, 45)}


def test_copies_do_not_bend_common_words(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, "en", 300), "en") for i in range(40)]
    odd = " ".join("".join(rng.choice("xyz") for _ in range(5)) for _ in range(300))
    schema = "doc_id bigint, text string, lang string"
    columns = ["doc_id", "class_distance", "word_distance", "kept"]
    once = quality.judge(spark.createDataFrame(rows + [(100, odd, "en")], schema)).where("doc_id < 100").select(columns)
    often = quality.judge(spark.createDataFrame(rows + [(100 + i, odd, "en") for i in range(60)], schema)).where("doc_id < 100").select(columns)
    assert sorted(once.collect()) == sorted(often.collect())


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
