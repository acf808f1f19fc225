"""Positive-unlabelled learning: the risk's gradient, held-out accuracy and the edges of the data."""

import random
import zlib

import numpy as np
import pytest

from effortloom.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("mo", "ta", "li", "re", "nu", "so", "ke") for b in ("ra", "li", "to", "ne", "sa", "mi", "du", "vo")]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randrange(15, 60))]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["Nastyword,", "uglyword", "badword!"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_fit_learns_from_positives_and_unlabelled_alone():
    rows = corpus(3000)
    hashed = [(toxicity.word_buckets(t), y) for _, t, y in rows]
    positive = [b for b, y in hashed[:1500] if y][:150]  # half of the toxic texts are confirmed, no negative is known
    model = toxicity.fit(positive, [b for b, _ in hashed[:1500]], 0.2)
    score = model.margins([b for b, _ in hashed[1500:]])
    truth = np.array([y for _, y in hashed[1500:]])
    predicted = score >= np.log(0.3 / 0.7)
    assert (predicted == truth).mean() > 0.97
    # naive training on unlabelled as negatives would put the prior's share of them at half; here the mean score is right
    assert abs((1 / (1 + np.exp(-score))).mean() - 0.2) < 0.06


def test_words():
    crc = lambda w: zlib.crc32(w.encode()) % toxicity.BUCKETS
    assert toxicity.word_buckets("Don't STOP, naïve-1x") == sorted(map(crc, ["don", "t", "stop", "naïve", "x"]))
    assert toxicity.word_buckets(None) == toxicity.word_buckets("12 !") == []


def test_score(spark):
    rows = corpus(1200)
    extra = [(None, "uglyword here", None), (5000, None, None), (5001, "", None), (5002, "badword " * 30_000, None), (5003, "same", None), (5003, "same", None)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows + extra], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (7, None, 0), (999_999, 1, 0)], "doc_id bigint, toxic int, held_out int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert len(held) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["predicted"] == 1 and not by_id[None]["held_out"] and by_id[5002]["predicted"] == 1
    assert by_id[5000]["score"] == by_id[5001]["score"] < 0.3 and all(0 <= r["score"] <= 1 for r in got)
    # labels of held-out documents change nothing
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, wrong).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-12) for r in got)
    assert toxicity.score(docs, labels.limit(0)).where("score BETWEEN 0 AND 1").count() == len(got)
    assert toxicity.score(docs.limit(0), labels).count() == 0
