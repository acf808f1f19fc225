"""Mixing against plain numbers, and the pipeline's stages against plain code."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from effortloom.llm import lines, mixing, packing, quality, simhash
from effortloom.llm.queries import TARGETS

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean"


#: The few training texts of the tests leave clean documents a share of toxic mass; these targets can be met all the same.
MILD = {"clean": 0.88, "low": 0.07, "toxic": 0.05}


def documents(seed=3, n=150):
    rng = random.Random(seed)
    common = "the of and to in that is was for it with as".split()

    def prose(k):
        return ". ".join(" ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abdeglmnorstu") for _ in range(6)) for _ in range(12)) for _ in range(k)) + "."

    rows = []
    for i in range(n):
        text, kind = prose(rng.randrange(6, 30)), i % 10
        if kind == 8:
            text = " ".join(f"{w}%%%" for w in text.split())
        elif kind == 9:
            cut = text.split()
            for _ in range(4):
                cut[rng.randrange(len(cut))] = rng.choice(["nastyword", "uglyword"])
            text = " ".join(cut)
        if kind == 1:
            text += "\nA shared licence line of some length.\nown " + str(i)
        rows.append((i, text, "en", f"src{i % 3}", len(text), None))
    rows += [(1000 + i, rows[3][1], "en", "src0", len(rows[3][1]), True) for i in range(40)]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "src1", 0, None), (None, rows[5][1] + " end", "en", None, 1, None), (7, rows[7][1], "en", "again", 1, False)]
    labels = [(i, 0 if i % 10 == 8 else 1, int(i % 10 == 9)) for i in range(n)]
    return rows, labels + [(None, 1, 0), (3, None, None)]


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400)
    tokens = rng.integers(0, 3000, 400)
    weights = [0.2, 0.75, 0.05]
    table = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "_n bigint, _p array<double>")
    pull = mixing.fit_rates(table, weights)
    rates = np.maximum(0, 1 - p @ np.array(pull))
    got = [r[0] for r in table.select(mixing.rate(pull)).collect()]
    assert got == pytest.approx(rates.tolist(), abs=1e-9) and min(got) >= 0
    sums = (tokens * rates) @ p
    assert sums / sums.sum() == pytest.approx(weights, abs=1e-4)
    totals = tokens @ p
    assert sums.sum() == pytest.approx((totals / weights).min(), rel=1e-4)
    # a rate is the cut of a linear form of the posterior: the condition for being nearest to one copy each
    assert (rates == 0).any() and (rates > 0).any()
    # plain projected gradient descent from one copy each ends at the same totals
    slow, a = np.ones(400), p * tokens[:, None]
    for _ in range(2000):
        slow = np.maximum(0, slow - p @ np.linalg.solve((p * tokens[:, None]).T @ p, a.T @ slow - sums))
    assert a.T @ slow == pytest.approx(sums, rel=1e-3)
    # a domain that is all but missing neither blows up the rates nor shrinks the others
    scarce = spark.createDataFrame([(100, [0.9999, 0.0001]), (100, [0.99, 0.01]), (50, [1.0, 0.0])], "_n bigint, _p array<double>")
    got = [r[0] for r in scarce.select(mixing.rate(mixing.fit_rates(scarce, [0.5, 0.5]))).collect()]
    assert got == pytest.approx([1, 1, 1], abs=1e-6)
    assert mixing.fit_rates(table.where("_n < 0"), weights) == [0.0, 0.0, 0.0]


def test_mix(spark):
    rows, labels = documents()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], DOCS + ", rate double")
    marks = mixing.quality_domains(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    mixed = mixing.Mix(docs, marks, MILD)
    got = mixed.rows().collect()
    flat = sorted((r["row"]["doc_id"] or -1, r["n_tokens"], r["rate"]) for r in got)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["rate"]) for r in mixed.rates().collect()) == flat
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == len((r["row"]["text"] or "").split()) and sum(r[f"p_{d}"] for d in MILD) == pytest.approx(1)
        if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 150 and r["n_tokens"] > 20:
            kind = "low" if r["row"]["doc_id"] % 10 == 8 else "toxic" if r["row"]["doc_id"] % 10 == 9 else "clean"
            assert r[f"p_{kind}"] == max(r[f"p_{d}"] for d in MILD)
    sums = np.array([sum(r["n_tokens"] * r["rate"] * r[f"p_{d}"] for r in got) for d in MILD])
    assert sums / sums.sum() == pytest.approx(list(MILD.values()), abs=1e-4)
    drawn = mixing.copies(mixed.rows())
    assert drawn.columns == docs.columns
    times = Counter(r["doc_id"] for r in drawn.collect())
    for r in got:
        i = r["row"]["doc_id"]
        if i not in (7, None):
            assert times[i] in (int(r["rate"]), int(r["rate"]) + 1)
    assert mixing.Mix(docs.limit(0), marks, MILD).rates().count() == 0
    even = mixing.Mix(docs, marks.limit(0), MILD).rates().select("p_clean").distinct().collect()
    assert [r[0] for r in even] == pytest.approx([1 / 3])


def test_pipeline(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out

    def ids(df):
        return Counter(r["doc_id"] for r in df.select("doc_id").collect())

    # quality: what the operator rejects goes, all else stays
    before, after = kept[0]
    assert ids(after) == ids(quality.judge(before).where("kept"))
    assert not any(i % 10 == 8 for i in ids(after) if i is not None and i < 1000)
    # line dedup: texts and lengths follow
    before, after = kept[1]
    want = sorted(((r["row"]["doc_id"], r["kept"]) for r in lines.dedup_lines(before).collect()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=str) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["doc_id"] and r["doc_id"] % 10 == 1 and r["doc_id"] < 141)
    # near dedup: one row a component
    before, after = kept[2]
    roots = simhash.near_duplicates(before).select("root").distinct().count()
    assert after.count() == roots and set(ids(after)) == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert ids(after)[3] == 1 and 1000 not in ids(after) and ids(after)[7] == 1
    # mixing: copies by rate
    before, after = kept[3]
    assert set(ids(after)) <= set(ids(before)) and len(ids(after)) > 0.8 * before.where("doc_id % 10 < 8").count()
    # packing: all pieces of what is left
    before, after = kept[4]
    assert sorted(ids(after)) == sorted(ids(packing.token_pieces(before)))
    assert sorted(ids(corpus_pipeline.run(spark, str(tmp_path))).items()) == sorted(ids(after).items())


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
