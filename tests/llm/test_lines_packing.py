"""Line dedup and packing against plain loops."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from effortloom.llm import lines, packing
from effortloom.llm.encode import Encoder, default_tokenizer

LONG = "A licence line that every document repeats."


def plain_dedup(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        cut = (text or "").split("\n")
        keep = [x for x in cut if doc is None or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)])]
        out.append((doc, len(cut), len(cut) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"shared line number {i} with some words" for i in range(12)] + ["short", "", "  ", "Ünïcode línes are cómpared TOO here"]
    rows = []
    for doc in range(60):
        cut = [rng.choice(pool) for _ in range(rng.randrange(0, 9))] + [LONG.upper() if doc % 2 else f"\t{LONG} "]
        rng.shuffle(cut)
        rows.append((doc, "\n".join(cut)))
    rows += [(None, LONG), (None, None), (70, None), (71, ""), (72, "\n\n"), (73, f"{LONG}\n{LONG}"), (73, f"{LONG}\n{LONG}")]
    rows += [(12, f"{LONG}\nown"), (80, "\n".join(f"line {i} of a very long document" for i in range(3000)) + "\n" + LONG)]
    rows += [(81, "\n".join(f"line {i} of a very long document" for i in range(3000))), (1, "line 7 of a very long document")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, pos int, key string")
    got = lines.dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_bitmaps_are_run_lengths(spark):
    docs = spark.createDataFrame([(i, f"head {i}\n{LONG}\nmid\n{LONG}\ntail") for i in range(3)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_dropped"], r["keep_bitmap"]) for r in lines.keep_bitmaps(docs).collect()}
    assert got == {0: (2, [1, 1]), 1: (2, [1, 1])}


def test_encoder_equals_the_tokenizer():
    texts = ["Hello, World's end!! 123 don't we'LL", "<|endoftext|> x", "a\x1cb", "", "İstanbul ΟΔΟΣ é é ﬁ", "naïve ÑANDÚ ½ ²", "x y z", "''s !'s 't", "混合 text ☃ 🙂🙂", "a" * 3000]
    encoder = Encoder(default_tokenizer(), cache_words=5)
    for _ in range(2):
        for text, packed in zip(texts, encoder.encode(texts), strict=True):
            ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(packed, dtype="<u4").tolist() == ids, text


def test_sum_of_squares_places_as_the_rule_says():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 65, 300))[::-1]
    bins, offsets = packing.sum_of_squares(sizes, 64)
    gaps = []
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        fits = [g for g in gaps if g >= s]
        if not fits:
            assert b == len(gaps) and o == 0
            gaps.append(64 - s)
            continue

        def after(gap):
            now = sorted(gaps)
            now.remove(gap)
            now.append(gap - s)
            return sum(now.count(g) ** 2 for g in set(now) if g)

        assert after(gaps[b]) == min(map(after, fits)) and o == 64 - gaps[b]
        gaps[b] -= s
    assert all(g >= 0 for g in gaps)


@pytest.mark.parametrize("group_rows", [7, 100_000])
def test_packing(spark, group_rows):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "Straße", "$$$", "moon"]) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    rows += [(None, "the moon"), (None, None), (7, None), (8, ""), (9, "same"), (9, "same"), (100, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id bigint, text string, piece int, length int")
    got = packing.pack_documents(docs, capacity=64, group_rows=group_rows).collect()
    encoder = Encoder()
    want = []
    for doc, text in rows:
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((doc, piece, start, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())))
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[k] for k in key) for r in got), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    if group_rows > 1000:
        assert len(filled) <= np.ceil(sum(w[3] for w in want) / 64) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0
