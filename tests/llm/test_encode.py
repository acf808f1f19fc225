"""Token ids through the word cache: the tokenizer's own, with few calls and few words handed over."""

import random

import numpy as np

from effortloom.llm import encode
from effortloom.llm.encode import Encoder


class Spy:
    """A tokenizer that notes what it is given, call by call."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def encode(self, text, **options):
        self.calls.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.calls.append(" ".join(texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def watched(**options):
    encoder = Encoder(**options)
    encoder.tokenizer = Spy(encoder.tokenizer)
    return encoder, encoder.tokenizer


def fresh(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(9)) for _ in range(n)]


def test_words_in_use_outlive_a_full_cache():
    rng = random.Random(1)
    encoder, spy = watched(cache_words=100)
    for _ in range(60):
        encoder.encode([" ".join(["harbour", "lantern", *fresh(rng, "abcdefgh", 30), "meadow"])])
    assert all(sum(word in call for call in spy.calls) == 1 for word in ("harbour", "lantern", "meadow"))


def test_words_of_any_script_go_to_the_tokenizer_together():
    encoder, spy = watched()
    words = fresh(random.Random(2), "абвгдежзик", 500)
    got = encoder.encode([" ".join(words[:250]), " ".join(words[250:])])
    assert len(spy.calls) <= 2
    want = [spy.tokenizer.encode(" ".join(ws), add_special_tokens=False).ids for ws in (words[:250], words[250:])]
    assert [np.frombuffer(p, dtype="<u4").tolist() for p in got] == want


def test_any_characters_in_small_caches_and_slices(monkeypatch):
    rng = random.Random(3)
    some = list("aBsTé Éß' .,!&<>|_01²½¹ßÿ×µªº\n\t\0\x1c\x85") + ["İ", "́", "̱", "̸", "’", " ", "Σ", "ﬁ", "中", "🙂", "ͅ", "K", "Ǆ", "Ⱥ", "'re", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["İ.", "m².", "²", "a²², b", "H̱,"]
    for cache_words, size, joined in ((3, 64, 5), (700, 1000, 1000), (400_000, 1 << 22, 1 << 18)):
        monkeypatch.setattr(encode, "SLICE", size)
        monkeypatch.setattr(encode, "JOINED", joined)
        encoder = Encoder(cache_words=cache_words)
        want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for _ in range(2):
            assert [np.frombuffer(p, dtype="<u4").tolist() for p in encoder.encode(texts)] == want
    assert encoder.encode([None, "", " \n"]) == [b"", b"", b""] and encoder.encode([]) == []


def test_a_tokenizer_without_the_mark():
    encoder = Encoder(cache_words=20)
    encoder.mark = None
    texts = ["the moon, the m² and İ. " * 3, None, "the moon"]
    assert encoder.encode(texts) == Encoder().encode(texts)


def test_a_mark_that_does_not_part_words():
    encoder = Encoder()
    encoder.mark = -1
    texts = ["the moon, the m² and İ.", "the moon"]
    assert encoder.encode(texts) == Encoder().encode(texts)
