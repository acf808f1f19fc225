"""Token ids of whole texts by a public BPE tokenizer, fast enough for large corpora.

The tokenizer drops white space and never merges across it, so ids are worked out once per distinct word, many words in
one call. They are kept in a bounded cache that outlives the task and drops the words met least. Texts are cut, counted and
put together as Arrow and numpy arrays: nothing runs in Python per word of a text, only per distinct word of a batch.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE_WORDS = 400_000
#: Bytes of text worked on at a time, one text at least; words put together at a time; words in a call of the tokenizer.
SLICE, JOINED, LEARNED = 1 << 22, 1 << 18, 5000
#: Texts of these characters alone are lower-cased alike by Arrow and the tokenizer and have no other composed form.
PLAIN = r"\A[\x{0}-\x{12F}\x{131}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}]*\z"
#: The tokenizer always cuts between a letter or digit and punctuation, so a blank there changes nothing. Not so after a
#: dotted capital I, which is lower-cased to a letter and a combining dot.
BORDER = "([A-Za-z0-9À-ÖØ-öø-įı-ɏ])([!-/:-@\\[-`{-~])"
#: Texts with these go to the tokenizer whole: added tokens, and separators that Python and Arrow alone take for white space.
SPECIAL = "<\\||[\x1c-\x1f]"
#: A number character is a piece of its own whatever stands beside it; this one is a single token.
MARK = "²"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of every range, one range after the other."""
    stops = np.cumsum(counts, dtype=np.int64)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(begins - stops + counts, counts)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, ``add_special_tokens=False``."""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        self.limit = cache_words
        mark = self._whole(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        #: Word i has ``counts[i]`` ids from ``begins[i]`` on in ``ids`` and was met in ``hits[i]`` batches of late.
        self.words: dict[str, int] = {}
        self.begins, self.counts, self.hits = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.ids = np.empty(0, dtype="<u4")

    @classmethod
    def shared(cls, path: str | None = None) -> Encoder:
        """The encoder of this worker process; a reused worker keeps its cache from task to task."""
        store = sys.modules.setdefault("effortloom_encoders", types.ModuleType("effortloom_encoders")).__dict__
        key = f"encoder {path}"
        if key not in store:
            store[key] = cls(path)
        return store[key]

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _one_call(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has. No word holds the mark."""
        ids = np.asarray(
            self.tokenizer.encode_batch_fast([MARK.join(words)], add_special_tokens=False)[0].ids, dtype="<u4"
        )
        marks = ids == self.mark
        stops = np.append(np.flatnonzero(marks), len(ids))
        if len(stops) != len(words):  # never where the mark is a piece of its own; kept exact all the same
            parts = [self._whole(w) for w in words]
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return ids[~marks], np.diff(stops, prepend=-1) - 1

    def _learn(self, new: list[str]) -> None:
        """Add words to the cache, numbered on in the given order."""
        joined = [w for w in new if MARK not in w] if self.mark is not None else []
        found = [self._one_call(joined[at : at + LEARNED]) for at in range(0, len(joined), LEARNED)]
        if len(joined) < len(new):
            found = [self._alone(new, *map(np.concatenate, zip((self.ids[:0], self.counts[:0]), *found, strict=True)))]
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.counts = np.concatenate([self.counts, *(counts for _, counts in found)])
        self.begins = np.cumsum(self.counts) - self.counts
        self.hits = np.append(self.hits, np.zeros(len(new), dtype=np.int64))

    def _alone(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of words that hold the mark between those of the others."""
        others = iter(np.split(ids, np.cumsum(counts)[:-1]))
        parts = [self._whole(w) if self.mark is None or MARK in w else next(others) for w in new]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _trim(self) -> None:
        """Keep the half of the cache met most. Counts are halved, so that words of long ago give way."""
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        known = list(self.words)  # in the order of their numbers
        self.words = {known[i]: n for n, i in enumerate(keep.tolist())}
        self.ids = self.ids[_ranges(self.begins[keep], self.counts[keep])]
        self.counts, self.hits = self.counts[keep], self.hits[keep] // 2
        self.begins = np.cumsum(self.counts) - self.counts

    def _known(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words in the cache, which learns those that it lacks."""
        numbers = self._known(words)
        if len(self.words) + np.count_nonzero(numbers < 0) > self.limit:  # the limit and a slice bound the cache
            self._trim()
            numbers = self._known(words)
        lacks = np.flatnonzero(numbers < 0)
        if len(lacks):
            numbers[lacks] = len(self.words) + np.arange(len(lacks))
            self._learn([words[i] for i in lacks.tolist()])
        self.hits[numbers] += 1
        return numbers

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, SPECIAL)
        words = pc.if_else(whole, "", texts)
        words = pc.if_else(pc.match_substring_regex(words, PLAIN), pc.utf8_lower(words), words)
        words = pc.utf8_split_whitespace(pc.replace_substring_regex(words, BORDER, r"\1 \2"))
        coded = words.flatten().dictionary_encode()
        numbers, at = self._numbers(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        begins, counts = self.begins[numbers], self.counts[numbers]
        packed = b"".join(
            self.ids[_ranges(begins[some], counts[some])].tobytes()
            for some in (at[i : i + JOINED] for i in range(0, len(at), JOINED))
        )
        ends = np.append(0, np.cumsum(counts[at], dtype=np.int64))[words.offsets.to_numpy()] * 4
        ends = ends.tolist()
        for i, alone in enumerate(whole.to_pylist()):
            yield self._whole(texts[i].as_py()).tobytes() if alone else packed[ends[i] : ends[i + 1]]

    def packed(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of every text, one after the other; NULL has none."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield from self._slice(texts.slice(begin, end - begin))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of every text; NULL has none."""
        return list(self.packed(pa.array(texts, pa.string())))
