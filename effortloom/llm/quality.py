"""Quality rules: divergence of a document's histograms from the reference of its language.

Two histograms describe a text: its characters by class, and its words by common word (all others in one bucket). The
reference of a language is the same pair summed over its documents, every distinct text once, so a group of thousands
of copies cannot bend it. A document is kept when the Jensen-Shannon distances of both histograms from the reference of
its own language are small; short texts have noisy histograms, so the bounds widen with the inverse root of the length,
and texts under a minimum length fail without being measured. What other languages the table holds changes nothing.

Three passes: candidates for common words by a mergeable heavy-hitter summary, one row of counts per document
(written), the verdict. Candidates and references are tables with one row per language, joined on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python
from effortloom.session import pin

SYMBOLS = b"#*$%&|<>"
#: Character classes; other bytes that start a character are class "beyond ASCII".
CLASSES: tuple[bytes, ...] = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t\n\x0b\f\r",
    b".,;:'\"-()",
    b"!?",
    SYMBOLS,
)
EDGES = b".,;:!?\"'()"
#: A common word is at least this share of the words of the distinct texts of its language.
COMMON_SHARE = 0.0025
#: Counters of a heavy-hitter summary: no word above 1/SUMMARY of the words is lost.
SUMMARY = 4000
#: A candidate is at least this share of the words of all rows. No common word is missed while copies make up less than
#: four fifths of a language; beyond that a missed word counts with the rare ones.
CANDIDATE_SHARE = COMMON_SHARE / 5
#: Words of distinct texts from which on a language has a reference. Documents of smaller ones pass unmeasured.
REFERENCE_WORDS = 5000


def _class_of_byte() -> np.ndarray:
    """Row per byte, column per class; continuation bytes of a character belong to none."""
    table = np.zeros((256, len(CLASSES) + 2), dtype=np.int64)
    for b in range(256):
        column = next((k for k, chars in enumerate(CLASSES) if b in chars), None)
        if column is None:
            column = len(CLASSES) if b < 128 else len(CLASSES) + 1
        if not 128 <= b < 192:
            table[b, column] = 1
    return table


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words found twice or more, the first one included."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    n = len(words) - window + 1
    keys = ids[:n]
    for k in range(1, window):
        if k > 1:  # renumbered, so that the next product fits in 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(numbers) + ids[k : k + n]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    again = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(covered.sum())


def heavy_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n``: lower bounds of word counts that miss no word above 1/SUMMARY of its language's words,
    and the number of all words under ``word`` NULL. ``docs`` has ``lang`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        found: dict[str, Counter] = {}

        def shrink(counts: Counter) -> None:
            """Keep the SUMMARY largest, less the next count: the mergeable form of the frequent-items summary."""
            if len(counts) > SUMMARY:
                floor = sorted(counts.values(), reverse=True)[SUMMARY]
                for w in [w for w, n in counts.items() if n <= floor]:
                    del counts[w]
                for w in counts:
                    counts[w] -= floor

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                raw: dict[str, Counter] = {}
                for lang, text in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist(), strict=True):
                    raw.setdefault(lang, Counter()).update((text or "").lower().encode().split())
                for lang, counts in raw.items():
                    into = found.setdefault(lang, Counter())
                    for w, n in counts.items():
                        into[w.strip(EDGES)] += n
                    totals[lang] += sum(counts.values())
                    if len(into) > 60_000:
                        shrink(into)
        rows = []
        for lang, counts in found.items():
            shrink(counts)
            rows += [(lang, w.decode(), n) for w, n in counts.items() if w] + [(lang, None, totals[lang])]
        names, kinds = ("lang", "word", "n"), (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], names=list(names))

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame) -> DataFrame:
    """``lang``, ``words``: the words of a language that may be common, sorted and joined by blanks, which no word holds.
    At most 1 / (CANDIDATE_SHARE - 1 / SUMMARY) words a language."""
    heavy = pin_python(heavy_words(docs))
    totals = heavy.where("word IS NULL").select("lang", F.col("n").alias("total"))
    sure = F.col("n") >= (CANDIDATE_SHARE - 1 / SUMMARY) * F.col("total")
    words = heavy.where("word IS NOT NULL").join(totals, "lang").where(sure)
    return pin(words.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("words")))


COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "classes array<bigint>, common array<int>, times array<bigint>"
)


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``digest`` and the counts of every document (``docs``: doc_id, lang, digest, text, words);
    ``common`` are places in ``words``, the candidates of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = {}
        table, blanks = _class_of_byte(), CLASSES.index(b" \t\n\x0b\f\r")
        signs = CLASSES.index(SYMBOLS)
        for batch in batches:
            rows: list[tuple] = []
            langs = batch.column(1).to_pylist()
            for at, lang in enumerate(langs):
                if lang not in numbers:
                    numbers[lang] = {w.encode(): k for k, w in enumerate((batch.column(4)[at].as_py() or "").split(" "))}
            for at in range(0, batch.num_rows, 64):
                for lang, text in zip(langs[at : at + 64], batch.column(3).slice(at, 64).to_pylist(), strict=True):
                    number = numbers[lang]
                    data = (text or "").encode()
                    words = data.split()
                    classes = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ table
                    lines = [x for x in data.split(b"\n") if x.strip()]
                    times: dict[int, int] = {}
                    for w, n in Counter((text or "").lower().encode().split()).items():
                        k = number.get(w.strip(EDGES))
                        if k is not None:
                            times[k] = times.get(k, 0) + n
                    rows.append(
                        (
                            len(words), int(classes.sum() - classes[blanks]), int(classes[signs]), len(lines) - len(set(lines)),
                            repeat_words(words), classes.tolist(), list(times), list(times.values()),
                        )
                    )
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["doc_id", "lang", "digest", *[c.split()[0] for c in COUNTS.split(", ")]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return docs.select("doc_id", "lang", "digest", "text", "words").mapInArrow(run, f"doc_id bigint, lang string, digest bigint, {COUNTS}")


def references(counts: DataFrame) -> DataFrame:
    """``lang``, ``total`` (words), ``classes`` (``at``, ``n``), ``common`` (``at``, ``n``): the class histogram and the common words of
    every language of REFERENCE_WORDS words or more. Every distinct text counts once."""
    once = counts.groupBy("lang", "digest").agg(
        F.first("n_words").alias("n_words"), F.first("classes").alias("classes"), F.first("common").alias("common"), F.first("times").alias("times")
    )
    cells = F.flatten(
        F.array(
            F.array(F.struct(F.lit(-1).alias("at"), F.col("n_words").alias("n"))),
            F.transform("classes", lambda n, i: F.struct((F.lit(-2) - i).alias("at"), n.alias("n"))),
            F.arrays_zip(F.col("common").alias("at"), F.col("times").alias("n")),
        )
    )
    sums = pin(once.select("lang", F.explode(cells).alias("c")).groupBy("lang", "c.at").agg(F.sum("c.n").alias("n")))
    totals = sums.where((F.col("at") == -1) & (F.col("n") >= REFERENCE_WORDS)).select("lang", F.col("n").alias("total"))
    part = F.struct("at", "n")
    return pin(
        sums.join(totals, "lang").groupBy("lang", "total").agg(
            F.collect_list(F.when(F.col("at") < -1, F.struct((F.lit(-2) - F.col("at")).alias("at"), "n"))).alias("classes"),
            F.collect_list(F.when((F.col("at") >= 0) & (F.col("n") >= COMMON_SHARE * F.col("total")), part)).alias("common"),
        )
    )


def _reference(total: int, classes: list[dict], common: list[dict]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Class shares, word shares (the last for all other words), and the word column of each common candidate."""
    by_class = np.zeros((1, len(CLASSES) + 2))
    for c in classes:
        by_class[0, c["at"]] = c["n"]
    common = sorted(common, key=lambda c: c["at"])
    by_word = np.array([[c["n"] for c in common]], dtype=float).reshape(1, -1)
    by_word = np.column_stack([by_word, [total - by_word.sum()]])
    return _shares(by_class)[0], _shares(by_word)[0], {c["at"]: k for k, c in enumerate(common)}


def _shares(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of every row of ``p`` from ``q``; 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_class_distance: float = 0.15,
    max_word_distance: float = 0.25,
    class_slack: float = 1.0,
    word_slack: float = 2.5,
) -> DataFrame:
    """Counts and verdict of every row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``digest`` (xxhash64 of the text), ``base_failed``, ``class_distance``, ``word_distance``, ``kept``.

    ``base_failed``: under ``min_words`` words, or over half the words in three-word windows that occur twice or more.
    ``kept`` is false then; else it is true if the reference of the document's language is within
    ``max_class_distance + class_slack / sqrt(n_words)`` by characters and within
    ``max_word_distance + word_slack / sqrt(n_words)`` by words, or if the language has too few words (REFERENCE_WORDS, of
    documents that do not fail) for a reference; the distances are NULL then. Documents without a language, NULL or empty,
    are measured as a language of their own. A NULL text has no words. Rows with equal ids are judged one by one. An empty
    table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"),
    )
    counts = pin_python(document_counts(rows.join(candidates(rows), "lang", "left")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    measures = references(counts.where(~F.col("base_failed")))
    limits, slacks = np.array([max_class_distance, max_word_distance]), np.array([class_slack, word_slack])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple | None] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            distances = np.full((batch.num_rows, 2), np.nan)
            for lang in set(langs):
                where = np.flatnonzero(langs == lang)
                if lang not in known:
                    total, of_classes, of_words = (batch.column(k)[int(where[0])].as_py() for k in (5, 6, 7))
                    known[lang] = None if total is None else _reference(total, of_classes, of_words)
                if known[lang] is None:
                    continue
                by_class, by_word, column = known[lang]
                for at in range(0, len(where), 256):
                    some = where[at : at + 256]
                    part = batch.select([2, 3, 4]).take(pa.array(some))
                    words = np.zeros((len(some), len(by_word)))
                    for k, (common, times) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                        for c, n in zip(common, times, strict=True):
                            if c in column:
                                words[k, column[c]] = n
                    words[:, -1] = sizes[some] - words.sum(axis=1)
                    classes = np.array(part.column(0).to_pylist(), dtype=float).reshape(len(some), -1)
                    distances[some, 0] = js_distance(_shares(classes), by_class)
                    distances[some, 1] = js_distance(_shares(words), by_word)
            allowed = limits + slacks / np.sqrt(np.maximum(sizes, 1))[:, None]
            near = ~(distances > allowed).any(axis=1)
            verdict = pa.array(near & ~batch.column(8).to_numpy(zero_copy_only=False).astype(bool))
            measured = [pa.array(d, mask=np.isnan(d)) for d in distances.T]
            yield pa.RecordBatch.from_arrays([batch.column(1), *batch.columns[8:], *measured, verdict], names=names)

    own = ["n_words", "base_failed", "doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "digest"]
    names = [*own, "class_distance", "word_distance", "kept"]
    refs = measures.withColumnsRenamed({"classes": "_classes", "common": "_common"})
    used = counts.join(refs, "lang", "left").select("lang", "n_words", "classes", "common", "times", "total", "_classes", "_common", *own[1:])
    return used.mapInArrow(
        run,
        "n_words bigint, base_failed boolean, doc_id bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, digest bigint, class_distance double, word_distance double, kept boolean",
    ).select("doc_id", *[c for c in names if c != "doc_id"])
