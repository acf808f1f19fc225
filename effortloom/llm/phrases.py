"""Phrase collocations by best-first branch-and-bound growth.

A phrase scores by its rarest-looking cut: twice its count over the summed counts of its two parts, in millionths, least
over all cuts. Growing a phrase to the right can only lower its count while the count of its first word stays, and the
rest after the first word is found at least as often as the whole phrase. So no phrase that starts with P scores above

    2000000 * f(P) / (f(first word) + f(P))

which the counts of the prefixes P give without a look at the extensions. Per language a settling score is guessed from
the pairs of words; prefixes are expanded - their extensions counted - only while their bound reaches it, best bounds
first. If enough phrases of that score survive, nothing unexpanded can come before them; if not, the settling score of
that language goes down and the frontier with it, until the last wanted score, ties included, is settled or nothing is
left to expand. A phrase survives unless a phrase one word longer contains it nearly always; for that the extensions to
the left of the phrases in question are counted along.

Every counting pass reads the texts once. What is wanted is told to the tasks as a bitmap of hashes of fixed size: a
phrase that is counted by a chance hit is counted in full, so hits cost time and no truth. Counts are summed where the
texts lie, by language and phrase, before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python
from effortloom.session import pin

#: Characters that end a piece, the blanks between words, the language of rows without one.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
NO_LANGUAGE = "und"

LONGEST = 4
#: Bits of a bitmap, as a power of two: two megabytes whatever the corpus.
BITS = 24
#: Words that a task gathers before it sums them up.
BLOCK = 1 << 21

_BREAK = b"\xff"  # never part of UTF-8
_TABLE = bytes(
    0xFF if b in ENDS else 0x20 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with a break between pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()


def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64)


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))


def _fold(start: np.uint64, parts: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words, one array a place."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), start, dtype=np.uint64)
        for p in parts:
            out = (out ^ p) * _STEP
            out ^= out >> np.uint64(29)
    return out >> np.uint64(64 - BITS)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits numbered ``at`` are set."""
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Numbers(dict):
    """Words numbered as they come; the break between pieces is 0."""

    def __init__(self):
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def bitmap(phrases: DataFrame) -> np.ndarray:
    """The hashes of ``phrases`` (lang, phrase) as a bitmap, eight bits a byte. Tasks send the 64-bit words they set, at most 2**18 of them in
    all, and the driver joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = _word_hash(phrase.encode().split(b" "))
                found[_fold(_lang_hash(lang), [hashes[k : k + 1] for k in range(len(hashes))])] = True
        packed = np.packbits(found, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "part"])

    parts = phrases.select("lang", "phrase").mapInArrow(run, "at bigint, part bigint")
    packed = np.zeros((1 << BITS) // 64, dtype=np.int64)
    table = parts.groupBy("at").agg(F.bit_or("part").alias("part")).toPandas()
    packed[table["at"].to_numpy()] = table["part"].to_numpy()
    return packed.view(np.uint8)


def _distinct(ids: np.ndarray, at: np.ndarray, m: int, numbers: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct windows of ``m`` words that start in ``at``, an array a place, and their counts."""
    if m == 1:
        counts = np.bincount(ids[at], minlength=numbers)
        some = np.flatnonzero(counts)
        return [some], counts[some]
    if m == 2:
        codes, counts = np.unique(ids[at] * numbers + ids[at + 1], return_counts=True)
        return [codes // numbers, codes % numbers], counts
    codes = ids[at]
    for k in range(1, m):
        if k > 1:
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * numbers + ids[at + k]
    _, first, counts = np.unique(codes, return_index=True, return_counts=True)
    return [ids[at[first] + k] for k in range(m)], counts


def count_phrases(docs: DataFrame, m: int, wanted: list[list[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """``lang``, ``phrase``, ``f`` of windows of ``m`` words inside pieces; ``docs`` has ``lang`` and ``text``.

    A window is counted if all conditions of one of the lists in ``wanted`` hold (no list: always); a condition (a, b,
    bitmap) asks that its words a to b - 1 are in the bitmap. With ``m`` 1 the number of all words comes along under a
    NULL phrase.
    """
    share = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = share.value
        gathered: dict[str, list[np.ndarray]] = {}
        numbers = _Numbers()

        def summed() -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            hashes = _word_hash(names) if tests else None
            for lang, some in gathered.items():
                ids = np.concatenate(some)
                at = np.arange(max(len(ids) - m + 1, 0))
                whole = ids[: len(at)] > 0
                for k in range(1, m):
                    whole &= ids[k : k + len(at)] > 0
                at = at[whole]
                if tests:
                    start, hit = _lang_hash(lang), np.zeros(len(at), dtype=bool)
                    for conditions in tests:
                        left = np.flatnonzero(~hit)
                        for a, b, bits in conditions:
                            left = left[_has(bits, _fold(start, [hashes[ids[at[left] + k]] for k in range(a, b)]))]
                        hit[left] = True
                    at = at[hit]
                columns, counts = _distinct(ids, at, m, len(names))
                for cut in range(0, len(counts), 100_000):
                    parts = [[names[i] for i in c[cut : cut + 100_000].tolist()] for c in columns]
                    phrases = parts[0] if m == 1 else list(map(b" ".join, zip(*parts, strict=True)))
                    yield _batch(lang, pa.array(phrases, pa.binary()).cast(pa.string()), counts[cut : cut + 100_000])
                if m == 1:
                    yield _batch(lang, pa.nulls(1, pa.string()), np.array([(ids > 0).sum()]))
            gathered.clear()
            numbers.clear()
            numbers[_BREAK] = 0

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                langs = batch.column(0).slice(at, 64).to_pylist()
                texts = batch.column(1).slice(at, 64).cast(pa.binary()).to_pylist()
                for lang, text in zip(langs, texts, strict=True):
                    found = tokens(text)
                    found.append(_BREAK)
                    gathered.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                    size += len(found)
                    if size >= BLOCK:
                        yield from summed()
                        size = 0
        yield from summed()

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f bigint")
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang] * len(phrases), pa.string())
    return pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"])


def _exact(x: str) -> str:
    return f"cast({x} as decimal(20,0))"


def _score(a: str, parts: str) -> Column:
    """floor(2000000 * a / parts), exact at any size."""
    return F.expr(f"cast(2000000 * {_exact(a)} as decimal(38,0)) div {_exact(parts)}")


def _first(k: int) -> Column:
    return F.substring_index("phrase", " ", k)


def _rest(k: int, m: int) -> Column:
    return F.substring_index("phrase", " ", k - m)


def _cuts(phrases: DataFrame, m: int, counts: dict[int, DataFrame]) -> DataFrame:
    """``phrases`` (lang, phrase, f) with the counts ``l1``, ``r1``, ... of the parts of every cut; NULL if not counted."""
    out = phrases
    for k in range(1, m):
        left = counts[k].select("lang", F.col("phrase").alias("_part"), F.col("f").alias(f"l{k}"))
        right = counts[m - k].select("lang", F.col("phrase").alias("_part"), F.col("f").alias(f"r{k}"))
        out = out.withColumn("_part", _first(k)).join(left, ["lang", "_part"], "left").drop("_part")
        out = out.withColumn("_part", _rest(k, m)).join(right, ["lang", "_part"], "left").drop("_part")
    return out


def _scored(cut: DataFrame, m: int) -> DataFrame:
    """``lang``, ``phrase``, ``f``, ``l``, ``r``, ``score`` of the lowest-scoring cut (ties: the first), and ``bound``, which no
    phrase that starts with this one scores above."""
    options = [F.struct(_score("f", f"(l{k} + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)]
    least = F.array_min(F.array(*options))
    return cut.withColumn("_c", least).select("lang", "phrase", "f", "_c.l", "_c.r", "_c.score", _score("f", "(l1 + f)").alias("bound"))


def _reaching(scored: DataFrame, tau: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` reaches the settling score of their language; other languages are settled and left out."""
    return scored.join(tau, "lang").where(F.col(column) >= F.col("tau")).drop("tau")


def _settling(pairs: DataFrame, langs: DataFrame, place: int) -> DataFrame:
    """``lang`` and ``tau``: the score of the pair at ``place``, or 0 where a language has fewer."""
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"))
    top = pairs.select("lang", "score").withColumn("_p", F.row_number().over(by_score)).where(F.col("_p") <= place)
    lowest = top.groupBy("lang").agg(F.max("_p").alias("n"), F.min("score").alias("low"))
    tau = F.when(F.col("n") >= place, F.col("low")).otherwise(0)
    return langs.join(lowest, "lang", "left").select("lang", F.coalesce(tau, F.lit(0)).cast("long").alias("tau"))


def _uncovered(found: DataFrame, longer: DataFrame, m: int, covered: tuple[int, int]) -> DataFrame:
    """Those of ``found`` (of ``m`` words) that no phrase of ``longer`` contains in a share ``covered`` of their places."""
    part, whole = covered
    inner = F.array(_first(m), _rest(1, m + 1))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = F.col("most").isNull() | F.expr(f"{whole} * {_exact('most')} < {part} * {_exact('f')}")
    return found.join(most, ["lang", "phrase"], "left").where(kept).drop("most")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 30,
    top: int = 2000,
    covered: tuple[int, int] = (80, 100),
) -> DataFrame:
    """The first ``top`` phrases of two to four words of every language: ``lang``, ``rank``, ``phrase`` (words joined by a
    space), ``a``, ``l``, ``r`` (counts of the phrase and of the parts of its lowest-scoring cut), ``n`` (words of the
    language), ``score``.

    A-Z are lower-cased; ``ENDS`` end pieces, space and tab part words; phrases lie within pieces and overlap. Phrases
    found ``least`` times or more count; one whose words lie inside a longer one with a share ``covered`` of its count
    is dropped. Order: score, then ``a``, both descending, then the phrase by bytes. NULL languages are one language,
    ``und``; NULL texts are empty; every repeated row counts. An empty table gives an empty result.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    words = pin_python(count_phrases(rows, 1, []).where((F.col("f") >= least) | F.col("phrase").isNull()))
    totals = words.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = words.where("phrase IS NOT NULL")
    known = bitmap(words)
    pairs = pin_python(count_phrases(rows, 2, [[(0, 1, known), (1, 2, known)]]).where(F.col("f") >= least))
    frequent = bitmap(pairs)
    two = pin(_scored(_cuts(pairs, 2, {1: words}), 2))
    counts = {1: words, 2: pairs}

    open_langs, place, settled = totals.select("lang"), 2 * top, None
    while True:
        tau = pin(_settling(two, open_langs, place))
        mine = rows.join(tau, "lang", "left_semi")
        some = _reaching(two, tau, "score")
        grow = bitmap(_reaching(two, tau, "bound"))
        asked = bitmap(some)
        wanted = [[(0, 2, grow), (1, 3, frequent)], [(1, 3, asked), (0, 2, frequent)]]
        triples = pin_python(count_phrases(mine, 3, wanted).where(F.col("f") >= least))
        three = pin(_scored(_cuts(triples, 3, counts), 3))
        long = _reaching(three, tau, "score")
        grow = bitmap(_reaching(three, tau, "bound"))
        asked = bitmap(long)
        wanted = [[(0, 3, grow), (2, 4, frequent)], [(1, 4, asked), (0, 2, frequent)]]
        fours = pin_python(count_phrases(mine, 4, wanted).where(F.col("f") >= least))
        cut = pin(_cuts(fours, 4, {**counts, 3: triples}))
        # r1 and l3 are counts of three words and may be missing: without l3 the phrase is only here to cover others, and
        # r1 is counted for those that may still score
        open_four = cut.where("l3 IS NOT NULL AND r1 IS NULL").select("lang", _rest(1, 4).alias("phrase")).distinct()
        missing = pin(open_four)
        if not missing.isEmpty():
            extra = pin_python(count_phrases(mine, 3, [[(0, 3, bitmap(missing))]]).where(F.col("f") >= least))
            extra = extra.join(triples, ["lang", "phrase"], "left_anti")
            cut = pin(_cuts(fours, 4, {**counts, 3: pin(triples.union(extra))}))
        four = _reaching(_scored(cut.where("l3 IS NOT NULL"), 4), tau, "score")
        alive = _uncovered(some, triples, 2, covered).union(_uncovered(long, fours, 3, covered)).union(four)
        alive = pin(alive.drop("bound"))
        enough = alive.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= top).select("lang")
        done = pin(tau.where("tau = 0").select("lang").union(enough).distinct())
        ready = alive.join(done, "lang", "left_semi")
        settled = ready if settled is None else settled.union(ready)
        open_langs = pin(tau.select("lang").join(done, "lang", "left_anti"))
        if open_langs.isEmpty():
            break
        place *= 4

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    best = settled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score")
    )
