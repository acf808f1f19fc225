"""One-permutation MinHash fingerprints, in DataFrame expressions alone.

Every shingle of a text is hashed once; the top bits of the hash choose one of ``BINS`` bins, the rest is its value, and
each bin keeps its smallest value. Sorting the hashes puts the bins in order, so the first of every run is the minimum.
An empty bin is filled by optimal densification: it asks bins in a random order of its own, fixed by a hash of the bin
numbers alone, and takes over the value of the first one that is not empty, which is uniform among these.
Of every bin the low ``BITS`` bits are kept, eight bins to a 64-bit word. Two unequal values agree in them by chance once
in 2^BITS, so the share of equal bins is corrected for that.
"""

from __future__ import annotations

import functools
import operator

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortloom.llm.common import BLANKS, lower_ascii, tasks

BINS, BITS = 128, 8
#: Bits of a bin's value; with 7 bits of bin number a positive 64-bit number.
VALUE_BITS = 56
WORDS = BINS * BITS // 64


@functools.cache
def probe_order() -> list[list[int]]:
    """For every bin the order in which others are asked for a value: all bins by a hash of the two numbers."""
    return [sorted(range(BINS), key=lambda j: xxhash.xxh64_intdigest(bytes([b, j]))) for b in range(BINS)]


def add_fingerprint(df: DataFrame, text: str, name: str, shingle: int = 5) -> DataFrame:
    """Add ``name``: the fingerprint of column ``text`` as WORDS 64-bit numbers; without words an empty array.

    Words lie between blanks, A-Z lower-cased; a shingle is ``shingle`` words, a shorter text is one shingle.
    """
    trimmed = F.btrim(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    cut = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    hashes = F.transform(cut, lambda w: F.xxhash64(w))
    short = F.array(F.shiftrightunsigned(F.xxhash64("_h"), 1))
    long = F.transform(
        F.sequence(F.lit(0), F.size("_h") - shingle),
        lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(F.col("_h"), i + 1, shingle)), 1),
    )
    n = F.size("_h")
    keys = F.sort_array(F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, short).otherwise(long))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, VALUE_BITS).cast("int")

    # the key before the first is NULL
    firsts = F.filter("_k", lambda x, i: F.coalesce(F.shiftright(x.bitwiseXOR(F.get(F.col("_k"), i - 1)), VALUE_BITS) != 0, F.lit(True)))
    # one entry a bin, NULL where it is empty
    gaps = F.transform(
        "_f",
        lambda x, i: F.concat(
            F.array_repeat(F.lit(None).cast("bigint"), bin_of(x) - F.when(i == 0, -1).otherwise(bin_of(F.get(F.col("_f"), i - 1))) - 1),
            F.array(x),
        ),
    )
    low = (1 << BITS) - 1

    # the first of a bin's probes that is not empty; array_intersect keeps their order
    probes = F.split(F.lit(",".join(str(j) for row in probe_order() for j in row)), ",").cast("array<int>")
    values = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda b: F.when(F.get(F.col("_d"), b).isNotNull(), F.get(F.col("_d"), b))
        .otherwise(F.get(F.col("_d"), F.get(F.array_intersect(F.slice(probes, b * BINS + 1, BINS), F.col("_e")), F.lit(0))))
        .bitwiseAND(low),
    )
    a_word = 64 // BITS
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda j: functools.reduce(
            lambda x, y: x.bitwiseOR(y),
            [F.shiftleft(F.get(F.col("_v"), j * a_word + k), 64 - BITS * (k + 1)) for k in range(a_word)],
        ),
    )
    return (
        df.withColumn("_h", hashes).withColumn("_k", keys).withColumn("_f", firsts).withColumn("_d", F.flatten(gaps))
        .withColumn("_e", F.transform("_f", bin_of))
        .withColumn("_v", F.when(F.size("_f") > 0, values))
        .withColumn(name, F.when(F.col("_v").isNull(), F.array().cast("array<bigint>")).otherwise(packed))
        .drop("_h", "_k", "_f", "_d", "_e", "_v")
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets of two fingerprints, 0 to 1. Two texts without words are alike."""

    def unequal(x: Column, y: Column) -> Column:
        """Bytes in which two words differ: the bits of each byte are folded into its lowest one."""
        z = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift)).bitwiseAND(F.lit(mask))
        return F.bit_count(z)

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), operator.add)
    chance = 1 / (1 << BITS)
    share = (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(share, F.lit(0.0))).when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)


def hex_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _bounds(rows: DataFrame, order: list[str], buckets: int) -> list[tuple]:
    """Starts of the evenly filled ranges of an order, without the first: ``buckets`` at most reach the driver."""
    starts = (
        rows.select(*order).repartitionByRange(buckets, *order)
        .groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("start")).select("start.*").collect()
    )
    return sorted({tuple(r) for r in starts}, key=lambda t: [(x is not None, x or 0) for x in t])[1:]


def _bucket(order: list[str], bounds: list[tuple]) -> Column:
    """Number of bounds at or before a row. They are searched in two steps, so a row is compared with about
    2 sqrt(buckets) of them."""
    key, side = F.struct(*order), max(1, int(len(bounds) ** 0.5))

    def literals(some: list[tuple]) -> Column:
        kind = "array<struct<" + ",".join(f"{c}:bigint" for c in order) + ">>"
        return F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(c) for c, x in zip(order, t, strict=True)]) for t in some]).cast(kind)

    def upto(some: Column) -> Column:
        return F.size(F.filter(some, lambda x: x <= key))

    coarse = upto(literals(bounds[side - 1 :: side])) * side
    return coarse + upto(F.slice(literals(bounds), coarse + 1, side))


def follow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``fp`` of every row and ``next``: the struct of text and ``fp`` of the following row in
    ascending order of id (first the rows without an id; equal ids by a hash of the text); the last row is followed by
    the first.

    Texts are shuffled once: rows are dealt to evenly filled ranges of the order and look ahead inside them. A range's
    last row looks at the first row of the next range, which a small aggregate provides. Range bounds are pairs of id
    and hash, so rows with one id spread over ranges unless they are equal.
    """
    order = ["doc_id", "_o"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("_o", F.xxhash64("text"))
    bounds = _bounds(rows, order, buckets or 3 * tasks(docs.sparkSession))
    rows = rows.withColumn("_b", _bucket(order, bounds))
    firsts = rows.groupBy("_b").agg(F.min_by("text", F.struct(*order)).alias("_text"))
    firsts = add_fingerprint(firsts, "_text", "_fp", shingle)
    line = Window.orderBy("_b")  # one row a range
    onward = F.struct(F.col("_text").alias("text"), F.col("_fp").alias("fp"))
    after = firsts.select(
        "_b", F.coalesce(F.lead(onward).over(line), F.first(onward).over(line)).alias("_after")
    )
    ahead = F.lead(F.struct("text", "fp")).over(Window.partitionBy("_b").orderBy(*order))
    looked = add_fingerprint(rows, "text", "fp", shingle).withColumn("_ahead", ahead)
    return looked.join(after, "_b").select("doc_id", "text", "fp", F.coalesce("_ahead", "_after").alias("next"))


def edited_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4, shingle: int = 5, buckets: int | None = None
) -> DataFrame:
    """Fingerprints of every text and of an edited copy: its last ``n_chars // part`` code points replaced by the first
    as many of the next document (all of it if it is shorter).

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hexadecimal), ``near_edited``
    and ``near_next`` (estimated likeness to the edited copy and to the next document). NULL is the empty text; texts
    without words have an empty fingerprint. A single row is its own next. An empty table gives an empty result.
    """
    rows = follow(docs, id_col, text_col, shingle, buckets).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / part).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    return add_fingerprint(rows, "edited", "edited_fp", shingle).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        hex_text(F.col("fp")).alias("fingerprint"), hex_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
