"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in three bits or fewer have a half that
differs in one bit at most, so they meet under a key of that half: under the half itself when it is equal, else under
the half with the differing bit replaced by a wildcard. Each fingerprint is indexed under 2 x (1 + 32) keys; keys are
joined on equality and the pairs verified.

A key under which many fingerprints meet is not joined: the bits outside the key are cut again in the same way and the
rows indexed under the longer keys, until a key leaves so few bits free that it cannot hold many fingerprints at all.
Equal fingerprints collapse beforehand, so thousands of copies are one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python
from effortloom.llm.components import connected_components
from effortloom.session import pin

#: Keys with more fingerprints than this are cut again.
CROWDED = 64


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text as a signed number; see ``fingerprints``."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the six blanks
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], stops[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops[width - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in blocks
        block = np.array(hashes[at : at + (1 << 16)], dtype=np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``digest`` (xxhash64 of the text) and ``fp`` (bigint) of every row.

    A-Z are lower-cased; words are what lies between blanks; shingles of ``shingle`` words are taken with repeats (a
    shorter text is one shingle) and hashed with XXH64, seed 42. A bit is 1 if more than half the hashes have it. A
    text without words, or NULL, has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                simhash(text, shingle)
                for at in range(0, batch.num_rows, 64)
                for text in batch.column(2).slice(at, 64).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int64())], names=["doc_id", "digest", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, digest bigint, fp bigint")


def _variants(rows: DataFrame, low: int, width: int, level: int) -> DataFrame:
    """Index rows under the two halves of the free bits ``low`` to ``low + width - 1`` of their fingerprint.

    The new key joins the old one with: which half, which bit of it is a wildcard (-1: none), the half with that bit
    cleared. Rows of a key with a wildcard must differ in that bit to be a pair - equal halves meet once, under the key
    without wildcard. ``need`` has a bit for each level with a wildcard, ``side`` the row's own cleared bits, so a pair
    is wanted if its sides differ exactly in ``need``. ``low`` becomes the start of the bits still free.
    """
    half = width // 2
    options = []
    for begin, free in ((low, low + half), (low + half, low)):
        mask = ((1 << half) - 1) << begin
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        options.append(F.struct(F.lit(free).alias("low"), F.lit(-1).alias("gap"), value.alias("part"), F.lit(0).alias("bit")))
        for i in range(begin, begin + half):
            cleared = value.bitwiseAND(F.lit(_signed(~(1 << i))))
            bit = F.when(value == cleared, 0).otherwise(1 << level)
            options.append(F.struct(F.lit(free).alias("low"), F.lit(i).alias("gap"), cleared.alias("part"), bit.alias("bit")))
    return rows.where(F.col("low") == low).select("fp", "prefix", "need", "side", F.explode(F.array(*options)).alias("o")).select(
        F.xxhash64("prefix", "o.low", "o.gap", "o.part").alias("key"),
        F.col("o.low").alias("low"),
        (F.col("need") + F.when(F.col("o.gap") < 0, 0).otherwise(1 << level)).alias("need"),
        (F.col("side") + F.col("o.bit")).alias("side"),
        "fp",
    )


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _pairs(keyed: DataFrame, keys: DataFrame, distance: int) -> DataFrame:
    """Verified links of the rows that share one of ``keys``."""
    some = keyed.join(keys.select("key"), "key", "left_semi")
    left = some.select("key", "need", F.col("side").alias("side_a"), F.col("fp").alias("a"))
    right = some.select("key", F.col("side").alias("side_b"), F.col("fp").alias("b"))
    wanted = (F.col("a") < F.col("b")) & (F.col("side_a").bitwiseXOR(F.col("side_b")) == F.col("need"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, "key").where(wanted & close).select("a", "b")


def links(fps: DataFrame, distance: int = 3, crowded: int = CROWDED) -> DataFrame:
    """All links ``a``, ``b`` between distinct fingerprints ``fp`` that differ in ``distance`` (3 or fewer) bits.

    Level by level: 32-bit halves, then 16-bit and 8-bit halves of the bits that a crowded key leaves free. After the
    third cut 8 bits and at most three wildcards are free, so a key holds 2,048 fingerprints at most, whatever the
    table. Keys that cannot make a pair - one row, or a wildcard bit alike in all rows - are dropped before the join.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves find pairs of three bits or fewer")
    found = None
    none = F.lit(0)
    rows = fps.select("fp", none.cast("long").alias("prefix"), none.alias("low"), none.alias("need"), none.alias("side"))
    for level, width in enumerate((64, 32, 16)):
        keyed = None
        for low in range(0, 64, width):
            part = _variants(rows, low, width, level)
            keyed = part if keyed is None else keyed.union(part)
        counts = keyed.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.max("need").alias("need"),
            F.bit_or("side").alias("any"), F.bit_and("side").alias("all"),
        )
        mixed = F.col("any").bitwiseAND(F.bitwise_not("all")).bitwiseAND(F.col("need")) == F.col("need")
        live = pin(counts.where((F.col("n") > 1) & mixed).select("key", "n"))
        few = live if level == 2 else live.where(F.col("n") <= crowded)
        some = _pairs(keyed, few, distance)
        found = some if found is None else found.union(some)
        many = live.where(F.col("n") > crowded)
        if level == 2 or many.isEmpty():
            return found
        rows = pin(
            keyed.join(many.select("key"), "key", "left_semi").select("fp", F.col("key").alias("prefix"), "low", "need", "side")
        )
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``root`` (one number a component) and ``digest`` for
    every row.

    Documents are linked when their fingerprints differ in ``distance`` bits or fewer; ``component_id`` is the smallest
    ``doc_id`` reachable, itself included. Rows with equal ids stay apart and share a component if their texts do. A
    row without an id gets the smallest id of its component, NULL if the component has none. An empty table gives an
    empty result.
    """
    marked = pin_python(fingerprints(docs, id_col, text_col, shingle))
    distinct = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = pin(links(distinct.select("fp"), distance).distinct())
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    grouped = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", "root", "digest")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """One row of ``docs`` for each component; see ``one_each``."""
    return one_each(docs, near_duplicates(docs, id_col, text_col, **rules), id_col, text_col)


def one_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``found``: the smallest id, of equal ids the smallest text hash, of equal
    rows any. Rows without an id stay only where a component has no other."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("b")).select(
        F.col("b.doc_id").alias("_id"), F.col("b.digest").alias("_hash")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col(f"row.`{id_col}`").cast("long").alias("_doc"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string")).alias("_digest")
    )
    kept = rows.join(best, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_hash")), "left_semi")
    one = F.row_number().over(Window.partitionBy("_doc", "_digest").orderBy("_digest"))
    return kept.withColumn("_one", one).where("_one = 1").select("row.*")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
