"""Line dedup: which lines of which document stay, as compressed bitmaps.

Every line's key is hashed where it lies; only hashes, document ids and positions are shuffled. They are
range-partitioned by hash and document and sorted by document and position inside a range, so one pass over a range
sees the holders of a key one after the other, the keeping document first. A key that fills several ranges - a licence
line in a third of all documents - is many tasks; what its ranges saw is added up in a table of at most two rows a range.

The result holds no text. A bitmap is run-length coded: the number of kept lines before each dropped line; lines after
the last dropped one are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from effortloom.llm.common import BLANKS, lower_ascii
from effortloom.session import pin


def split_lines(text: Column) -> Column:
    """Lines of a text; NULL and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """One row per document that loses lines: ``doc_id``, ``text_hash``, ``n_dropped``, ``keep_bitmap``.

    A key of ``min_chars`` code points or more that ``min_docs`` documents or more hold loses all its lines except
    those in the largest document id holding it. Rows with equal id are one document. ``text_hash`` (xxhash64 of the
    text) tells rows with equal id and different texts apart. Rows without an id lose nothing and count for nothing.
    An empty table gives an empty result.
    """
    occurrences = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        # two hashes of different seeds: 128 bits, so that different lines never share a key in practice
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "text_hash", "pos")
    )
    # equal (hash, document) never spans two ranges: the range bounds are values of these three columns
    ranged = pin(
        occurrences.repartitionByRange("h1", "h2", F.desc("doc_id"))
        .sortWithinPartitions("h1", "h2", F.desc("doc_id"), "pos")
        .withColumn("rid", F.spark_partition_id())
    )
    key = ["rid", "h1", "h2"]
    stream = Window.partitionBy(*key).orderBy(F.desc("doc_id"), "pos")
    whole = Window.partitionBy(*key)
    seen = (
        ranged.withColumn("before", F.lag("doc_id").over(stream))
        .withColumn("first", F.when(F.col("before").isNull() | (F.col("before") != F.col("doc_id")), 1).otherwise(0))
        .withColumns({"holders": F.sum("first").over(whole), "top": F.max("doc_id").over(whole)})
    )

    # keys that continue in the next range: at most the two ends of every range
    ends = ranged.groupBy("rid").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high"))
    border = (
        ends.select("rid", F.explode(F.array_distinct(F.array("low", "high"))).alias("k"))
        .groupBy("k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    carried = (
        ranged.join(F.broadcast(border), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "rid", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", "rid").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        .groupBy("h1", "h2").agg(F.sum("n").alias("all_holders"), F.max("top").alias("all_top"))
    )
    dropped = seen.join(F.broadcast(carried), ["h1", "h2"], "left").where(
        (F.coalesce("all_holders", "holders") >= min_docs) & (F.col("doc_id") < F.coalesce("all_top", "top"))
    )
    return (
        dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        .select(
            "doc_id",
            "text_hash",
            F.size("at").cast("long").alias("n_dropped"),
            F.transform("at", lambda p, i: F.when(i == 0, p).otherwise(p - F.get("at", i - 1) - 1)).alias("keep_bitmap"),
        )
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the document as a struct), ``n_lines``, ``n_dropped`` and ``kept`` (the text of the kept lines)."""
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("_id"), F.xxhash64(f"row.`{text_col}`").alias("_hash")
    )
    right = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_text"), "n_dropped", "keep_bitmap")
    joined = left.join(right, (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    # kept runs spelled out as one flag a line: linear in the lines of the document
    flags = F.flatten(
        F.transform("keep_bitmap", lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False))))
    )
    kept = F.array_join(
        F.filter(split_lines(text), lambda line, i: F.coalesce(F.get(F.col("_flags"), i), F.lit(True))), "\n"
    )
    return (
        joined.withColumn("_flags", flags)
        .select(
            "row",
            F.size(split_lines(text)).cast("long").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("keep_bitmap").isNull(), text).otherwise(kept).alias("kept"),
        )
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """``row``, ``n_lines``, ``n_dropped`` and ``kept`` for every document."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **rules), id_col, text_col)
