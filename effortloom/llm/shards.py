"""Sharding by sampled splitters.

Records are ordered by a digest of their text and their id, so equal texts lie side by side. Splitters are quantiles of a
sample of that order in which a record is drawn with a chance proportional to its size; they cut the order into ranges
of about equal bytes. Ranges that turn out overfull are sampled again, more densely, and subdivided. Only small records -
id, size, digests - are shuffled, never texts. With the totals of the ranges every record's place in the whole order is
known from a running sum inside its own range, so shards come out equal to within one record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effortloom.llm.common import tasks
from effortloom.session import pin

SPLITTER = np.dtype([("key", np.int64), ("id", np.int64)])


def range_of(keys: np.ndarray, ids: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (sorted, distinct) at or before each (key, id)."""
    base = np.searchsorted(splitters["key"], keys, side="left")
    high = np.searchsorted(splitters["key"], keys, side="right")
    out = base.copy()
    shared = np.flatnonzero(high > base)  # a splitter has the same key: the id decides
    for low in np.unique(base[shared]):
        rows = shared[base[shared] == low]
        out[rows] += np.searchsorted(splitters["id"][low : high[rows[0]]], ids[rows], side="right")
    return out


def _ranged(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = range_of(batch["key"].to_numpy(), batch["order_id"].to_numpy(), splitters)
            yield batch.append_column("rid", pa.array(rid, pa.int64()))

    schema = ", ".join(f"{name} {kind}" for name, kind in records.dtypes)
    return records.mapInArrow(run, f"{schema}, rid bigint")


def _draw(records: DataFrame, per_byte, salt: int) -> list[tuple[int, int, int]]:
    """(rid, key, id) of a sample in which each row has the chance size * per_byte, decided by a digest of the row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(salt), "key", "order_id"), 11)) / F.lit(float(1 << 53))
    rows = records.where(u < F.col("size") * per_byte).select("rid", "key", "order_id").distinct().toArrow()
    return list(zip(*(rows[c].to_pylist() for c in ("rid", "key", "order_id")), strict=True))


def splitters(records: DataFrame, ranges: int, total: int, per_range: int = 32) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Splitters, and bytes and rows of every range (rid, bytes, rows). About ``per_range`` samples a range reach the
    driver: 16 bytes each, for one range in millions of rows."""
    found = np.zeros(0, dtype=SPLITTER)
    target = total / ranges
    sample = _draw(records.withColumn("rid", F.lit(0)), F.lit(per_range / target), 0)
    wanted = {0: ranges}
    salt = 0
    while True:
        new = []
        by_range: dict[int, list[tuple[int, int]]] = {}
        for rid, key, i in sample:
            by_range.setdefault(rid, []).append((key, i))
        for rid, pairs in by_range.items():
            pairs.sort()
            parts = min(wanted[rid], len(pairs) + 1)
            new += [pairs[len(pairs) * k // parts] for k in range(1, parts)]
        merged = np.unique(np.concatenate([found, np.array(new, dtype=SPLITTER)]))
        grown, found = len(merged) > len(found), merged
        ranged = _ranged(records, found)
        sums = [tuple(r) for r in ranged.groupBy("rid").agg(F.sum("size"), F.count(F.lit(1))).collect()]
        wanted = {rid: math.ceil(size / target) for rid, size, rows in sums if size > 2 * target and rows > 1}
        if not wanted or (salt and not grown):  # what is left are copies of one record
            return found, sums
        salt += 1
        chance = F.create_map(*[F.lit(x) for rid, size, _ in sums if rid in wanted for x in (rid, wanted[rid] * per_range * 2.0**salt / size)])
        sample = _draw(ranged.where(F.col("rid").isin(list(wanted))), chance[F.col("rid")], salt)


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    row_overhead: int = 8,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    ``size`` is the UTF-8 bytes of the text (NULL: none) plus ``row_overhead``. Shard sizes in bytes differ from their
    mean by less than the largest record; ``slot`` counts a shard's rows from 0 in their order. Equal texts are
    neighbours and share a shard unless a shard ends among them. A record larger than a shard's share may leave a shard
    empty. Rows without an id sort by their text alone; copies of a row are told apart by nothing and share out the
    places. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = pin(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + row_overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("order_id"),
        )
    )
    rows, total = records.agg(F.count(F.lit(1)), F.sum("size")).first()
    columns = ["doc_id", "size", "text_crc32"]
    if not rows:
        return records.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(4 * shards, math.ceil(rows / rows_per_range), tasks(docs.sparkSession))
    cuts, sums = splitters(records, min(ranges, rows), total)
    sums.sort()
    before = np.cumsum([(0, 0), *[(size, n) for _, size, n in sums]], axis=0)
    offsets = docs.sparkSession.createDataFrame(
        [(rid, int(b), int(n)) for (rid, _, _), (b, n) in zip(sums, before[:-1].tolist(), strict=True)], "rid long, bytes_before long, rows_before long"
    )
    order = Window.partitionBy("rid").orderBy("key", "order_id", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        _ranged(records, cuts)
        .withColumns({"running": F.sum("size").over(upto), "row": F.row_number().over(order)})
        .join(offsets, "rid")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("running")) - F.col("size"))
        # the shard in whose share of the bytes the middle of the record lies
        .withColumn("shard", F.expr(f"cast(middle * {shards} div {2 * total}L AS int)"))
        .select(*columns, "shard", (F.col("rows_before") + F.col("row") - 1).alias("place"))
    )
    placed = pin(placed)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(*columns, "shard", (F.col("place") - F.col("first")).alias("slot"))
