"""Monotone fits per key by pooling adjacent violators, in parallel.

Pooling two neighbouring blocks whose means are in the wrong order leads to the same fit in whatever order it is done, so
it may be done range by range: blocks are range-partitioned by key and predictor, every task pools inside its range with
a stack, and what violates the order across a border is met in the next round, where the borders lie elsewhere. Rounds
end when no border is violated. A key with a third of all rows is many ranges; nothing is gathered but the two outermost
blocks of every range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.operators.ordered import attach, ordered
from effortloom.session import pin

#: Points that a range holds, about.
POINTS_PER_RANGE = 500_000


def _ranges(df: DataFrame, parts: int, order: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _key(batch: pa.RecordBatch, keys: Sequence[str]) -> list[tuple]:
    return list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * batch.num_rows


def _pooled(blocks: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Blocks (keys, ``x``: smallest predictor, ``top``: largest, ``s``, ``w``) after pooling inside ranges, with ``part``,
    the number of the range."""
    keys = list(keys)
    kinds = blocks.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, stack = None, None, []
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = {k: [d[0][i] for d in done] for i, k in enumerate(keys)}
            columns = [pa.array(out[k], type=types[k]) for k in keys]
            columns += [pa.array([d[1][i] for d in done], pa.float64()) for i in range(4)]
            columns.append(pa.array([part] * len(done), pa.int32()))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "x", "top", "s", "w", "part"])

        types: dict[str, pa.DataType] = {}
        for batch in batches:
            types = {k: batch.schema.field(k).type for k in keys}
            numbers = [batch.column(c).to_pylist() for c in ("x", "top", "s", "w")]
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for key, x, top, s, w in zip(_key(batch, keys), *numbers, strict=True):
                if key != now:
                    done.extend((now, b) for b in stack)
                    now, stack = key, []
                block = [x, top, s, w]
                while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:  # mean of the left one is not smaller
                    left = stack.pop()
                    block = [left[0], block[1], left[2] + block[2], left[3] + block[3]]
                stack.append(block)
            if len(done) > 50_000:
                yield flush()
        done.extend((now, b) for b in stack)
        if done:
            yield flush()

    ranged = _ranges(blocks.select(*keys, "x", "top", "s", "w"), parts, [*keys, "x"]).withColumn("part", F.spark_partition_id())
    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields]
    return ranged.mapInArrow(run, ", ".join([*named, "x double, top double, s double, w double, part int"]))


def _settled(blocks: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no two neighbouring blocks of different ranges are in the wrong order: the outermost blocks of the ranges, two
    rows each, are compared in their order."""
    block = F.struct(*keys, "x", "s", "w")
    ends = blocks.groupBy("part").agg(F.min(block).alias("first"), F.max(block).alias("last")).orderBy("part").collect()
    for left, right in zip(ends, ends[1:], strict=False):
        a, b = left["last"], right["first"]
        if all(a[k] == b[k] for k in keys) and a["s"] * b["w"] >= b["s"] * a["w"]:
            return False
    return True


def isotonic_blocks(
    df: DataFrame, keys: Sequence[str], x: str, y: str, points_per_range: int = POINTS_PER_RANGE
) -> DataFrame:
    """Blocks of the non-decreasing least-squares fit of ``y`` on ``x`` per key: smallest and largest predictor ``x``, ``top``,
    ``s`` (sum of the targets) and ``w`` (rows); the fit is their ratio. Rows with a NULL or not-a-number in either take no
    part, and no two blocks of a key have the same fit."""
    keys = list(keys)
    at, value = F.col(x).cast("double"), F.col(y).cast("double")
    known = df.where(at.isNotNull() & value.isNotNull() & ~F.isnan(at) & ~F.isnan(value))
    points = pin(
        known.groupBy(*keys, at.alias("x")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).cast("double").alias("w")).withColumn("top", F.col("x"))
    )
    parts = max(1, -(-points.count() // points_per_range))
    blocks = pin(_pooled(points, keys, parts))
    rounds = 0
    while parts > 1 and not _settled(blocks, keys):
        rounds += 1
        left = -(-blocks.count() // points_per_range)
        # another number of ranges each round moves the borders; no pair of blocks is on a border of all of them
        parts = 1 if left <= 1 else left + rounds % (left + 1)
        blocks = pin(_pooled(blocks, keys, parts))
    return blocks.drop("part")


def isotonic(
    df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "predicted", points_per_range: int = POINTS_PER_RANGE
) -> DataFrame:
    """``df`` with the non-decreasing fit of ``y`` on ``x`` per key. A row without a target gets the fit of the block that its
    predictor lies in or behind; NULL where there is none or no predictor. Keys may be NULL."""
    keys = list(keys)
    blocks = isotonic_blocks(df, keys, x, y, points_per_range).select(*keys, "x", (F.col("s") / F.col("w")).alias("fit"))
    points = df.select(*keys, F.col(x).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").distinct()
    # blocks are numbered along with the points, so that a point finds its block by equality
    marked = points.withColumns({"fit": F.lit(None).cast("double"), "block": F.lit(0)}).unionByName(blocks.withColumn("block", F.lit(1)))
    placed = pin(ordered(marked.withColumn("point", 1 - F.col("block")), keys, ["x", "point"], running={"no": "block"}, rows_per_task=points_per_range))
    fits = placed.where("block = 1").select(*keys, "no", F.col("fit").alias(name))
    hats = attach(placed.where("block = 0").select(*keys, "no", F.col("x").alias("_x")), fits, [*keys, "no"], "left")
    return attach(df.withColumn("_x", F.col(x).cast("double")), hats.drop("no"), [*keys, "_x"], "left").drop("_x")
