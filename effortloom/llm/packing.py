"""Sum-of-squares packing of token sequences.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to groups by a hash, about ``group_rows`` to a
group however large the table, and every group is packed on its own: a piece goes to the open sequence for which the sum
over all gaps of the squared number of open sequences with that gap becomes smallest. Large pieces come first and a
sequence is opened only when none has room, which wastes least; a group then ends with a few open sequences, so the
waste is a few sequences in ``group_rows`` pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortloom.llm.common import pin_python
from effortloom.llm.encode import Encoder

PIECE_COLUMNS = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Every document's ids followed by ``end_id``, cut after each ``capacity`` tokens.

    A NULL or empty text is the end token alone. Rows with equal ids each give their own pieces.
    """
    closing = np.asarray([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        for batch in batches:
            columns: list[list[int]] = [[], [], [], [], []]
            for doc, tokens in zip(batch.column(0).to_pylist(), encoder.packed(batch.column(1)), strict=True):
                tokens += closing
                for piece, begin in enumerate(range(0, len(tokens), step)):
                    part = tokens[begin : begin + step]
                    for column, value in zip(
                        columns, (doc, piece, begin // 4, len(part) // 4, zlib.crc32(part)), strict=True
                    ):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE_COLUMNS)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size, in the given order. Sizes are 1 to ``capacity``.

    Moving a bin from gap g to gap g - s changes the sum by 2 (N[g-s] - N[g]) + 2, closing it by 1 - 2 N[g]. The gap
    with the smallest change is taken, the smaller gap on ties, and in it the bin opened last.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    opened, none = 0, np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        gap = capacity
        if s < capacity:
            old = counts[s:capacity]
            change = np.where(old > 0, 2 * (counts[: capacity - s] - old) + 2, none)
            if old[0]:
                change[0] = 1 - 2 * old[0]
            best = int(change.argmin())
            if change[best] != none:
                gap = s + best
        if gap == capacity:
            b, opened = opened, opened + 1
        else:
            b = bins_of[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            bins_of[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_rows: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``. Offsets have no gaps."""
    kept = pin_python(pieces.withColumn("_salt", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(kept.count() / group_rows))
    # the salt spreads equal rows; it is stable because it is written
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "_salt"), F.lit(groups))).drop("_salt")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        by = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(by)
        bins, offsets = sum_of_squares(table["length"].to_numpy(), capacity)
        places = {"sequence_id": pa.array(bins + key[0].as_py() * 2**32), "offset": pa.array(offsets)}
        table = table.drop_columns("_group")
        for name, values in places.items():
            table = table.append_column(name, values)
        return table

    return dealt.groupBy("_group").applyInArrow(pack, f"{PIECE_COLUMNS}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
    group_rows: int = 100_000,
) -> DataFrame:
    """Pieces of all documents with their places. An empty table gives an empty result."""
    return pack_pieces(token_pieces(docs, id_col, text_col, capacity, tokenizer, end_id), capacity, group_rows)
