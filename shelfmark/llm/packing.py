"""Documents packed into sequences of a fixed number of tokens by the sum-of-squares rule.

Of the places where a piece fits, an open sequence of some gap or a new one, it goes where the sum
of the squared counts of open sequences per gap becomes smallest; of equal ones to the smallest gap.
Pieces are dealt to blocks by a hash, and every block packs its own, the longest first, so tasks stay
alike at any size. What a block leaves less than half full meets the leftovers of other blocks in a
second round, where these sequences are the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import portions, step
from shelfmark.llm.tokens import encoder

#: Tokens of a sequence.
CAPACITY = 4096
#: Pieces in a block, on average.
BLOCK = 2048


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin, in the order given."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)  # by gap; gaps 0 and capacity are never open
    fills: list[int] = []
    for i, size in enumerate(map(int, lengths)):
        gap = capacity
        if size < capacity:
            gaps = np.flatnonzero(counts[size:capacity]) + size
            if len(gaps):
                # (n - 1)^2 - n^2 where it goes from, (n + 1)^2 - n^2 where it comes to.
                change = 1 - 2 * counts[gaps]
                change += np.where(gaps > size, 1 + 2 * counts[gaps - size], 0)
                best = int(np.argmin(change))
                if change[best] <= 1 + 2 * counts[capacity - size]:
                    gap = int(gaps[best])
        if gap == capacity:
            bins[i], offsets[i] = len(fills), 0
            fills.append(size)
        else:
            counts[gap] -= 1
            bins[i], offsets[i] = open_bins[gap].pop(), capacity - gap
            fills[bins[i]] += size
        left = gap - size
        if left:
            counts[left] += 1
            open_bins[left].append(int(bins[i]))
    return bins, offsets, np.array(fills, np.int64)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """``(id, row, piece, start, length, ids)``: every document's ids, then ``end_id``, cut where they
    are longer than ``capacity``. ``ids`` are little-endian unsigned 32-bit integers, ``row`` is a
    number of the document's row. Written once."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    schema = f"id {id_type}, row long, piece int, start long, length long, ids binary"

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in portions(batches):
            place, number, ids = [], [], []
            for i, text in enumerate(batch["text"]):
                tokens = encode(text.as_py()) + end
                cut = [tokens[a : a + 4 * capacity] for a in range(0, len(tokens), 4 * capacity)]
                place += [i] * len(cut)
                number += range(len(cut))
                ids += cut
            numbers = np.array(number, np.int32)
            columns = [
                batch["id"].take(pa.array(place, pa.int64())),
                batch["row"].take(pa.array(place, pa.int64())),
                pa.array(numbers),
                pa.array(numbers.astype(np.int64) * capacity),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "row", "piece", "start", "length", "ids"]
            )
        # The process stays for later stages, and so would a few hundred MB on each executor.
        encode.forget()
        pa.default_memory_pool().release_unused()

    return step(rows.mapInArrow(per_batch, schema))


def _packed(units: DataFrame, count: int, capacity: int) -> DataFrame:
    """``(row, piece, bin, offset, fill)`` of ``(row, piece, size)``, packed block by block."""
    blocks = max(1, round(count / BLOCK))

    def per_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "row", "piece"], ascending=[False, True, True])
        bins, offsets, fills = sum_of_squares(frame["size"].to_numpy(), capacity)
        first = int(frame["block"].iloc[0]) << 32
        return pd.DataFrame(
            {
                "row": frame["row"], "piece": frame["piece"], "bin": first + bins,
                "offset": offsets, "fill": fills[bins],
            }
        )

    dealt = units.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(
        per_block, "row long, piece int, bin long, offset long, fill long"
    )


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(row, piece, sequence_id, offset)`` for every one of ``pieces``."""
    units = found.select("row", "piece", F.col("length").alias("size"))
    first = step(_packed(units, units.count(), capacity))
    loose = first.filter(F.col("fill") * 2 <= capacity).select(
        F.col("bin").alias("row"), F.lit(0).alias("piece"), F.col("fill").alias("size")
    ).distinct()
    second = _packed(loose, loose.count(), capacity).select(
        F.col("row").alias("bin"),
        # Sequences of the second round are numbered below zero.
        (-1 - F.col("bin")).alias("merged"), F.col("offset").alias("base"),
    )
    return first.join(second, "bin", "left").select(
        "row", "piece", F.coalesce("merged", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0).cast("bigint"))).alias("offset"),
    )


def packed_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """``(id, row, piece, start, length, ids, sequence_id, offset)``, one row per piece.

    Null texts equal empty ones and are the end id alone. Rows without an id and repeated rows are
    packed like any other, once each; ``row`` tells them apart. An empty table gives no rows.
    """
    found = pieces(docs, tokenizer, end_id, id_col, text_col, capacity)
    return found.join(pack(found, capacity), ["row", "piece"])
