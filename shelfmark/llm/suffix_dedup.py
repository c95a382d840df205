"""Byte strings of a minimum length that occur more than once, removed wherever they occur.

The starts of a text are dealt out by content: the window that begins at a start has an anchor
(``anchors``), and neighbouring starts with the same one make a segment of bytes. Only segments whose
anchor occurs more than once go on. Equal segments become one with a count, which answers copies.

Segments that differ are halved by how far their windows begin before the anchor. All windows of a half
contain the same stretch around the anchor, and the half's key is a hash of it: equal windows meet under
one key, and keys that occur once drop out. Where a key still has more than ``CROWD`` different pieces
its pieces are halved again, around a longer stretch, down to single windows. A passage in many documents
splits only at its two ends, so a segment makes at most a few pieces a round, and there are as many rounds
as a window's starts can be halved. The pieces of a key meet in blocks of about ``BLOCK_BYTES``, where
``bwt.repeated_starts`` compares them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.anchors import anchor_places, mixed, runs
from shelfmark.llm.bwt import repeated_starts
from shelfmark.llm.common import only_with, step, text_or_empty

#: Bytes of a string that must not occur twice.
LENGTH = 400
#: Fewest bytes of the grams among which anchors are chosen.
GRAM = 16
#: Bytes of a block, on average, and different pieces of one key that a block may hold.
BLOCK_BYTES, CROWD = 1 << 20, 512


def _gram_bytes(length: int) -> int:
    """Bytes of a gram: long ones seldom repeat by chance, short ones make longer runs."""
    size = GRAM
    while 12 * size <= length:
        size *= 2
    return size


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on; ``size`` is 16 times a power of two.

    Rows of a table of bytes are hashed each on its own.
    """
    wide = data.astype(np.uint64)
    for width in (1, 2, 4):
        wide = wide[..., :-width] | wide[..., width:] << np.uint64(8 * width)
    done = 8
    while done < size:
        wide = mixed(wide[..., :-done] * np.uint64(0x9E3779B97F4A7C15) + mixed(wide[..., done:]))
        done *= 2
    return wide


def _anchors_of(segments: list[bytes], length: int) -> np.ndarray:
    """Where in each segment its anchor begins."""
    size, places = _gram_bytes(length), [np.zeros(0, np.int64)]
    for at in range(0, len(segments), 1000):
        part = segments[at : at + 1000]
        windows = np.frombuffer(b"".join(s[:length] for s in part), np.uint8).reshape(len(part), length)
        places.append(anchor_places(_gram_hashes(windows, size)))
    return np.concatenate(places)


def segments_of(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """``(hash, first start, starts)`` of the text's segments, in order; every start is in one."""
    if len(text) < length:
        return
    size, step_size = _gram_bytes(length), 1 << 22
    # Hashes of a very long text are made in slices.
    for at in range(0, len(text) - length + 1, step_size):
        data = np.frombuffer(text, np.uint8)[at : at + step_size + length - 1]
        for hashes, first, sizes in runs(_gram_hashes(data, size), length - size + 1):
            yield from zip(hashes.tolist(), (first + at).tolist(), sizes.tolist())


def text_key(text: str | Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text_or_empty(text), 256)), 1, 16)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """``(t, hash, lo, n, seg)``: the segments of every text, ``seg`` a hash of their bytes."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            place, hashes, lows, sizes, digests = [], [], [], [], []
            for i, value in enumerate(batch["text"]):
                text = _encoded(value.as_py())
                for found, lo, n in segments_of(text, length):
                    place.append(i)
                    hashes.append(found)
                    lows.append(lo)
                    sizes.append(n)
                    digests.append(xxh3_64_intdigest(text[lo : lo + n + length - 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["t"].take(pa.array(place, pa.int64())), pa.array(hashes, pa.int64()),
                    pa.array(lows, pa.int32()), pa.array(sizes, pa.int32()),
                    pa.array(np.array(digests, np.uint64).astype(np.int64)),
                ],
                ["t", "hash", "lo", "n", "seg"],
            )

    return texts.mapInArrow(per_batch, "t binary, hash long, lo int, n int, seg long")


def _cut(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(hash, seg, m, p, bytes)``: the bytes of the wanted segments, ``p`` where the anchor begins.

    Written once.
    """
    per_text = wanted.groupBy("t").agg(F.collect_list(F.struct("lo", "n", "hash", "seg", "m")).alias("cuts"))
    few = only_with(texts, wanted.select("t").distinct(), "t")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, cuts in zip(batch["text"], batch["cuts"]):
                text = _encoded(value.as_py())
                for c in cuts.as_py():
                    body = text[c["lo"] : c["lo"] + c["n"] + length - 1]
                    rows.append((c["hash"], c["seg"], c["m"], body))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [list(c) for c in zip(*rows)] if rows else [[]] * 4
            *known, bodies = [pa.array(c, k) for c, k in zip(columns, kinds)]
            places = pa.array(_anchors_of(columns[3], length), pa.int32())
            yield pa.RecordBatch.from_arrays([*known, places, bodies], ["hash", "seg", "m", "p", "bytes"])

    met = few.join(per_text, "t").select("text", "cuts")
    schema = "hash long, seg long, m long, p int, bytes binary"
    return step(met.mapInArrow(per_batch, schema), compression="zstd")


def _halves(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """``(hash, seg, m, p, a, n, c, key, piece)``: every piece cut into cells of ``width`` starts.

    ``a`` is the first of ``n`` starts and ``p`` the anchor, in the segment; the cell's starts are ``c`` and
    more bytes before the anchor. ``key`` is a hash of what all windows of the cell contain, ``piece``
    one of the piece's bytes. Written once.
    """
    farthest = length - _gram_bytes(length)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            place, columns = [], [[] for _ in range(5)]
            numbers = (batch[c].to_numpy().tolist() for c in ("p", "a", "n", "c"))
            for i, (p, a, n, c, value) in enumerate(zip(*numbers, batch["bytes"])):
                body = value.as_py()
                least, most = p - a - n + 1, p - a
                for cell in range(c + (least - c) // width * width, most + 1, width):
                    last = min(cell + width - 1, farthest)
                    low, high = max(least, cell), min(most, last)
                    start, size = most - high, high - low + 1
                    shared = body[most - cell : most - last + length]
                    piece = body[start : start + size + length - 1]
                    place.append(i)
                    row = a + start, size, cell, xxh3_64_intdigest(shared, cell << 32 | width), xxh3_64_intdigest(piece)
                    for column, found in zip(columns, row):
                        column.append(found)
            own = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c].take(own) for c in ("hash", "seg", "m", "p")),
                    *(pa.array(c, pa.int32()) for c in columns[:3]),
                    *(pa.array(np.array(c, np.uint64).astype(np.int64)) for c in columns[3:]),
                ],
                ["hash", "seg", "m", "p", "a", "n", "c", "key", "piece"],
            )

    schema = "hash long, seg long, m long, p int, a int, n int, c int, key long, piece long"
    return step(pieces.mapInArrow(per_batch, schema))


def _by_transform(pieces: DataFrame, blocks: int, length: int) -> DataFrame:
    """``(hash, seg, a, b)``: runs of repeated starts in pieces that occur once."""

    def per_block(frame: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(frame["bytes"].tolist(), length)
        rows = []
        for row_hash, seg, m, at, again in zip(frame["hash"], frame["seg"], frame["m"], frame["a"], found):
            if m == 1:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]])))
                rows += [(row_hash, seg, at + a, at + b) for a, b in edges.reshape(-1, 2)]
        return pd.DataFrame(rows, columns=["hash", "seg", "a", "b"])

    dealt = pieces.select("hash", "seg", "m", "a", "bytes", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInPandas(per_block, "hash long, seg long, a int, b int")


def _repeated_runs(cut: DataFrame, length: int, crowd: int) -> DataFrame:
    """``(hash, seg, a, b)``: runs of repeated starts in the segments that occur once."""
    settled, dealt = [], []
    pieces = cut.withColumns({
        "a": F.lit(0), "n": (F.octet_length("bytes") - (length - 1)).cast("int"), "c": F.lit(0)
    })
    width = length - _gram_bytes(length) + 1
    while True:
        width = (width + 1) // 2
        halves = _halves(pieces, length, width)
        kinds = step(
            halves.groupBy("key", "piece").agg(
                F.sum("m").alias("times"), F.min(F.struct("hash", "seg", "p", "a", "n", "c")).alias("first")
            )
        )
        # Equal pieces answer each other.
        equal = kinds.filter("times > 1").select("key", "piece")
        settled.append(
            halves.filter("m = 1").join(equal, ["key", "piece"], "left_semi").select(
                "hash", "seg", "a", (F.col("a") + F.col("n")).alias("b")
            )
        )
        # Written, so that the join stands right on its shuffles and a hot key can be split.
        several = step(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
        differing = step(
            kinds.join(several, "key").select("key", "kinds", F.col("times").alias("m"), "first.*")
        )
        body = F.expr(f"substring(bytes, a + 1, n + {length - 1})").alias("bytes")
        bodies = cut.select("hash", "seg", "bytes")
        met = differing.join(bodies, ["hash", "seg"]).select(*differing.columns, body)
        # A single window cannot be halved; those under one key are equal but for collisions.
        limit = crowd if width > 1 else 1 << 62
        dealt.append(met.filter(F.col("kinds") <= limit))
        crowded = differing.filter(F.col("kinds") > limit)
        if crowded.isEmpty():
            break
        pieces = met.filter(F.col("kinds") > limit)
    pieces = step(reduce(DataFrame.unionByName, dealt), compression="zstd")
    total = pieces.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0
    compared = _by_transform(pieces, max(1, round(total / BLOCK_BYTES)), length)
    return reduce(DataFrame.unionByName, settled, compared)


def repeated_spans(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD
) -> DataFrame:
    """``(t, whole, spans)`` of every text with a byte to remove; ``t`` is its ``text_key``.

    ``whole`` marks texts that occur more than once and have ``length`` bytes; their spans may be
    missing. The others have spans ``(start, end)``, which may overlap. Written once.
    """
    if length < GRAM:
        raise ValueError(f"shorter than the {GRAM} bytes of an anchor")
    rows = docs.select(text_key(text_col).alias("t"), F.col(text_col).alias("text"))
    rows = rows.withColumn("bytes", F.octet_length(text_or_empty("text"))).filter(F.col("bytes") >= length)
    copies = step(
        rows.groupBy("t").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("t")
    )
    # One row stands for all copies of a text; a text that occurs once stands for itself.
    once = only_with(rows, copies, "t", "left_anti").select("t", "text")
    several = only_with(rows, copies, "t").groupBy("t").agg(F.first("text").alias("text"))
    texts = once.unionByName(several)
    segments = step(_segments(texts, length))
    # Written, so that the join below stands right on its shuffles and a hot anchor can be split.
    repeated = step(
        segments.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash")
    )
    candidates = step(segments.join(repeated, "hash", "left_semi"))
    kinds = step(
        candidates.groupBy("hash", "seg").agg(
            F.count(F.lit(1)).alias("m"), F.min(F.struct("t", "lo", "n")).alias("first")
        )
    )
    sizes = step(
        kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("hash")
    )
    mixed = step(kinds.join(sizes, "hash").select("hash", "seg", "m", "first.*"))
    single = _repeated_runs(_cut(texts, mixed, length), length, crowd)
    # A segment that occurs once lies where its kind was first seen.
    single = single.join(mixed.filter("m = 1").select("hash", "seg", "t", "lo"), ["hash", "seg"]).select(
        "t", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + length - 1).alias("end")
    )
    often = candidates.join(kinds.filter("m > 1").select("hash", "seg"), ["hash", "seg"], "left_semi")
    often = often.select("t", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + length - 1).alias("end"))
    spans = single.unionByName(often).groupBy("t").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")
    )
    whole = copies.withColumn("whole", F.lit(True))
    return step(
        spans.join(whole, "t", "full").select("t", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    crowd: int = CROWD,
) -> DataFrame:
    """``(id, n_bytes, spans, kept)``, one row per row of ``docs``.

    Every byte goes that is covered by a ``length``-byte string which starts anywhere else too, in
    this text or another; ``spans`` are the maximal removed ranges of UTF-8 bytes, ``kept`` the other
    bytes (a cut may fall inside a character). Null texts are empty and shorter texts stay whole. Rows
    that repeat id and text are copies like any others. An empty table gives no rows.
    """
    marks = repeated_spans(docs, text_col, length, crowd)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("t", text_key("text")).join(marks, "t", "left")
    id_type = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, bodies = [], [], []
            for value, whole, marked in zip(batch["text"], batch["whole"], batch["spans"]):
                text = _encoded(value.as_py())
                merged: list[dict] = []
                if whole.as_py():
                    merged = [{"start": 0, "end": len(text)}]
                else:
                    for s in sorted(marked.as_py() or (), key=lambda s: s["start"]):
                        if merged and s["start"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                        else:
                            merged.append(dict(s))
                edges = [0, *(e for s in merged for e in (s["start"], s["end"])), len(text)]
                sizes.append(len(text))
                spans.append(merged)
                bodies.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(bodies, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )

    schema = f"id {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    return rows.select("id", "text", "whole", "spans").mapInArrow(per_batch, schema)
