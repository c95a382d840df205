"""Repeated windows of words: only the first occurrence stays.

Every window of ``WINDOW`` words gets a Rabin-Karp hash, a polynomial over the hashes of its words,
and Spark counts the hashes and finds where each one starts first. Windows that start earlier elsewhere
merge into maximal intervals, which are removed.

Two things keep this from moving every window. Texts with the same words are one: all copies but the
first go as a whole. And windows whose anchor (``anchors``) occurs once cannot repeat; of the
others, about one in ten, all are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.anchors import mixed, runs
from shelfmark.llm.common import doc_key, only_with, step, text_or_empty
from shelfmark.plans.sizing import broadcast_if_small

#: Words of a window.
WINDOW = 20
# Odd factors of the two polynomials.
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but blanks, tabs and line ends, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, window: int, factor: int) -> np.ndarray:
    """The polynomial over each ``window`` of consecutive values, modulo 2 ** 64."""
    total, covered = np.zeros(max(0, len(hashes) - window + 1), np.uint64), 0
    power, part, size = factor, hashes, 1
    while covered < window:
        if window & size:
            # What is covered so far moves up, the next ``size`` values come behind.
            shift = np.uint64(pow(factor, size, 1 << 64))
            total = total * shift + part[covered : covered + len(total)]
            covered += size
        if 2 * size <= window:
            part = part[:-size] * np.uint64(power) + part[size:] if len(part) > size else part[:0]
            power = power * power % (1 << 64)
        size *= 2
    return total


def _gram_words(window: int) -> int:
    size = 1
    while 5 * size <= window:
        size *= 2
    return size


def _same_words() -> Column:
    """128 bits that are equal for texts with the same words."""
    one = F.trim(F.regexp_replace(text_or_empty("text"), _BLANKS, " "))
    return F.substring(F.unhex(F.sha2(one, 256)), 1, 16)


def _runs_per_text(texts: DataFrame, window: int) -> DataFrame:
    """``(place, no_id, id, doc, hash, lo, n)``, the runs of every text as arrays. Written once."""
    kept = texts.select(
        F.monotonically_increasing_id().alias("place"), F.col("id").isNull().alias("no_id"), "id", "doc",
        "text",
    )
    gram = _gram_words(window)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays: list[list] = [[], [], []]
            for text in batch["text"]:
                hashes = word_hashes(words_of(text.as_py()))
                found = [(hashes[:0].astype(np.int64),) * 3]
                if len(hashes) >= window:
                    grams = mixed(window_hashes(hashes, gram, _FACTORS[0]))
                    found = list(runs(grams, window - gram + 1))
                for to, column in zip(arrays, zip(*found)):
                    to.append(np.concatenate(column))
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in ("place", "no_id", "id", "doc")),
                    *(pa.array(a, pa.list_(k)) for a, k in zip(arrays, kinds)),
                ],
                ["place", "no_id", "id", "doc", "hash", "lo", "n"],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    schema = (
        f"place long, no_id boolean, id {id_type}, doc string, "
        "hash array<long>, lo array<int>, n array<int>"
    )
    return step(kept.mapInArrow(per_batch, schema), compression="zstd")


def _windows(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``(place, no_id, id, start, h, g)``: both hashes of the windows of the wanted runs. Written once."""
    few = only_with(texts.select("doc", "text"), wanted.select("doc"), "doc")
    met = few.join(wanted, "doc").select("place", "no_id", "id", "text", "lo", "n")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, starts, first, second = [], [], [], []
            for i, (text, los, sizes) in enumerate(zip(batch["text"], batch["lo"], batch["n"])):
                hashes = word_hashes(words_of(text.as_py()))
                n = np.array(sizes.as_py())
                own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(los.as_py(), n)
                place.append(np.full(len(own), i))
                starts.append(own)
                first.append(window_hashes(hashes, window, _FACTORS[0])[own])
                second.append(window_hashes(hashes, window, _FACTORS[1])[own])
            if not starts:
                continue
            at = pa.array(np.concatenate(place))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c].take(at) for c in ("place", "no_id", "id")),
                    pa.array(np.concatenate(starts).astype(np.int32)),
                    pa.array(np.concatenate(first).astype(np.int64)),
                    pa.array(np.concatenate(second).astype(np.int64)),
                ],
                ["place", "no_id", "id", "start", "h", "g"],
            )

    id_type = met.schema["id"].dataType.simpleString()
    schema = f"place long, no_id boolean, id {id_type}, start int, h long, g long"
    return step(met.mapInArrow(per_batch, schema), compression="zstd")


def _intervals(starts: Column, window: int) -> Column:
    """Sorted starts of windows as maximal ``(start, end)`` of covered words, end exclusive."""
    begins = F.filter(starts, lambda x, i: (i == 0) | (F.get(starts, i - 1) + window < x))
    ends = F.filter(
        starts, lambda x, i: (i == F.size(starts) - 1) | (x + window < F.get(starts, i + 1))
    )
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + window).alias("end")))


def repeated_intervals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``(doc, whole, spans)`` of every document that loses words; ``doc`` is its ``doc_key``.

    ``whole`` marks later copies, which lose all words; the others have spans ``(start, end)`` of words.
    Written once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", doc_key().alias("doc"), _same_words().alias("t"), "text")
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"))
    groups = rows.groupBy("t").agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first"))
    copies = step(groups.filter("times > 1").select("t", F.col("first.id").alias("first_id")))
    few = broadcast_if_small(copies)
    marked = rows.join((copies if few is None else few).withColumn("copied", F.lit(True)), "t", "left")
    is_first = F.col("copied").isNull() | F.col("id").eqNullSafe(F.col("first_id"))
    texts = marked.filter(is_first).select("id", "doc", "text")
    per_text = _runs_per_text(texts, window)
    found = per_text.select(
        "place", F.explode(F.arrays_zip("hash", "lo", "n")).alias("r")
    ).select("place", "r.*")
    # Written, so that the join below stands right on its shuffles and a hot anchor can be split.
    repeated = step(
        found.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash")
    )
    candidates = found.join(repeated, "hash", "left_semi").groupBy("place").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n")
    )
    wanted = step(per_text.select("place", "no_id", "id", "doc").join(candidates, "place"))
    # Rows that repeat id and text are one document. Their equal windows change nothing below, where
    # only a smaller place counts.
    wanted_once = wanted.dropDuplicates(["doc"])
    windows = _windows(texts, wanted_once, window)
    at = F.struct("no_id", "id", "start")
    firsts = windows.groupBy("h", "g").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    later = windows.join(firsts.select("h", "g", "first"), ["h", "g"]).filter(at > F.col("first"))
    merged = later.groupBy("place").agg(F.array_sort(F.collect_list("start")).alias("starts")).select(
        "place", _intervals(F.col("starts"), window).alias("spans")
    )
    spans = merged.join(wanted_once.select("place", "doc"), "place").select(
        "doc", F.lit(False).alias("whole"), "spans"
    )
    gone = marked.filter(~is_first).select("doc").distinct().select(
        "doc", F.lit(True).alias("whole"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    )
    return step(spans.unionByName(gone))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``(id, n_words, spans, kept)``, one row per row of ``docs``.

    A word goes if a window over it starts earlier too: in a document with a smaller id, or further
    up in this one. ``spans`` are maximal intervals of words, ``kept`` the other words joined by one
    blank. Null texts have no words. Documents without an id come after all others, as one; rows that
    share an id are one document and judged by the start alone, so repeated rows get the same answer.
    Documents of fewer words than a window stay whole. An empty table gives no rows.
    """
    marks = repeated_intervals(docs, id_col, text_col, window)
    few = broadcast_if_small(marks)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("doc", doc_key()).join(marks if few is None else few, "doc", "left")
    id_type = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, texts = [], [], []
            for text, whole, marked in zip(batch["text"], batch["whole"], batch["spans"]):
                words = words_of(text.as_py())
                gone = marked.as_py() or []
                if whole.as_py() and len(words) >= window:
                    gone = [{"start": 0, "end": len(words)}]
                edges = [0, *(e for s in gone for e in (s["start"], s["end"])), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                sizes.append(len(words))
                spans.append(gone)
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(texts, pa.string())],
                ["id", "n_words", "spans", "kept"],
            )

    schema = f"id {id_type}, n_words long, spans array<struct<start:int,end:int>>, kept string"
    return rows.select("id", "text", "whole", "spans").mapInArrow(per_batch, schema)
