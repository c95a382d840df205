"""Passages of a benchmark in documents, found by winnowing.

A window is ``window`` consecutive words of an item, or the whole of a shorter one. Of the k-word
hashes of a window the smallest is its fingerprint. A document keeps the smallest hash of every window
of that length, so a shared window is shared as a fingerprint too: with k-word hashes over w = window
- k + 1 places none is missed. Fingerprints that meet are extended to whole windows and compared
as texts, so a collision of hashes has no effect.

Documents are cut into overlapping pieces of ``PIECE`` words, so that arrays stay small in texts of
any length. Only documents with a hit are read a second time. All of it is built-in expressions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import doc_key, only_with, packed, step, text_or_empty, unpacked
from shelfmark.plans.sizing import broadcast_if_small

#: Words of a window.
WINDOW = 13
#: A document is contaminated from one hit word in so many.
ONE_IN = 20
#: Window starts in a piece of a document.
PIECE = 2048

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """ASCII letters lower-cased, then runs of digits, letters and everything beyond ASCII."""
    lowered = F.translate(text_or_empty(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _gram(length: int) -> int:
    return length // 2 + 1


def _smallest(length: int) -> Column:
    """Per window of ``length`` words in ``words``: its smallest k-word hash. Empty if it is shorter."""
    k = _gram(length)
    places = length - k + 1
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.xxhash64(F.slice("words", i, k))
    )
    found = hashes
    if places > 1:
        # Bound by a one-row lambda, so that the hashes are computed once per piece.
        found = F.flatten(
            F.transform(
                F.array(hashes),
                lambda h: F.transform(
                    F.sequence(F.lit(1), F.size(h) - places + 1),
                    lambda s: F.array_min(F.slice(h, s, places)),
                ),
            )
        )
    return F.when(F.size("words") >= length, found).otherwise(F.array().cast("array<bigint>"))


def _window_text(start: Column, length: Column | int) -> Column:
    return F.concat_ws(" ", F.slice("words", start, length))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, length, fingerprint, window)``, one row per distinct window of an item. Written once."""
    items = benchmark.select(F.col(item_col).alias("item"), words(text_col).alias("words"))
    items = items.filter("size(words) > 0").withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    k = F.floor(F.col("length") / 2).cast("int") + 1
    cut = F.explode(F.transform(starts, lambda s: F.slice("words", s, F.col("length"))))
    rows = items.select("item", "length", k.alias("k"), cut.alias("words"))
    smallest = F.array_min(
        F.transform(
            F.sequence(F.lit(1), F.col("length") - F.col("k") + 1),
            lambda i: F.xxhash64(F.slice("words", i, F.col("k"))),
        )
    )
    return step(
        rows.select(
            "item", "length", smallest.alias("fingerprint"), F.concat_ws(" ", "words").alias("window")
        ).distinct()
    )


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """``(doc, piece, words)``: overlapping pieces, every window start in one of them."""
    last = F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / PIECE).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda p: F.slice("words", p * PIECE + 1, PIECE + window - 1)
    )
    return rows.select("doc", F.posexplode(cut).alias("piece", "words"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``(id, doc, n_words, n_hit, spans, items)``, one row per row of ``docs``.

    ``spans`` are ``(start, length)`` of the windows found, from word 1 on; ``items`` the ids of their
    items as sorted strings; ``n_hit`` counts the words in any span. Null texts have no words, items
    without words and items without an id match nothing. Rows that repeat id and text get the same
    answer. An empty table on either side gives no hits.
    """
    benchmark = benchmark.filter(F.col(item_col).isNotNull())
    windows = item_windows(benchmark, item_col, item_text_col, window)
    # At most ``window`` different lengths, whatever the benchmark's size.
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    rows = packed(docs, id_col, text_col).select("id", doc_key().alias("doc"), words("text").alias("words"))
    counted = rows.select("id", "doc", F.size("words").cast("bigint").alias("n_words"))
    spans = windows.select(F.lit("").alias("doc"), F.lit(1).alias("start"), "length", "window").limit(0)
    if lengths:
        spans = _spans(rows, windows, lengths, window)
    spans = step(spans)
    per_item = only_items(spans, windows)
    per_doc = spans.groupBy("doc").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans")
    )
    found = per_doc.join(per_item, "doc")
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(1).alias("next"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["next"], s["start"] + s["length"]).alias("next"),
            (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["next"], s["start"]), F.lit(0)))
            .cast("bigint").alias("n"),
        ),
        lambda a: a["n"],
    )
    nothing = F.lit(0).cast("bigint")
    return counted.join(found, "doc", "left").select(
        "id", "doc", "n_words",
        F.when(F.col("spans").isNull(), nothing).otherwise(covered).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def only_items(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """``(doc, items)``: the ids of items with a window in the document, as sorted strings."""
    owners = windows.select("window", "item")
    met = spans.select("doc", "window").distinct().join(owners, "window").select("doc", "item").distinct()
    return met.groupBy("doc").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))


def _spans(rows: DataFrame, windows: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """``(doc, start, length, window)`` of every window that occurs."""
    prints = windows.select("fingerprint").distinct()
    kept = F.array_distinct(F.flatten(F.array(*(_smallest(m) for m in lengths))))
    offered = _pieces(rows, window).select("doc", "piece", F.explode(kept).alias("fingerprint"))
    hits = step(
        only_with(offered, prints, "fingerprint")
        .groupBy("doc", "piece")
        .agg(F.collect_set("fingerprint").alias("hits"))
    )
    again = _pieces(only_with(rows, hits.select("doc").distinct(), "doc"), window)
    extended = F.flatten(F.array(*(_extended(m) for m in lengths)))
    texts = again.join(hits, ["doc", "piece"]).select("doc", "piece", F.explode(extended).alias("w"))
    known = windows.select("window").distinct()
    small = broadcast_if_small(known)
    found = texts.select(
        "doc", (F.col("piece") * PIECE + F.col("w.start")).alias("start"), "w.length", "w.window"
    ).join(known if small is None else small, "window", "left_semi")
    return found.select("doc", "start", "length", "window").distinct()


def _extended(length: int) -> Column:
    """``(start, length, window)`` of the piece's windows whose fingerprint is among ``hits``."""
    starts = F.transform(
        _smallest(length),
        lambda h, i: F.when(
            (i < PIECE) & F.array_contains(F.col("hits"), h), (i + 1).cast("int")
        ),
    )
    return F.transform(
        F.filter(starts, lambda s: s.isNotNull()),
        lambda s: F.struct(
            s.alias("start"), F.lit(length).alias("length"), _window_text(s, length).alias("window")
        ),
    )


def contaminated(n_hit: Column, n_words: Column, one_in: int = ONE_IN) -> Column:
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, id_col, text_col, **more)
    bad = found.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select("doc").distinct()
    rows = packed(docs, id_col, text_col).select("row", doc_key().alias("doc"))
    return unpacked(only_with(rows, step(bad), "doc", "left_anti"))
