"""Exact duplicates by digest, with frequent digests split off.

A digest that a third of all rows share would put them into one task. So the frequent digests are
found first by a Misra-Gries summary (Spark's ``approx_top_k``: one bounded counter table per task,
merged), their exact counts and winners are computed with partial aggregation, and these few rows
are broadcast: the rows of a frequent digest are answered where they lie. Only the rest is shuffled.

Only the digests move, the texts are read once. Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import packed, step, text_or_empty, unpacked

#: Counters of the summary; every digest with more than about 1 / COUNTERS of all rows is found.
COUNTERS = 4096
#: So many of them are split off, which bounds the broadcast to HEAVY rows of some 150 bytes.
HEAVY = 1024

_NEEDS_CHANGE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """The text with every run of blanks, tabs and line ends as one blank; null is empty."""
    return F.regexp_replace(text_or_empty(text), _NEEDS_CHANGE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, place)`` per row; ``place`` orders rows that repeat an id. Written once."""
    return step(
        docs.select(
            F.col(id_col).alias("id"),
            F.sha2(normalised(text_col), 256).alias("digest"),
            F.monotonically_increasing_id().alias("place"),
        )
    )


def _winner() -> list[Column]:
    # Nulls come last: a null id stays only where no row of the group has an id.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("place")))
    return [first.alias("first"), F.count(F.lit(1)).alias("group_size")]


def membership(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    counters: int = COUNTERS,
    heavy: int = HEAVY,
) -> DataFrame:
    """``(id, keep_id, group_size, kept, digest)``, one row per row of ``docs``.

    Of equal texts the row with the smallest id is kept. Null texts equal empty ones. A null id
    loses against any other; of rows that repeat id and text exactly one is kept. An empty table
    gives no rows.
    """
    rows = digests(docs, id_col, text_col)
    # A literal, so it must be an SQL expression; both numbers are plain ints.
    summary = F.expr(f"approx_top_k(digest, {int(heavy)}, {int(counters)})")
    frequent = rows.agg(summary.alias("top")).select(F.explode("top.item").alias("digest"))
    # Verified: the summary only names candidates; counts and winners come from the rows.
    winners = step(
        rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*_winner())
    )
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(*_winner()).filter("group_size > 1")
    answered = rows.join(F.broadcast(winners), "digest").unionByName(
        light.join(groups, "digest", "left"), allowMissingColumns=True
    )
    alone = F.col("first").isNull()
    return answered.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("first.place") == F.col("place"))).alias("kept"),
        "digest",
    )


def _one_key() -> Column:
    named = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return F.concat_ws(":", F.col("id").isNull().cast("string"), named, "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``membership`` keeps, with all their columns."""
    rows = packed(docs, id_col, text_col).select(
        "row", "id", F.sha2(normalised("text"), 256).alias("digest")
    )
    kept = membership(docs, id_col, text_col).filter("kept").select(_one_key().alias("key"))
    found = rows.select("row", _one_key().alias("key")).join(kept, "key", "left_semi")
    # Rows that repeat id and text meet in one kept row; one of them goes on. Same shuffle.
    return unpacked(found.groupBy("key").agg(F.first("row").alias("row")))
