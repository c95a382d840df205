"""Debouncing: of the changes of a path that follow each other within ``delay``, keep the last.

The batch form never sorts a whole path in one task. Changes of one path within one ``delay``-wide
time cell belong together whatever else happens, so they are merged first, by a partial
aggregation. Cells are joined into sessions inside blocks of 4,096 cells, and only the sessions at
a block's border are looked at per path.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.plans.storage import reliable

DEFAULT_DELAY = timedelta(milliseconds=100)
CELLS_PER_BLOCK = 4_096
DETAILS = ["seq", "op", "size", "modified_time", "is_dir"]


def micros(delay: timedelta) -> int:
    return delay // timedelta(microseconds=1)


def _floor_div(value: Column, width: int) -> Column:
    """Whole-number division that rounds down, also before 1970."""
    return F.floor((value - F.pmod(value, F.lit(width).cast("bigint"))) / width).cast("bigint")


def _details(changes: DataFrame) -> list[str]:
    return [c for c in DETAILS if c in changes.columns]


def _sessions(df: DataFrame, keys: list[str], delay: int) -> DataFrame:
    """Join neighbouring spans ``first .. last.ts`` of a group unless they are more than the
    delay apart; spans of a group do not overlap."""
    ordered = W.partitionBy(*keys).orderBy("first")
    gap = F.col("first") - F.lag(F.unix_micros("last.ts")).over(ordered)
    return (
        df.withColumn("begins", F.coalesce((gap > delay).cast("int"), F.lit(0)))
        .withColumn("session", F.sum("begins").over(ordered))
        .groupBy(*keys, "session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("session")
    )


def debounce(changes: DataFrame, delay: timedelta = DEFAULT_DELAY) -> DataFrame:
    """Settled changes of a batch: one row per session with its last change, and its end
    (``settled_at``, the last change's time plus ``delay``)."""
    width = micros(delay)
    details = _details(changes)
    stamped = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    cells = (
        stamped.withColumn("first", F.unix_micros("ts"))
        .groupBy("path", _floor_div(F.col("first"), width).alias("cell"))
        .agg(F.min("first").alias("first"), F.max(F.struct("ts", *details)).alias("last"))
        .withColumn("block", _floor_div(F.col("cell"), CELLS_PER_BLOCK))
        .drop("cell")
    )
    inner = _sessions(cells, ["path", "block"], width)
    start = F.col("block") * (CELLS_PER_BLOCK * width)
    touches_start = F.col("first") - start <= width
    touches_end = start + CELLS_PER_BLOCK * width - F.unix_micros("last.ts") <= width
    # Written once: both kinds of sessions are taken from it.
    marked = reliable(inner.withColumn("border", touches_start | touches_end).drop("block"))
    across = _sessions(marked.filter("border").drop("border"), ["path"], width)
    whole = marked.filter(~F.col("border")).drop("border").unionByName(across)
    return whole.select("path", "last.*").withColumn("settled_at", _plus(F.col("ts"), delay))


def _plus(ts: Column, delay: timedelta) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros(delay))


def debounce_stream(
    changes: DataFrame, lateness: timedelta, delay: timedelta = DEFAULT_DELAY
) -> DataFrame:
    """The same as a stream, by session windows: a session comes out once the watermark (newest
    time seen less ``lateness``) has passed its end.

    What has come out cannot be taken back, so a change that comes later than that is dropped; choose
    ``lateness`` accordingly, or use ``maintain_catalog``, which keeps every change.
    """
    details = _details(changes)
    stamped = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    window = F.session_window("ts", f"{micros(delay)} microseconds")
    sessions = (
        stamped.withWatermark("ts", f"{micros(lateness)} microseconds")
        .groupBy("path", window.alias("window"))
        .agg(F.max(F.struct("ts", *details)).alias("last"))
    )
    return sessions.select("path", "last.*", F.col("window.end").alias("settled_at"))


def _tail(changes: DataFrame, delay: timedelta, as_of: datetime) -> DataFrame:
    """Changes whose timer runs at ``as_of``: a time range, so the scan can skip the rest."""
    return changes.filter((F.col("ts") > F.lit(as_of - delay)) & (F.col("ts") <= F.lit(as_of)))


def pending(changes: DataFrame, delay: timedelta, as_of: datetime) -> DataFrame:
    """Number of paths with a change that has not settled at ``as_of``."""
    waiting = _tail(changes, delay, as_of).select("path").distinct()
    return waiting.agg(F.count(F.lit(1)).alias("pending"))


def flush(changes: DataFrame, delay: timedelta, as_of: datetime) -> DataFrame:
    """The unsettled changes themselves, one per path, with the type they really have."""
    last = F.max(F.struct("ts", *_details(changes))).alias("last")
    return _tail(changes, delay, as_of).groupBy("path").agg(last).select("path", "last.*")


def discard_pending(changes: DataFrame, delay: timedelta, as_of: datetime) -> DataFrame:
    """What has settled at ``as_of``; the rest is dropped."""
    seen = changes.filter(F.col("ts") <= F.lit(as_of))
    return debounce(seen, delay).filter(F.col("settled_at") <= F.lit(as_of))
