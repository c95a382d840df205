"""Catalog statistics. All are partial aggregations on the map side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.operators.prefixes import with_prefixes
from shelfmark.operators.search import search_prefix
from shelfmark.plans.sizing import BROADCAST_BYTES, broadcast_if_small
from shelfmark.plans.storage import reliable


def _total(size) -> Column:
    return F.coalesce(F.sum(size), F.lit(0)).alias("total_size")


def count_files(df: DataFrame) -> DataFrame:
    """All rows, directories included."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def index_stats(df: DataFrame) -> DataFrame:
    """Row count and size over all rows, directories included."""
    return df.agg(F.count(F.lit(1)).alias("total_files"), _total(F.col("size")))


def catalog_stats(df: DataFrame) -> DataFrame:
    """Files and directories apart; the size is that of the files only."""
    return df.agg(
        F.count_if(~F.col("is_dir")).alias("file_count"),
        F.count_if("is_dir").alias("directory_count"),
        F.count(F.lit(1)).alias("total_count"),
        _total(F.when(~F.col("is_dir"), F.col("size"))),
    )


def count_regular_files(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_dir")).agg(F.count(F.lit(1)).alias("count"))


def stats_by_extension(df: DataFrame) -> DataFrame:
    """Rows, directories, total and average size (rounded down) per extension."""
    return df.groupBy("extension").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("is_dir").alias("directory_count"),
        F.sum("size").alias("total_size"),
        F.expr("sum(size) div count(1)").alias("average_size"),
    )


def prefix_count(df: DataFrame, prefix: str) -> DataFrame:
    """Number of paths that start with the text; ``''`` counts all."""
    return count_files(search_prefix(df, prefix, ordered=False))


def has_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """One boolean; the scan stops at the first match. ``''``: is there any row?"""
    found = search_prefix(df, prefix, ordered=False).select("path").limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("found"))


def prefix_counts(
    df: DataFrame, prefixes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``prefix_count`` for every row of a table of prefixes, zero counts included.

    A small prefix table is broadcast and meets the paths' beginnings of the lengths that occur. A larger
    one is answered by ranks (``_ranks``). A NULL prefix counts nothing.
    """
    wanted = _wanted(prefixes)
    counts = _counts(df, wanted, broadcast_bytes)
    return wanted.filter(F.col("prefix").isNull()).select("prefix", F.lit(0).cast("bigint").alias("count")).unionByName(
        counts.select("prefix", F.coalesce("count", F.lit(0)).alias("count"))
    )


def has_prefixes(
    df: DataFrame, prefixes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows of ``prefixes`` that some path starts with, answered like ``prefix_counts``."""
    there = _counts(df, _wanted(prefixes), broadcast_bytes).filter(F.col("count") > 0)
    return prefixes.join(there.select("prefix"), "prefix", "left_semi")


def _wanted(prefixes: DataFrame) -> DataFrame:
    """Distinct prefixes, written once: they are measured, sampled and shuffled."""
    return reliable(prefixes.select("prefix").distinct())


def _counts(df: DataFrame, wanted: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``(prefix, count)`` of all distinct prefixes but NULL; without a path the count may be NULL."""
    wanted = wanted.filter(F.col("prefix").isNotNull())
    small = broadcast_if_small(wanted, broadcast_bytes)
    if small is not None:
        asked = with_prefixes(df.select("path"), wanted).join(small, "prefix", "left_semi")
        return wanted.join(asked.groupBy("prefix").agg(F.count(F.lit(1)).alias("count")), "prefix", "left")
    ranks = reliable(_ranks(df, wanted))
    totals = ranks.filter("sign = 0")
    before = F.sum("rank").over(W.orderBy("part")) - F.col("rank")
    # One row per shuffle partition.
    offsets = F.broadcast(totals.select("part", before.alias("offset")))
    ends = ranks.filter("sign <> 0").join(offsets, "part")
    count = F.sum(F.col("sign") * (F.col("rank") + F.col("offset")))
    # An upper end is its prefix and one byte more.
    own = F.expr("IF(sign < 0, key, substring(key, 1, octet_length(key) - 1))")
    counted = ends.groupBy(own.alias("prefix")).agg(count.alias("count"))
    return counted.select(F.col("prefix").cast("string").alias("prefix"), "count")


def _ranks(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many paths lie before each end of each prefix's range, per partition.

    In the order of their bytes the paths that start with ``p`` are those from ``p`` to ``p`` and the
    byte 255, which no text contains. Paths and ends are put in that order by one range shuffle, and every
    partition numbers its ends: ``sign`` is -1 for a lower and 1 for an upper one. A row with the sign 0
    has the paths of its partition. Repeats of one path are told apart by their row, so that they need
    not all go to one partition.
    """
    key = F.col("prefix").cast("binary")
    edges = wanted.select(
        F.explode(
            F.array(
                F.struct(key.alias("key"), F.lit(-1).alias("sign")),
                F.struct(F.concat(key, F.lit(b"\xff")).alias("key"), F.lit(1).alias("sign")),
            )
        ).alias("edge"),
    ).select("edge.key", F.lit(-1).cast("bigint").alias("row"), "edge.sign")
    points = df.filter(F.col("path").isNotNull()).select(
        F.col("path").cast("binary").alias("key"),
        F.monotonically_increasing_id().alias("row"),
        F.lit(0).alias("sign"),
    )
    order = ["key", "row"]
    ranged = points.unionByName(edges).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(F.spark_partition_id().alias("part"), "sign", "key")
    return numbered.mapInArrow(_number_ends, "part int, sign int, key binary, rank long")


def _number_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "sign", "key", "rank"]
    paths, part = 0, None
    for batch in batches:
        sign = batch["sign"].to_numpy(zero_copy_only=False)
        rank = paths + np.cumsum(sign == 0)
        if batch.num_rows:
            paths, part = int(rank[-1]), batch["part"][0].as_py()
        ends = pa.array(np.flatnonzero(sign))
        kept = batch.take(ends)
        yield pa.RecordBatch.from_arrays(
            [kept["part"], kept["sign"], kept["key"], pa.array(rank[sign != 0], pa.int64())], names
        )
    if part is not None:
        total = [[part], [0], [None], [paths]]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(total, types)], names)
