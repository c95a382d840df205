"""Decisions that need a measured size: what to broadcast, which keys to salt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

# A broadcast copy is held by every executor; 32 MiB of text is a few hundred MiB as a hash table.
BROADCAST_BYTES = 32 << 20
# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 1_000_000
# So many hot keys fit the driver and a broadcast; a longer list stays a table.
HOT_KEYS = 10_000
PATH_SLICES = 256
# So many keys fit into a plan as a literal set.
LITERAL_KEYS = 2_000


def byte_size(df: DataFrame) -> int:
    """Bytes of text in the rows plus 16 for every value, by one aggregation."""
    width = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            width = width + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
        elif isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
    return df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("bytes")).first().bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """The frame with a broadcast hint if its measured size allows one, else ``None``."""
    return F.broadcast(df) if byte_size(df) <= limit else None


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as run at once: for work that is far larger than its bytes,
    by which partitions are coalesced and files are split."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def hot_keys(
    df: DataFrame,
    key: str,
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame | None:
    """``(key, slices)`` for keys with more than ``rows_per_task`` rows, ``None`` if there are none.

    ``counts`` has the ``rows`` per key, if the caller has counted. Up to ``HOT_KEYS`` such keys are
    broadcast; more are joined like any table.
    """
    if counts is None:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    hot = counts.filter(F.col("rows") > rows_per_task).select(
        key, F.ceil(F.col("rows") / rows_per_task).cast("int").alias("slices")
    )
    found = hot.limit(HOT_KEYS + 1).collect()
    if len(found) > HOT_KEYS:
        return hot
    return F.broadcast(df.sparkSession.createDataFrame(found, hot.schema)) if found else None


def keep_keys_of(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``many`` without rows whose key ``few`` does not have, where its keys can be broadcast; the
    rest of the rows need not be shuffled for the join then."""
    keys = broadcast_if_small(few.select(key).distinct())
    return many if keys is None else many.join(keys, key, "left_semi")


def join_hot_keys(
    many: DataFrame,
    few: DataFrame,
    key: str,
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_bytes: int = BROADCAST_BYTES,
    known_small: bool | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner join where one key may hold a large part of ``many`` and fewer rows of ``few``.

    A small ``few`` is broadcast; its size is measured unless the caller knows the answer.
    Otherwise the rows of hot keys are cut into slices by a hash of the row, and their rows in
    ``few`` are repeated per slice, so no task gets a whole hot key.
    """
    if known_small is None:
        known_small = broadcast_if_small(few, broadcast_bytes) is not None
    if known_small:
        return many.join(F.broadcast(few), key)
    hot = hot_keys(many, key, rows_per_task, counts)
    if hot is None:
        return many.join(few, key)
    slices = F.coalesce("slices", F.lit(1))
    others = [c for c in many.columns if c != key]
    cut = many.join(hot, key, "left").withColumn(
        "slice", F.pmod(F.xxhash64(*others), slices).cast("int")
    )
    repeated = few.join(hot, key, "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return cut.drop("slices").join(repeated.drop("slices"), [key, "slice"]).drop("slice")


def first_k_per(
    df: DataFrame, keys: list[str], order: list, k: int, rank: str, much_alike: bool = False
) -> DataFrame:
    """The first ``k`` rows of every group, numbered from 1 in ``rank``.

    ``much_alike`` says that the first key has few values: a number in front of the keys then spares
    the sort from comparing rows field by field; where texts differ early it only costs. Groups are cut by a hash of the path first, for any ``k``, so that a hot group is never sorted in
    one task, nor what each of very many tasks has left of it.
    """
    def first(frame: DataFrame, by: list) -> DataFrame:
        numbered = frame.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        return numbered.filter(F.col(rank) <= k)

    slices = F.pmod(F.xxhash64("path"), F.lit(PATH_SLICES))
    # Rows are sorted by their groups.
    number = [F.xxhash64(*keys, slices)] if much_alike else []
    return first(first(df, [*number, *keys, slices]).drop(rank), keys)


def keep_known(keys: str, wanted: DataFrame, key: str = "key") -> str:
    """SQL for an array of keys without those that ``wanted`` does not have, if it has few.

    Dropping them before ``explode`` saves a row each; with many keys the array stays as it is.
    """
    known = wanted.select(key).distinct().limit(LITERAL_KEYS + 1).collect()
    if not 0 < len(known) <= LITERAL_KEYS:
        return keys
    return f"filter({keys}, k -> k IN ({', '.join(f'{row[0]}L' for row in known)}))"
