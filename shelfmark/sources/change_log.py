"""Change logs: raw file events, as a batch or a stream, turned into catalog changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.predicates import should_ignore

# Raw flags in the order they apply, and the change each one means.
FLAG_CHANGES = {"create": "create", "write": "modify", "remove": "delete", "rename": "delete"}

RAW_SCHEMA = (
    "seq long, ts timestamp, path string, flags array<string>, size long, "
    "modified_time timestamp, is_dir boolean"
)


def filter_ignored(changes: DataFrame) -> DataFrame:
    """Leave out hidden, temporary and system files."""
    return changes.filter(~should_ignore())


def map_raw_changes(raw: DataFrame) -> DataFrame:
    """One change per meaningful flag of a raw event; flags such as ``chmod`` mean nothing.

    A rename removes the old path (the new one comes as its own create). ``seq`` is widened so that
    the changes of one event keep the order of the flags.
    """
    flags = F.array(*[F.lit(flag) for flag in FLAG_CHANGES])
    present = F.filter(flags, lambda flag: F.array_contains(F.col("flags"), flag))
    exploded = raw.withColumn("flag", F.explode(present))
    op = F.lit(None).cast("string")
    for flag, change in FLAG_CHANGES.items():
        op = F.when(F.col("flag") == flag, change).otherwise(op)
    step = F.array_position(flags, F.col("flag"))
    return exploded.select(
        (F.col("seq") * (len(FLAG_CHANGES) + 1) + step).alias("seq"),
        "ts",
        "path",
        op.alias("op"),
        "size",
        "modified_time",
        "is_dir",
    )


def read_changes(spark: SparkSession, folder: str, file_format: str = "parquet") -> DataFrame:
    """A stream of changes over a folder to which raw event files are added."""
    raw = spark.readStream.schema(RAW_SCHEMA).format(file_format).load(folder)
    return map_raw_changes(filter_ignored(raw))
