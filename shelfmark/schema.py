"""Row shapes shared by every part of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.functions.naming import base_name, extension_of

CATALOG_COLUMNS = ["path", "name", "size", "modified_time", "is_dir", "extension"]

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("modified_time", T.TimestampType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("extension", T.StringType(), False),
    ]
)

QUERY_SCHEMA = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("raw", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("case_sensitive", T.BooleanType()),
        T.StructField("extensions", T.ArrayType(T.StringType())),
        T.StructField("min_size", T.LongType()),
        T.StructField("max_size", T.LongType()),
        T.StructField("fuzzy_distance", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("size", T.LongType()),
        T.StructField("modified_time", T.TimestampType()),
        T.StructField("is_dir", T.BooleanType()),
    ]
)


def catalog_row(path: Column, size: Column, modified_time: Column, is_dir: Column) -> list[Column]:
    """The six catalog columns, with ``name`` and ``extension`` derived from the path."""
    name = base_name(path)
    return [
        path.alias("path"),
        name.alias("name"),
        F.coalesce(size.cast("bigint"), F.lit(0)).alias("size"),
        modified_time.alias("modified_time"),
        F.coalesce(is_dir, F.lit(False)).alias("is_dir"),
        extension_of(name).alias("extension"),
    ]


def catalog_from_manifest(
    df: DataFrame,
    path: str = "path",
    size: str = "size",
    modified_time: str = "modified_time",
    is_dir: str | None = "is_dir",
    keep: list[str] | None = None,
) -> DataFrame:
    """Catalog rows from any listing table (a bucket inventory, an ``fsimage`` dump).

    A narrow projection: no shuffle, and only the four named columns are read. Rows without
    a path are dropped, the other columns get the catalog's null-free defaults (no time is the start of
    1970); ``keep`` names columns to carry along.
    """
    directory = F.col(is_dir) if is_dir else F.lit(False)
    time_type = df.select(modified_time).schema[0].dataType
    time = F.coalesce(F.col(modified_time), F.lit("1970-01-01 00:00:00").cast(time_type))
    return df.filter(F.col(path).isNotNull() & (F.col(path) != "")).select(
        *catalog_row(F.col(path), F.col(size), time, directory), *(keep or [])
    )
