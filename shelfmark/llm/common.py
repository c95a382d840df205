"""What the text operators share: reading tables, keeping a row whole, keys of rows, steps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.plans.sizing import broadcast_if_small
from shelfmark.plans.storage import step_path

#: A Python task works on so many bytes of text at a time, but for a text that is longer.
PORTION = 4 << 20


def step(df: DataFrame, **options: str) -> DataFrame:
    """The frame, written to the shared folder with the writer's options and read back from there."""
    path = step_path(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def portions(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in batches of about so many bytes of ``text``. A task's batch may
    hold all its texts; what is made of one portion can leave the process before the next is begun."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64)
        begun = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(begun)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns of the row in one), ``id`` and ``text``: no other column's name can clash."""
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def doc_key(row_id: str = "id", text: str = "text") -> Column:
    """A text that tells rows apart, also rows without an id and those that share one."""
    shown = F.coalesce(F.col(row_id).cast("string"), F.lit(""))
    return F.concat_ws(
        ":", F.col(row_id).isNull().cast("string"), shown, F.hex(F.xxhash64(text_or_empty(text)))
    )


def only_with(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or, as ``left_anti``, is not) among ``keys``; few keys are broadcast."""
    few = broadcast_if_small(keys)
    return rows.join(keys if few is None else few, key, how)
