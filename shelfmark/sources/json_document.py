"""Snapshot documents in JSON, in any layout, taken apart in parallel.

The text is cut at every closing brace, also inside names, so a cut tells nothing by itself: what a piece
means depends on whether it begins inside a string, and how deep. Each block of a file is read for
both beginnings, inside a string and outside, which gives its end as a function of its beginning.
The functions are put together from block to block, one small row each, and every piece then knows its place.

Pieces that are one file entry are read where they are. Only the others (the head, the tail, entries
with a brace in a name or cut by a block's end) are grouped. A folder's files, in the order of
their names, are one document; all but the last must end with a newline, as Spark writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F

from shelfmark.plans.storage import reliable

# Fields of a snapshot document and of its file entries.
FILE_SCHEMA = (
    "path string, name string, size long, modified_time timestamp, is_dir boolean, extension string"
)
HEAD_SCHEMA = "version string, created_at string, file_count long"

STATE_SCHEMA = (
    "file string, block long, place long, file_size long, value string, odd long, after_brace boolean, "
    "turned long, change0 long, depth0 long, change1 long, depth1 long, ends_block boolean"
)

#: The order of pieces: blocks are numbered through all files.
ORDER = ["nth", "place"]
FILES_DEPTH = 2
FIRST_FILE = r'"files"\s*:\s*\['


class DamagedDocument(ValueError):
    """Not a snapshot document, or one that ends too early."""


def split_document(spark: SparkSession, path: str) -> DataFrame:
    """Pieces ``value`` between closing braces; ``file``, ``block`` and ``place`` tell their order."""
    pieces = spark.read.option("lineSep", "}").text(path)
    return pieces.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("_metadata.file_size").alias("file_size"),
        "value",
    )


def _count(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def _depth_change(text: Column) -> Column:
    """Opened less closed braces and brackets; a piece has no closing brace."""
    return _count(text, "{") + _count(text, "[") - _count(text, "]")


def _for_both_beginnings(pieces: DataFrame) -> DataFrame:
    """The state before each piece, if its block begins outside a string (0) and inside one (1)."""
    # A closing brace cannot be escaped, so no piece begins after half an escape.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    outside = _depth_change(F.regexp_replace(bare, r'"[^"]*+"?', ""))
    read = pieces.select(
        "*",
        F.pmod(_count(bare, '"'), F.lit(2)).alias("odd"),
        outside.alias("if_outside"),
        # What is in a string for the one beginning is outside for the other.
        (_depth_change(bare) - outside).alias("if_inside"),
    )
    return read.mapInArrow(_running, STATE_SCHEMA)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums over each block. A task reads whole blocks, every one in order, so nothing is shuffled,
    and no more than two batches are held at once."""
    key, carried, held = None, {}, None

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files = batch["file"].dictionary_encode()
        which, block = files.indices.to_numpy(), batch["block"].to_numpy()
        names = files.dictionary.to_pylist()
        begins = np.empty(n, bool)
        begins[0] = key != (names[which[0]], block[0])
        begins[1:] = (which[1:] != which[:-1]) | (block[1:] != block[:-1])
        key = (names[which[-1]], block[-1])
        first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        goes_on = ~np.logical_or.accumulate(begins)

        def before(name: str, values: np.ndarray) -> np.ndarray:
            total = np.cumsum(values) - values
            found = total - total[first] + np.where(goes_on, carried.get(name, 0), 0)
            carried[name] = found[-1] + values[-1]
            return found

        odd, if_outside, if_inside = (
            batch[c].to_numpy().astype(np.int64) for c in ("odd", "if_outside", "if_inside")
        )
        after_brace = ~begins | (block > 0)
        turned = before("odd", odd) % 2
        columns = [*(batch[c] for c in ("file", "block", "place", "file_size", "value")), odd, after_brace, turned]
        for start in (0, 1):
            inside = turned != start
            closes = (after_brace & ~inside).astype(np.int64)
            change = np.where(inside, if_inside, if_outside) - closes
            columns += [change, before(f"change{start}", change) - closes]
        if held is not None:
            yield _with_ends(*held, begins[0])
        held = (columns, begins)
    if held is not None:
        yield _with_ends(*held, True)


def _with_ends(columns: list, begins: np.ndarray, ends_last: bool) -> pa.RecordBatch:
    """A row ends its block if the next one begins one."""
    ends = np.append(begins[1:], ends_last)
    names = [column.split()[0] for column in STATE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in [*columns, ends]], names)


def _starts(read: DataFrame) -> DataFrame:
    """What each block begins with: one row per block of the files."""
    blocks = read.groupBy("file", "block").agg(
        F.sum("odd").alias("odd"), F.sum("change0").alias("change0"), F.sum("change1").alias("change1"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("file_size").alias("file_size"),
    )
    ordered = W.orderBy("file", "block")
    turned = blocks.withColumn("starts", F.pmod(F.sum("odd").over(ordered) - F.col("odd"), F.lit(2)))
    change = F.when(F.col("starts") == 0, F.col("change0")).otherwise(F.col("change1"))
    return turned.withColumn("change", change).select(
        "file", "block", F.row_number().over(ordered).alias("nth"), "starts", (F.sum("change").over(ordered) - F.col("change")).alias("start_depth"),
        F.pmod(F.col("starts") + F.col("odd"), F.lit(2)).alias("ends"),
        F.sum("change").over(ordered).alias("end_depth"),
        (F.sum("bytes").over(W.partitionBy("file")) - F.col("file_size")).alias("excess"),
    )


def _groups(rest: DataFrame) -> DataFrame:
    """Pieces joined from one that begins outside strings and entries up to the next such."""
    own = F.when(F.col("begins"), F.struct(*ORDER))
    block = W.partitionBy("nth").orderBy("place")
    marked = rest.withColumn("own", own).withColumn(
        "near", F.last("own", ignorenulls=True).over(block)
    )
    earlier = W.orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    carried = marked.groupBy("nth").agg(F.max("own").alias("newest")).select(
        "nth", F.last("newest", ignorenulls=True).over(earlier).alias("far")
    )
    brace = F.when(F.col("after_brace") & ~F.col("begins"), F.lit("}")).otherwise(F.lit(""))
    return (
        marked.join(F.broadcast(carried), "nth")
        .withColumn("text", F.concat(brace, "value"))
        .groupBy(F.coalesce("near", "far").alias("own"))
        .agg(
            F.sort_array(F.collect_list(F.struct(*ORDER, "text", "depth", "after_brace"))).alias("parts")
        )
        .select(
            "own.*",
            F.array_join("parts.text", "").alias("text"),
            F.col("parts")[0]["depth"].alias("depth"),
            F.col("parts")[0]["after_brace"].alias("after_brace"),
        )
    )


def read_document(spark: SparkSession, path: str) -> tuple[Row | None, DataFrame]:
    """The head, and one row per file entry with ``ORDER``; an entry that cannot be read has no path.

    A document that ends inside an entry or a string raises ``DamagedDocument``.
    """
    read = reliable(_for_both_beginnings(split_document(spark, path)))
    starts = reliable(_starts(read))
    end = starts.orderBy(F.desc("nth")).first()
    # A brace that ends the file has no piece after it. Where pieces and one byte after each are more
    # than the file, there is no such brace; of a compressed file the length is not known.
    open_end = end is not None and end.end_depth == 1 and end.excess != 1
    if end is None or end.ends != 0 or not (end.end_depth == 0 or open_end):
        raise DamagedDocument(f"not a whole snapshot document: {path}")

    outside = F.col("starts") == F.col("turned")
    depth = F.col("start_depth") + F.when(F.col("starts") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    change = F.when(F.col("starts") == 0, F.col("change0")).otherwise(F.col("change1"))
    at = read.join(F.broadcast(starts), ["file", "block"]).withColumn("depth", depth)
    begins = outside & (F.col("depth") <= FILES_DEPTH)
    opens_one = change + F.when(F.col("after_brace"), 1).otherwise(0) == 1
    alone = begins & (F.col("depth") == FILES_DEPTH) & (F.col("odd") == 0) & opens_one & ~F.col("ends_block")
    at = at.withColumn("begins", begins).withColumn("alone", alone)

    groups = reliable(_groups(at.filter(~F.col("alone"))))
    split = F.split("text", FIRST_FILE, 2)
    first = (F.col("depth") < FILES_DEPTH) & (F.size(split) == 2) & split[1].rlike(r"^\s*\{")
    tail = (F.col("depth") == FILES_DEPTH) & F.col("text").rlike(r"^\s*\]")
    blank = F.col("text").rlike(r"^\s*,?\s*\z")
    of_head = (F.col("depth") < FILES_DEPTH) | tail
    brace = F.when(F.col("after_brace") & ~tail, F.lit("}")).otherwise(F.lit(""))
    shown = F.when(first, F.concat(split[0], F.lit('"files":['))).otherwise(F.col("text"))
    # Head and tail are a few short groups; a foreign document may have any number.
    head_parts = groups.filter(of_head).select(*ORDER, F.concat(brace, shown).alias("text"))
    parts = head_parts.orderBy(*ORDER).limit(100).collect()
    closing = "}" if open_end else ""
    text = "".join(part.text for part in parts) + closing
    head = spark.createDataFrame([(text,)], "text string").select(
        F.from_json("text", HEAD_SCHEMA).alias("head")
    ).select("head.*").first()

    rest = groups.filter(~blank & (~of_head | first)).select(
        *ORDER, F.when(first, split[1]).otherwise(F.col("text")).alias("text")
    )
    texts = at.filter("alone").select(*ORDER, F.col("value").alias("text")).unionByName(rest)
    entry = F.concat(F.regexp_replace("text", r"^\s*,?\s*", ""), F.lit("}"))
    return head, texts.select(*ORDER, F.from_json(entry, FILE_SCHEMA).alias("found")).select(*ORDER, "found.*")
