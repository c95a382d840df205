"""Token ids of a corpus as compressed files, in the order of the document ids.

A folder has ``frequencies`` (symbol, count) and ``blocks`` (part, first place, ids of the documents and how
many tokens each has, payload). Parts are ranges of the document ids, blocks whole documents of
about ``BLOCK`` tokens, payloads are coded by ``rans`` with the one table. Both are Parquet, so
Spark's writers commit them on any store, also when executors are lost on the way; every block can be
read and decoded on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from shelfmark.llm import rans
from shelfmark.llm.common import doc_key, step
from shelfmark.llm.tokens import encoder
from shelfmark.plans.sizing import broadcast_if_small

#: Tokens of a block, which ends with the document that reaches them.
BLOCK = 1 << 18
#: Words that a process keeps here, where most of its time goes into new ones.
REMEMBERED = 700_000


def _kind(tokenizer: str, end_id: int) -> type:
    """The type of ids while they wait: 16 bits where the vocabulary allows."""
    return np.uint16 if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else np.uint32


def tokenised(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """``(id, doc, ids)`` of every row, and ``(symbol, count)`` over all ids.

    Texts are read once and never shuffled. The last row of every task adds up its symbols. Written once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", doc_key().alias("doc"), "text")
    id_type, kind = rows.schema["id"].dataType.simpleString(), _kind(tokenizer, end_id)
    numbers = pa.list_(pa.int64())

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(tokenizer, REMEMBERED), np.zeros(0, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        names, key_type = ["id", "doc", "ids", "symbols", "counts"], None
        for batch in batches:
            key_type, ids = batch["id"].type, []
            for text in batch["text"]:
                found = np.frombuffer(encode(text.as_py()) + end, "<u4").astype(kind)
                ids.append(found.tobytes())
            seen = np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            seen[: len(total)] += total
            total = seen
            none = pa.nulls(len(ids), numbers)
            own = [batch["id"], batch["doc"], pa.array(ids, pa.binary()), none, none]
            yield pa.RecordBatch.from_arrays(own, names)
        if key_type is not None:
            symbols = np.flatnonzero(total)
            sums = [pa.array([x.tolist()], numbers) for x in (symbols, total[symbols])]
            empty = [pa.nulls(1, key_type), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, *sums], names)

    schema = f"id {id_type}, doc string, ids binary, symbols array<long>, counts array<long>"
    made = step(rows.mapInArrow(per_task, schema), compression="zstd")
    counted = made.filter("symbols IS NOT NULL").selectExpr("inline(arrays_zip(symbols, counts))")
    counted = counted.groupBy(F.col("symbols").alias("symbol")).agg(F.sum("counts").alias("count"))
    return made.filter("ids IS NOT NULL").select("id", "doc", "ids"), counted


def _table(found: DataFrame) -> rans.Table | None:
    """The shared table. It has one row per symbol of the vocabulary, whatever the corpus."""
    rows = found.select("symbol", "count").collect()
    if not rows:
        return None
    return rans.Table(np.array([r.symbol for r in rows]), np.array([r[1] for r in rows]))


def _write(df: DataFrame, path: str) -> None:
    df.write.option("compression", "uncompressed").parquet(path)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> None:
    """Writes the ids of every text, each with ``end_id`` behind, to ``folder``.

    Null texts equal empty ones. Rows without an id come first; rows that repeat an id follow each
    other. An empty table makes files without rows.
    """
    spark, kind = docs.sparkSession, _kind(tokenizer, end_id)
    tokens, counted = tokenised(docs, tokenizer, end_id, id_col, text_col)
    _write(counted.coalesce(1), f"{folder}/frequencies")
    table = _table(spark.read.parquet(f"{folder}/frequencies"))
    id_type = tokens.schema["id"].dataType.simpleString()

    def made(part: int, first: int, ids: list[pa.Array], texts: list[np.ndarray]) -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        lengths = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([first], pa.int64()),
                pa.ListArray.from_arrays([0, len(own)], own),
                pa.ListArray.from_arrays([0, len(own)], lengths),
                pa.array([rans.encode(np.concatenate(texts), table)], pa.binary()),
            ],
            ["part", "first", "ids", "lengths", "payload"],
        )

    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A part is a range of ids, in order; its blocks are runs of documents.
        part, first, held, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            start = 0
            for i, found in enumerate(batch["ids"]):
                texts.append(np.frombuffer(found.as_py(), kind))
                held += len(texts[-1])
                if held >= block:
                    ids.append(batch["id"].slice(start, i + 1 - start))
                    yield made(part, first, ids, texts)
                    first, held, ids, texts, start = first + len(texts), 0, [], [], i + 1
            if start < batch.num_rows:
                ids.append(batch["id"].slice(start))
        if texts:
            yield made(part, first, ids, texts)

    ordered = tokens.repartitionByRange("id", "doc").sortWithinPartitions("id", "doc").select("id", "ids")
    schema = f"part int, first long, ids array<{id_type}>, lengths array<bigint>, payload binary"
    _write(ordered.mapInArrow(per_part, schema), f"{folder}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """``(part, first, block_start)``: how many ids come before each block."""
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)
    sums = blocks.select("part", "first", total.alias("n"))
    # Parts are few, one per task that wrote.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")
    )
    within = W.partitionBy("part").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("block_start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return sums.join(parts, "part").select(
        "part", "first", (F.col("part_start") + F.col("block_start")).alias("block_start")
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document; ``start`` counts the ids before it.

    ``ids`` are little-endian unsigned 32-bit integers. A damaged block raises an error.
    """
    table = _table(spark.read.parquet(f"{folder}/frequencies"))
    blocks = spark.read.parquet(f"{folder}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    starts = block_starts(blocks)
    few = broadcast_if_small(starts)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c] for c in ("block_start", "ids", "lengths", "payload"))
            for start, ids, lengths, payload in zip(*columns):
                symbols = rans.decode(payload.as_py(), table).astype("<u4")
                counts = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(counts)
                texts = [symbols[a:b].tobytes() for a, b in zip(ends - counts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values, pa.array(ends - counts + start.as_py()), pa.array(counts),
                        pa.array(texts, pa.binary()),
                    ],
                    ["id", "start", "n_tokens", "ids"],
                )

    schema = f"id {id_type}, start long, n_tokens long, ids binary"
    placed = blocks.join(starts if few is None else few, ["part", "first"])
    return placed.select("block_start", "ids", "lengths", "payload").mapInArrow(per_batch, schema)
