"""A Merkle tree over the rows of a dataset, per source, whose parents keep their hash states.

Leaves of one source ascend by id; three consecutive nodes make a parent, until one is left, the
source's subroot; the subroots make the tree of the dataset in the same way. A parent is the SHA-256 of its children's
digests as text, and keeps a copy of the hash state before each child. To see what root a changed leaf
would give, the state before it is resumed with the new digest and the siblings to its right only, and
so on up to the root.

The tree is built in rounds of some levels. A round deals the nodes of each source out in blocks
of neighbours, so a source of any size is spread over all tasks, and gives one node per block to the next
round. Going down, a block gets the path from its top to the root once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelfmark.llm import midstates
from shelfmark.llm.common import step
from shelfmark.plans.sizing import broadcast_if_small

FAN = 3
#: Levels of the first round, whose blocks are dealt out to many tasks, and of those above it.
LEVELS, UPPER_LEVELS = 4, 7
#: A task hashes the blocks of about so many rows at once.
ROWS = 20_000

_DIGEST, _PARENT = 32, 2 + 32  # bytes of a digest; of slot, number of children and state


@dataclass
class Round:
    """Nodes ``(key, index, total, digest)`` of one level, and the levels built on them."""

    nodes: DataFrame
    levels: int


@dataclass
class Manifest:
    """``leaves``: the columns given, ``key`` (``0``, or ``1`` and the source), ``index`` in the source and ``total``.
    ``parents``: ``tree`` (``source`` or ``dataset``), ``key``, ``level``, ``index``, ``digest``, ``states``
    (the hash state before each child, 32 bytes each). ``subroots``: ``key``, ``index``, ``digest``.
    ``root`` is hexadecimal; ``None`` without rows."""

    leaves: DataFrame
    parents: DataFrame | None
    subroots: DataFrame
    root: str | None
    rounds: list[Round] = field(repr=False)
    above: list[Round] = field(repr=False)


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values, each ``-`` if null, else its number of bytes, ``:`` and itself."""
    shown = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``index``, from 0 within their ``key``, and ``total``, the rows of the key.

    Rows are sorted in ranges over all keys; each range counts its keys, and the counts before it give the
    first number of a key in it. So no task gets a whole key.
    """
    ranges = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = step(ranges.select("*", F.spark_partition_id().alias("part"), place.alias("place")))
    counts = kept.groupBy("part", "key").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    parts = W.partitionBy("key")
    before = parts.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")
    counts = step(counts.select("part", "key", first.alias("first"), F.sum("rows").over(parts).alias("total")))
    few = broadcast_if_small(counts)
    found = kept.join(counts if few is None else few, ["part", "key"])
    return found.withColumn("index", F.col("first") + F.col("place")).drop("part", "place", "first")


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes, as (n, 32)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _DIGEST)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by block, in tables that end where a block ends."""
    kept: list[pa.Table] = []
    for batch in batches:
        kept.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in kept) >= ROWS:
            table = pa.concat_tables(kept)
            change = np.flatnonzero(_changes(table))
            kept = [table.slice(int(change[-1]))]
            if change[-1]:
                yield table.slice(0, int(change[-1]))
    if kept:
        yield pa.concat_tables(kept)


def _changes(table: pa.Table) -> np.ndarray:
    """Where a block begins."""
    keys = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    blocks = table["block"].to_numpy()
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])
    return first


class _Level:
    """The parents of nodes that are sorted by block and index.

    ``parent`` and ``slot`` are per node; ``count``, ``children`` and ``states`` (before each child) per
    parent. A node that is alone in its source is its own parent, without hashing.
    """

    def __init__(self, block: np.ndarray, index: np.ndarray, total: np.ndarray, digest: np.ndarray):
        first = np.ones(len(index), bool)
        first[1:] = (block[1:] != block[:-1]) | (index[1:] // FAN != index[:-1] // FAN)
        self.parent, self.slot, self.hashed = np.cumsum(first) - 1, index % FAN, total > 1
        self.block, self.index = block[first], index[first] // FAN
        self.total = -(-total[first] // FAN)
        self.count = np.bincount(self.parent, minlength=len(self.block))
        self.children = np.zeros((len(self.block), FAN, _DIGEST), np.uint8)
        self.children[self.parent, self.slot] = digest
        self.states = np.zeros((len(self.block), FAN, 8), np.uint32)
        self.digest = digest[first]
        made = np.flatnonzero(total[first] > 1)
        state = np.tile(midstates.START, (len(made), 1))
        for slot in range(FAN):
            self.states[made, slot] = state
            more = self.count[made] > slot
            blocks = midstates.digest_blocks(self.children[made[more], slot])
            state[more] = midstates.resumed(state[more], blocks)
        self.digest[made] = midstates.finished(state, self.count[made])


def _levels(table: pa.Table, block: np.ndarray, levels: int) -> list[_Level]:
    index, total, digest = table["index"].to_numpy(), table["total"].to_numpy(), _bytes(table["digest"])
    found: list[_Level] = []
    for _ in range(levels):
        found.append(_Level(block, index, total, digest))
        block, index, total, digest = found[-1].block, found[-1].index, found[-1].total, found[-1].digest
    return found


def _dealt(nodes: DataFrame, levels: int, *others: DataFrame) -> DataFrame:
    """Rows by block, and in it by index; ``others`` have their ``block`` and are sorted to its front."""
    rows = nodes.withColumn("block", F.floor(F.col("index") / FAN**levels).cast("bigint"))
    for other in others:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", F.asc_nulls_first("index"))


def _parents(nodes: DataFrame, levels: int) -> DataFrame:
    """All parents of the round: ``key, level`` (from 1), ``index, total, digest, states, top``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            first = np.flatnonzero(_changes(table))
            keys = table["key"].take(pa.array(first)).combine_chunks()
            block = np.cumsum(_changes(table)) - 1
            for number, level in enumerate(_levels(table, block, levels), 1):
                hashed = np.zeros(len(level.index), bool)
                hashed[level.parent[level.hashed]] = True
                at = np.flatnonzero(hashed)
                top = (number == levels) | (level.total[at] == 1)
                states = [
                    [s.tobytes() for s in some[:count].astype(">u4")]
                    for some, count in zip(level.states[at], level.count[at])
                ]
                columns = [
                    keys.take(pa.array(level.block[at])), pa.array(np.full(len(at), number, np.int32)),
                    pa.array(level.index[at]), pa.array(level.total[at]),
                    pa.array([d.tobytes() for d in level.digest[at]], pa.binary()),
                    pa.array(states, pa.list_(pa.binary())), pa.array(top),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "level", "index", "total", "digest", "states", "top"]
    schema = "key string, level int, index bigint, total bigint, digest binary, states array<binary>, top boolean"
    rows = _dealt(nodes.select("key", "index", "total", "digest"), levels)
    return rows.mapInArrow(per_batch, schema)


def _risen(nodes: DataFrame) -> tuple[list[Round], list[DataFrame], DataFrame]:
    """Rounds, their parents, and the one node that is left of every key, with the ``round`` it came from."""
    rounds, parents, left, levels, below = [], [], [], LEVELS, 0
    while True:
        single = nodes.filter("total = 1").select("key", "digest", F.lit(len(rounds)).alias("round"))
        left.append(single)
        nodes = nodes.filter("total > 1")
        rounds.append(Round(nodes, levels))
        if nodes.isEmpty():
            break
        made = step(_parents(nodes, levels))
        parents.append(made.withColumn("level", F.col("level") + below))
        nodes = made.filter("top").select("key", "index", "total", "digest")
        below, levels = below + levels, UPPER_LEVELS
    all_left = left[0]
    for more in left[1:]:
        all_left = all_left.unionByName(more)
    return rounds, parents, step(all_left)


def build(leaves: DataFrame, source: str = "source", id_col: str = "id", digest: str = "digest") -> Manifest:
    """The manifest of leaves, one per row of the dataset, with binary digests (``leaf_digest``).

    Leaves ascend by id, null ids first, equal ids by digest; equal rows are leaves of their own. The
    null source is a source, before all others. The given columns stay; ``key``, ``index``,
    ``total`` and those of this module must not be among them.
    """
    clash = {"key", "index", "total", "part", "place", "first", "block", "path", "subroot"} & set(leaves.columns)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    key = F.coalesce(F.concat(F.lit("1"), F.col(source)), F.lit("0"))
    rows = step(numbered(leaves.withColumn("key", key), [id_col, digest]))
    nodes = rows.select("key", "index", "total", F.col(digest).alias("digest"))
    rounds, parents, tops = _risen(nodes)
    subroots = tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest", "round")
    subroots = step(numbered(subroots, ["name"]))
    above, higher, last = _risen(subroots.select("key", "index", "total", "digest"))
    all_parents = None
    for tree, some in (("source", parents), ("dataset", higher)):
        for made in some:
            shown = made.select(F.lit(tree).alias("tree"), "key", "level", "index", "digest", "states")
            all_parents = shown if all_parents is None else all_parents.unionByName(shown)
    found = last.first()
    return Manifest(rows, all_parents, subroots, bytes(found.digest).hex() if found else None, rounds, above)


def _siblings(level: _Level, node: int) -> bytes:
    """Slot, number of children, state before the node, and the other children's digests."""
    parent, slot = level.parent[node], level.slot[node]
    count = int(level.count[parent])
    others = b"".join(level.children[parent, i].tobytes() for i in range(count) if i != slot)
    return bytes([slot, count]) + level.states[parent, slot].astype(">u4").tobytes() + others


def _paths(nodes: DataFrame, levels: int, tops: DataFrame) -> DataFrame:
    """``(key, index, subroot, path)`` of a round's nodes, from those of their blocks' top nodes."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            below, block, _, path, subroot = _split(table)
            made = _levels(below, block, levels)
            paths = []
            for i in range(below.num_rows):
                parts, node = [], i
                for level in made:
                    if level.hashed[node]:
                        parts.append(_siblings(level, node))
                    node = level.parent[node]
                paths.append(b"".join(parts) + path[block[i]])
            columns = [
                below["key"].combine_chunks(), below["index"].combine_chunks(),
                pa.array([subroot[b] for b in block], pa.binary()), pa.array(paths, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "index", "subroot", "path"])

    rows = _dealt(nodes.select("key", "index", "total", "digest"), levels, _fronts(tops))
    rows = rows.select("key", "block", "index", "total", "digest", "subroot", "path")
    return rows.mapInArrow(per_batch, "key string, index bigint, subroot binary, path binary")


def _fronts(tops: DataFrame) -> DataFrame:
    """The paths of top nodes as the rows that stand before their blocks."""
    return tops.select("key", F.col("index").alias("block"), "subroot", "path")


def _split(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Nodes, their block's number, and of each block the place of its front row, its path and subroot."""
    front = table["index"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    block = np.cumsum(front) - 1
    tops = table.filter(pa.array(front))
    below = table.filter(pa.array(~front))
    return below, block[~front], np.flatnonzero(front), tops["path"].to_pylist(), tops["subroot"].to_pylist()


def _descended(rounds: list[Round], single: DataFrame) -> DataFrame:
    """Paths of the top nodes of the first round's blocks; ``single`` has those of the keys' last nodes,
    with the round they came from. A key's only node is the top of its block."""

    def of_round(number: int) -> DataFrame:
        return single.filter(F.col("round") == number).drop("round")

    paths = of_round(len(rounds) - 1)
    for number in range(len(rounds) - 2, -1, -1):
        if number:
            paths = _paths(rounds[number].nodes, rounds[number].levels, paths)
        paths = step(paths.unionByName(of_round(number)))
    return paths


def _subroot_paths(manifest: Manifest) -> DataFrame:
    """``(key, index, subroot, path, round)`` of every source's subroot."""
    subroots, above = manifest.subroots, manifest.above
    nothing = F.lit(b"")
    if len(above) == 1:
        paths = subroots.select("index", nothing.alias("path"))
    else:
        last = subroots.sparkSession.range(1).select(
            F.lit("").alias("key"), F.lit(0).cast("bigint").alias("index"), nothing.alias("subroot"),
            nothing.alias("path"), F.lit(len(above) - 1).alias("round"),
        )
        paths = _paths(above[0].nodes, above[0].levels, _descended(above, last)).select("index", "path")
    found = subroots.join(paths, "index")
    return found.select(
        F.col("name").alias("key"), F.lit(0).cast("bigint").alias("index"), F.col("digest").alias("subroot"), "path", "round"
    )


def _folded(digest: np.ndarray, states: np.ndarray, right: list[tuple[np.ndarray, np.ndarray]], count: np.ndarray) -> np.ndarray:
    """Parents' digests where a child has this digest: the state before it, resumed with it and with what
    stands to its right, ``(rows, digests)`` for each place."""
    state = midstates.resumed(states, midstates.digest_blocks(digest))
    for rows, digests in right:
        state[rows] = midstates.resumed(state[rows], midstates.digest_blocks(digests))
    return midstates.finished(state, count)


def _fold_level(level: _Level, node: np.ndarray, digest: np.ndarray, proof: list[list[bytes]]) -> None:
    """One level up: ``digest`` becomes the parents', and the siblings go to each row's proof."""
    rows = np.flatnonzero(level.hashed[node])
    parent, slot = level.parent[node[rows]], level.slot[node[rows]]
    count = level.count[parent]
    right = []
    for i in range(1, FAN):
        more = np.flatnonzero(slot + i < count)
        right.append((more, level.children[parent[more], slot[more] + i]))
    digest[rows] = _folded(digest[rows], level.states[parent, slot], right, count)
    for i in range(FAN):
        there = np.flatnonzero((slot != i) & (i < count))
        for row, sibling in zip(rows[there].tolist(), level.children[parent[there], i]):
            proof[row].append(sibling.tobytes())


def _fold_path(paths: list[bytes], block: np.ndarray, digest: np.ndarray) -> list[bytes]:
    """From the blocks' tops to the root; returns the siblings on each block's path."""
    at, found = [0] * len(paths), [b""] * len(paths)
    while any(at[b] < len(path) for b, path in enumerate(paths)):
        slots, counts = np.zeros(len(paths), int), np.zeros(len(paths), int)
        states = np.zeros((len(paths), 8), np.uint32)
        others = np.zeros((len(paths), FAN, _DIGEST), np.uint8)
        for b, path in enumerate(paths):
            if at[b] < len(path):
                slots[b], counts[b] = path[at[b]], path[at[b] + 1]
                end = at[b] + _PARENT + _DIGEST * int(counts[b] - 1)
                states[b] = np.frombuffer(path, ">u4", 8, at[b] + 2)
                siblings = path[at[b] + _PARENT : end]
                others[b, : counts[b] - 1] = np.frombuffer(siblings, np.uint8).reshape(-1, _DIGEST)
                found[b] += siblings
                at[b] = end
        rows = np.flatnonzero(counts[block] > 0)
        of = block[rows]
        right = []
        for i in range(FAN - 1):
            # Without the node itself, the first sibling to its right stands at its own slot.
            more = np.flatnonzero(slots[of] + i < counts[of] - 1)
            right.append((more, others[of[more], slots[of[more]] + i]))
        digest[rows] = _folded(digest[rows], states[of], right, counts[of])
    return found


def fold(manifest: Manifest, replaced: str, digest: str = "digest") -> DataFrame:
    """The manifest's leaves, all columns, with ``subroot``, ``siblings`` (all digests that the way to the
    root needs, level by level, left to right, 32 bytes each) and ``folded``: the root that the tree would
    have if this leaf alone had the digest in the column ``replaced``."""
    leaves = manifest.leaves
    extra = leaves.columns
    names = [*extra, "subroot", "siblings", "folded"]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in leaves.schema)}, subroot binary, siblings binary, folded binary"
    levels = manifest.rounds[0].levels

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            below, block, _, paths, subroots = _split(table)
            renamed = below.select(["index", "total"]).append_column("digest", below[digest])
            node, proof = np.arange(below.num_rows), [[] for _ in range(below.num_rows)]
            folded = _bytes(below[replaced]).copy()
            for level in _levels(renamed, block, levels):
                _fold_level(level, node, folded, proof)
                node = level.parent[node]
            upper = _fold_path(paths, block, folded)
            columns = [
                *(below[name].combine_chunks() for name in extra),
                pa.array([subroots[b] for b in block], pa.binary()),
                pa.array([b"".join(p) + upper[b] for p, b in zip(proof, block)], pa.binary()),
                pa.array([d.tobytes() for d in folded], pa.binary()),
            ]
            for batch in pa.Table.from_arrays(columns, names).to_batches(max_chunksize=ROWS):
                yield batch

    tops = _descended(manifest.rounds, _subroot_paths(manifest))
    rows = _dealt(leaves, levels, _fronts(tops))
    return rows.mapInArrow(per_batch, schema)
