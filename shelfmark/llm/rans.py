"""A static range coder (rANS) for integer arrays, vectorised over interleaved lanes.

A block codes its symbols in rows of ``LANES``; every lane has a 64-bit state of its own and gives
off 32-bit words. All blocks share one frequency table. Lane states are noted every
``CHECKPOINT`` symbols, whatever the number of lanes, so a block can be decoded from any checkpoint on, by several readers at
once. The block ends with a checksum of itself, and holds those of its symbols and of the table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Lanes of the blocks written; those read say how many they have. A step of numpy costs much the same
#: for 512 lanes as for 1,024.
LANES = 1024
CHECKPOINT = 1 << 16
#: Frequencies add up to 2 to this power; more than any vocabulary has entries.
PRECISION = 20

_MAGIC = b"RNSB"
_HEADER = "<4sHHIIIIII"  # magic, version, lanes, symbols, rows, checkpoints, words, sums
_HEADER_SIZE = struct.calcsize(_HEADER)
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_ALL = np.uint64(1 << PRECISION)
_P = np.uint64(PRECISION)
_SLOT = np.uint64((1 << PRECISION) - 1)


class DamagedBlock(ValueError):
    """A block's checksum, length or table does not fit."""


class Table:
    """Frequencies of symbols, scaled to add up to 2 ** ``PRECISION``; every symbol seen keeps one."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols = np.asarray(symbols, np.uint32)[order]
        counts = np.asarray(counts, np.float64)[order]
        total = 1 << PRECISION
        if not 0 < len(self.symbols) <= total // 2:
            raise ValueError("the table needs between one symbol and half the precision")
        share = counts / counts.sum() * (total - len(counts))
        scaled = np.floor(share).astype(np.int64) + 1
        # What rounding left over goes to the largest remainders.
        rest = total - int(scaled.sum())
        scaled[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64)
        self.index = np.full(int(self.symbols[-1]) + 1, -1, np.int64)
        self.index[self.symbols] = np.arange(len(self.symbols))
        self.checksum = zlib.crc32(self.symbols.tobytes() + scaled.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """Place in the table of every value below 2 ** ``PRECISION``."""
        if self._slots is None:
            self._slots = np.repeat(
                np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64)
            )
        return self._slots


def encode(symbols: np.ndarray, table: Table) -> bytes:
    n = len(symbols)
    if n and int(symbols.max()) >= len(table.index):
        raise ValueError("a symbol is not in the table")
    places = table.index[symbols] if n else np.zeros(0, np.int64)
    if n and int(places.min()) < 0:
        raise ValueError("a symbol is not in the table")
    rows = -(-n // LANES)
    padded = np.full(rows * LANES, int(np.argmax(table.freq)), np.int64)
    padded[:n] = places
    padded = padded.reshape(rows, LANES)
    state, every = np.full(LANES, _LOW, np.uint64), CHECKPOINT // LANES
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    for r in range(rows - 1, -1, -1):
        freq, start = table.freq[padded[r]], table.start[padded[r]]
        full = state >= freq << np.uint64(63 - PRECISION)
        words.append(state[full].astype("<u4"))
        state = np.where(full, state >> _32, state)
        # The quotient moved up by the precision, the remainder and the start, with one division.
        state = state // freq * (_ALL - freq) + state + start
        if r % every == 0:
            states.append(state)
    words.reverse()
    states.reverse()
    counts = np.array([len(w) for w in words], np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    marks = b"".join(
        struct.pack("<I", int(before[i * every])) + s.astype("<u8").tobytes()
        for i, s in enumerate(states)
    )
    body = marks + b"".join(w.tobytes() for w in words)
    head = struct.pack(
        _HEADER, _MAGIC, 1, LANES, n, rows, len(states), int(before[-1]), table.checksum,
        zlib.crc32(np.asarray(symbols, "<u4").tobytes()),
    )
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def _parts(block: bytes, table: Table):
    if len(block) < _HEADER_SIZE + 4:
        raise DamagedBlock("block too short")
    magic, version, lanes, n, rows, marks, words, table_sum, symbol_sum = struct.unpack_from(_HEADER, block)
    mark = 4 + 8 * lanes
    if magic != _MAGIC or version != 1 or len(block) != _HEADER_SIZE + marks * mark + 4 * words + 4:
        raise DamagedBlock("not a block, or cut short")
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise DamagedBlock("checksum of the block")
    if table_sum != table.checksum:
        raise DamagedBlock("block was written with another table")
    stream = np.frombuffer(block, "<u4", words, _HEADER_SIZE + marks * mark)
    return lanes, n, rows, marks, mark, stream, symbol_sum


def checkpoints(block: bytes, table: Table) -> int:
    return _parts(block, table)[3]


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The symbols from checkpoint ``first`` up to ``last``; all of them if none are given."""
    lanes, n, rows, marks, mark, stream, symbol_sum = _parts(block, table)
    last = marks if last is None else min(last, marks)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = _HEADER_SIZE + first * mark
    (word,) = struct.unpack_from("<I", block, at)
    state = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    every = CHECKPOINT // lanes
    from_row, to_row = first * every, min(last * every, rows)
    slots, freqs, starts = table.slots, table.freq, table.start
    found = np.empty((to_row - from_row, lanes), np.uint32)
    for r in range(to_row - from_row):
        slot = state & _SLOT
        place = slots[slot.view(np.int64)]
        found[r] = place
        state = freqs[place] * (state >> _P) + slot - starts[place]
        low = np.flatnonzero(state < _LOW)
        if len(low):
            state[low] = state[low] << _32 | stream[word : word + len(low)]
            word += len(low)
    symbols = table.symbols[found.ravel()][: n - from_row * lanes]
    if first == 0 and last == marks and zlib.crc32(symbols.astype("<u4").tobytes()) != symbol_sum:
        raise DamagedBlock("checksum of the symbols")
    return symbols
