"""Repeated substrings of a minimum length in a set of byte strings, by a Burrows-Wheeler transform.

Intervals of the suffix order start with the empty string and are extended backward, one byte a
round. A round finds the borders between suffixes whose common prefix is as long as the round's
number: common prefixes come up by increasing value. After ``length`` rounds it stops; borders not
found by then stand between suffixes with a common prefix of ``length`` or more.
"""

from __future__ import annotations

import numpy as np

#: Stands between the strings; UTF-8 has no such byte.
END = 0xFF


def _starts_of_runs(changed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], changed]))


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of their suffixes; only the first ``length`` bytes or more decide."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys = keys << np.uint64(8) | padded[i : i + n]
    order = np.argsort(keys)
    heads = _starts_of_runs(np.diff(keys[order]) != 0)
    # A rank is the place of the first suffix of the same beginning; past the end it is 0.
    rank = np.zeros(n + 2 * length + 16, np.int64)
    sizes = np.diff(np.append(heads, n))
    rank[order] = np.repeat(heads, sizes) + 1
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    known = 8
    while known < length and len(tied):
        suffixes = order[tied]
        keys = rank[suffixes] << 32 | rank[suffixes + known]
        by = np.argsort(keys, kind="stable")
        order[tied] = suffixes = suffixes[by]
        heads = _starts_of_runs(np.diff(keys[by]) != 0)
        sizes = np.diff(np.append(heads, len(tied)))
        rank[suffixes] = np.repeat(tied[heads], sizes) + 1
        tied = tied[np.repeat(sizes > 1, sizes)]
        known *= 2
    return order


def _children(low: np.ndarray, high: np.ndarray, back: np.ndarray, first: np.ndarray):
    """Intervals of every byte that stands before the intervals ``[low, high)``, in their place."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    places = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
    to = back[places]
    if len(to) * 8 > len(back):
        marks = np.full(len(back), -1, np.int64)
        marks[to] = owner
        to = np.flatnonzero(marks >= 0)
        owner = marks[to]
    else:
        by = np.argsort(to)
        to, owner = to[by], owner[by]
    # What one interval gives with one byte in front lies together.
    byte = first[to]
    runs = _starts_of_runs(
        (np.diff(to) != 1) | (np.diff(owner) != 0) | (byte[1:] != byte[:-1])
    )
    ends = np.append(runs[1:], len(to)) - 1
    return to[runs], to[ends] + 1


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, for each start of a ``length``-byte substring: does it start anywhere else too?"""
    joined = b"".join(s + bytes([END]) for s in strings)
    text = np.frombuffer(joined, np.uint8)
    n = len(text)
    order = suffix_order(text, length)
    transform = text[order - 1]
    by_byte = np.argsort(transform, kind="stable")
    first = transform[by_byte]
    back = np.empty(n, np.int64)
    back[by_byte] = np.arange(n)
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        low, high = _children(low, high, back, first)
        new = ~border[high]
        low, high = low[new], high[new]
        border[high] = True
    again = np.zeros(n, bool)
    again[order] = ~(border[:-1] & border[1:])
    found, at = [], 0
    for s in strings:
        found.append(again[at : at + max(0, len(s) - length + 1)])
        at += len(s) + 1
    return found
