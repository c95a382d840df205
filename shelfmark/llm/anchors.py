"""Windows dealt out by content, so that equal windows meet without all windows being compared.

Of the grams inside a window the one with the smallest hash is the window's anchor. Equal windows
have equal anchors, and neighbouring windows share one: they form a run. The windows of two texts
can only be equal where their runs have anchors of the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PLACE_BITS = np.uint64(21)
#: Windows of a text that are looked at together; places of their grams fit the bits above.
SLICE = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """The values spread evenly over 64 bits."""
    values = values ^ values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, done = values, 1
    while 2 * done <= width:
        least, done = np.minimum(least[:-done], least[done:]), 2 * done
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def runs(hashes: np.ndarray, grams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(anchor hash, first window, windows)`` as arrays, slice by slice; every window is in one run.

    ``hashes`` are those of a text's grams in order, ``grams`` is how many a window has.
    """
    windows = len(hashes) - grams + 1
    last = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    for at in range(0, windows, SLICE):
        part = hashes[at : at + SLICE + grams - 1]
        # The upper bits decide, then the later place: the same choice in every equal window.
        place = np.arange(len(part), dtype=np.uint64)
        least = sliding_least(part & ~last | last - place, grams)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        chosen = part[(last - (least[first] & last)).astype(np.int64)]
        yield chosen.astype(np.int64), first + at, np.diff(np.append(first, len(least)))


def anchor_places(hashes: np.ndarray) -> np.ndarray:
    """Place of the anchor among the grams of each window; a row of ``hashes`` is one window's."""
    last = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    place = np.arange(hashes.shape[-1], dtype=np.uint64)
    return np.argmin(hashes & ~last | last - place, axis=-1)
