"""Periodic runs of words: stretches in which every word equals the one a period before it.

A suffix automaton knows every string of words in a text. Its suffix links make a tree in which the
strings that end at one place are a path to the root, and every string is coloured with the last place
where it ended. Going through the text, each word recolours the path of its place, by the access
operation of a link-cut tree, which hands out the path in pieces of one colour. A piece says that the
strings of up to some length, which end here, ended last so many words ago; if that distance is no
longer than the length, two equal strings touch: a square, which is extended to its run. No run is
missed: at the end of its first two periods, the string of one period ended last one period before.

All words of a run lie in groups of a few words that the text has more than once, so a text is first
cut at the words which do not. Most texts have nothing left then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has so many words at least, and two periods.
LEAST, PERIODS = 12, 2

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """The strings of a sequence: states with their longest length and their suffix link."""

    def __init__(self, sequence: list[int]):
        self.length, self.link, self.prefixes = [0], [-1], [0]
        steps: list[dict[int, int]] = [{}]
        last = 0
        for sign in sequence:
            state = self._added(self.length[last] + 1, 0)
            steps.append({})
            at = last
            while at >= 0 and sign not in steps[at]:
                steps[at][sign] = state
                at = self.link[at]
            if at >= 0:
                target = steps[at][sign]
                if self.length[target] > self.length[at] + 1:
                    # The shorter strings of the state end at more places now: they get their own.
                    part = self._added(self.length[at] + 1, self.link[target])
                    steps.append(dict(steps[target]))
                    self.link[target] = part
                    while at >= 0 and steps[at].get(sign) == target:
                        steps[at][sign] = part
                        at = self.link[at]
                    target = part
                self.link[state] = target
            self.prefixes.append(state)
            last = state

    def _added(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1


class LastPlaces:
    """The suffix links as a link-cut tree whose preferred paths are the strings that last ended together.

    Each preferred path is a splay tree ordered by length; its root has the place, 0 for none.
    """

    def __init__(self, automaton: Automaton):
        states = len(automaton.length)
        self.length = automaton.length
        self.up = list(automaton.link)
        self.shorter, self.longer, self.place = [-1] * states, [-1] * states, [0] * states

    def _rotate(self, x: int) -> None:
        up, shorter, longer = self.up, self.shorter, self.longer
        y = up[x]
        z = up[y]
        if z >= 0:
            if shorter[z] == y:
                shorter[z] = x
            elif longer[z] == y:
                longer[z] = x
        up[x] = z
        if shorter[y] == x:
            moved = shorter[y] = longer[x]
            longer[x] = y
        else:
            moved = longer[y] = shorter[x]
            shorter[x] = y
        if moved >= 0:
            up[moved] = y
        up[y] = x

    def _splay(self, x: int) -> None:
        """Make the state the root of its splay tree, which keeps its place."""
        up, shorter, longer = self.up, self.shorter, self.longer
        while (y := up[x]) >= 0 and (shorter[y] == x or longer[y] == x):
            z = up[y]
            inner = z >= 0 and (shorter[z] == y or longer[z] == y)
            # The last time this is the root.
            self.place[x] = self.place[z if inner else y]
            if inner:
                self._rotate(y if (shorter[y] == x) == (shorter[z] == y) else x)
            self._rotate(x)

    def end(self, state: int, place: int) -> Iterator[tuple[int, int]]:
        """Let all suffixes of a prefix end at a place (from 1). Gives ``(length, place)``, longest first:
        suffixes up to this length, but for the shorter ones that follow, ended last at that place."""
        below, at = -1, state
        while at > 0:
            self._splay(at)
            if self.place[at]:
                yield self.length[at], self.place[at]
            cut = self.longer[at]
            if cut >= 0:
                self.place[cut] = self.place[at]
            self.longer[at] = below
            below, at = at, self.up[at]
        if below >= 0:
            self.place[below] = place


def squares(sequence: list[int]) -> Iterator[tuple[int, int]]:
    """``(end, period)``: here ends a string that is twice the same; every run gives at least one such
    end, with its smallest period."""
    automaton = Automaton(sequence)
    places = LastPlaces(automaton)
    for place in range(1, len(sequence) + 1):
        for length, before in places.end(automaton.prefixes[place], place):
            if place - before <= length:
                yield place, place - before


def _extended(numbers: np.ndarray, end: int, period: int) -> tuple[int, int]:
    """The stretch around the square, start and end, in which the period holds."""

    def equal(at: int, step: int) -> int:
        """How many words from ``at`` on, in this direction, equal the one a period before."""
        total, width = 0, 16
        while True:
            stop = at + step * width
            low, high = (at, min(stop, len(numbers))) if step > 0 else (max(stop + 1, period), at + 1)
            if low >= high:
                return total
            same = numbers[low:high] == numbers[low - period : high - period]
            different = np.flatnonzero(~same[::step])
            if len(different):
                return total + int(different[0])
            total, at, width = total + high - low, at + step * (high - low), width * 2

    return end - period - equal(end - 1, -1), end + equal(end, 1)


def runs_of_stretch(numbers: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence of numbers, by start, then period."""
    found, seen = [], {}
    for end, period in squares(numbers.tolist()):
        # Runs of one period overlap in less than it, so another square up to a run's end is the same run's.
        if seen.get(period, 0) < end:
            start, stop = _extended(numbers, end, period)
            seen[period] = stop
            if stop - start >= max(least, PERIODS * period):
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(numbers: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Parts, start and end, that together hold all runs.

    A run has ``least`` words and two periods or more, so each of its words lies in a group of ``least // 2``
    words of the run that stands there again a period earlier or later. Groups meet by a hash; one
    that meets by accident makes a part longer, no more.
    """
    width = max(1, least // PERIODS)
    count = len(numbers) - width + 1
    if count < 2:
        return
    groups = np.zeros(count, np.uint64)
    for i in range(width):
        groups = (groups ^ numbers[i : i + count].astype(np.uint64)) * _MIX
        groups ^= groups >> np.uint64(29)
    order = np.argsort(groups)
    same = groups[order[1:]] == groups[order[:-1]]
    if not same.any():
        return
    again = np.zeros(count + 2, bool)
    again[1 + order[1:][same]] = again[1 + order[:-1][same]] = True
    change = np.diff(again.astype(np.int8))
    stop = -1
    for first, behind in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
        if first > stop:
            if stop >= 0:
                yield start, stop
            start = first
        stop = behind + width - 1
    yield start, stop


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def find_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start, then period; start is a word's number."""
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    found = []
    for start, stop in repeated_stretches(numbers, least):
        if stop - start >= least:
            part = runs_of_stretch(numbers[start:stop], least)
            found += [(start + s, length, period) for s, length, period in part]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, of every run only the first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, keep.tolist()) if k)


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST
) -> DataFrame:
    """``(id, n_words, runs, kept)``: one row per row of ``docs``.

    ``runs`` are ``(start, length, period)`` in words, by start, then period: every stretch of at least
    ``least`` words and two periods, of smallest period, that no neighbouring word extends. ``kept`` is the
    text with the first period of each run only, its words joined by one blank.

    Null and empty texts have no words and no runs; null ids are kept, repeated rows have equal answers,
    an empty table gives no rows. Other columns are not read. A task holds the automaton of one
    stretch of one text at a time, some hundred bytes per word of it.
    """
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                found = find_runs(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(collapsed(words, found).decode("utf-8", "surrogatepass"))
            columns = [batch["id"], pa.array(counts, pa.int64()), pa.array(runs, run), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "kept"])

    if least < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shown = "array<struct<start:bigint,length:bigint,period:bigint>>"
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(per_batch, f"id {id_type}, n_words bigint, runs {shown}, kept string")
