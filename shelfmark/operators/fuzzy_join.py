"""All pairs of names and patterns within an edit distance, without comparing all pairs.

A name cut into d + 1 pieces keeps at least one of them unchanged in any text within distance d,
and that piece can have moved by a few bytes only (the partition scheme of Pass-Join, Li et al.,
VLDB 2011). So names are keyed by their pieces, patterns by the substrings that could be such a
piece, and an equality join on (name length, piece number, piece) finds every candidate. Names of
d bytes or fewer cannot be cut that way; they are keyed by single bytes instead, because a pattern
longer than d must share one with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import for_value
from shelfmark.plans.sizing import (
    BROADCAST_BYTES,
    broadcast_if_small,
    join_hot_keys,
    keep_keys_of,
    keep_known,
    spread,
)
from shelfmark.plans.storage import reliable

# Marks for keys of names that are too short to be cut: any such name, one of its bytes.
ANY_SHORT, SHORT_BYTE = -1, -2

# The key expressions are SQL over a text ``t`` of one character per byte and a distance ``{d}``.
# Keys are hashes: short to join on, and a collision is one more pair to verify. Piece ``i`` of a
# name of ``n`` bytes: pieces are even, the last ones a byte longer.
_FIRST_LONGER = "({d} + 1 - n % ({d} + 1))"
_START = f"CAST(n div ({{d}} + 1) * i + greatest(0, i - {_FIRST_LONGER}) AS INT)"
_SIZE = f"CAST(n div ({{d}} + 1) + IF(i >= {_FIRST_LONGER}, 1, 0) AS INT)"
_ANY = f"xxhash64({{d}}, {ANY_SHORT}, 0, '')"
_BYTES = f"""
  transform(array_distinct(transform(sequence(1, char_length(t)), p -> substring(t, p, 1))),
            c -> xxhash64({{d}}, {SHORT_BYTE}, 0, c))"""
_NO_INTS, _NO_KEYS = "CAST(array() AS ARRAY<INT>)", "CAST(array() AS ARRAY<BIGINT>)"

_NAME_KEYS = f"""
IF(char_length(t) > {{d}},
  flatten(transform(array(char_length(t)), n ->
    transform(sequence(0, {{d}}), i -> xxhash64({{d}}, n, i, substring(t, {_START} + 1, {_SIZE}))))),
  concat(array({_ANY}), IF(t = '', {_NO_KEYS}, {_BYTES})))
"""

# Where a piece can have moved to in the pattern: the bytes before and after it differ in number
# by the shift, and all differences together are at most the distance.
_SHIFT = "(char_length(t) - n)"
_LOW = f"greatest(0, {_START} - CAST(floor(({{d}} - {_SHIFT}) / 2) AS INT))"
_HIGH = f"least(char_length(t) - {_SIZE}, {_START} + CAST(floor(({{d}} + {_SHIFT}) / 2) AS INT))"
_SHORTEST = "greatest({d} + 1, char_length(t) - {d})"

_PATTERN_KEYS = f"""
concat(
  array_distinct(flatten(transform(
    IF(char_length(t) + {{d}} >= {_SHORTEST}, sequence({_SHORTEST}, char_length(t) + {{d}}), {_NO_INTS}), n ->
    flatten(transform(sequence(0, {{d}}), i ->
      transform(IF({_HIGH} >= {_LOW}, sequence({_LOW}, {_HIGH}), {_NO_INTS}),
                p -> xxhash64({{d}}, n, i, substring(t, p + 1, {_SIZE})))))))),
  CASE WHEN char_length(t) <= {{d}} THEN array({_ANY})
       WHEN char_length(t) <= 2 * {{d}} THEN {_BYTES}
       ELSE {_NO_KEYS} END)
"""


def close_pairs(
    names: DataFrame,
    patterns: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    distances: list[int] | None = None,
) -> DataFrame:
    """Pairs of rows whose ``text`` columns are within the pattern row's ``distance`` (int).

    ``distances`` are those that occur, if the caller knows them. Every other column of both sides
    is kept; both sides must have distinct rows. Candidates are verified where they are found. A pair
    meets once per shared key; it counts where the key is the smallest that both have, so pairs are
    not shuffled to drop the repeats.
    """
    if distances is None:
        rows = patterns.select("distance").distinct().collect()
        distances = sorted(row.distance for row in rows) or [0]
    as_bytes = "decode(encode(text, 'UTF-8'), 'ISO-8859-1')"
    pattern_keys = f"array_distinct({for_value(as_bytes, _PATTERN_KEYS.format(d='distance'))})"
    # Written once: keys are the work, and each decision below reads them.
    keyed_patterns = reliable(
        spread(patterns).selectExpr(
            "*", f"{as_bytes} AS pattern_bytes", f"explode({pattern_keys}) AS key"
        ).drop("text")
    )
    name_keys = ", ".join(_NAME_KEYS.format(d=d) for d in distances)
    own_keys = f"array_distinct({for_value(as_bytes, f'concat({name_keys})')})"
    keys = keep_known(own_keys, keyed_patterns)
    keyed_names = names.selectExpr(
        "*", f"{as_bytes} AS name_bytes", f"explode({keys}) AS key"
    ).drop("text")
    small = broadcast_if_small(keyed_patterns, broadcast_bytes) is not None
    if not small:
        keyed_names = reliable(keep_keys_of(keyed_names, keyed_patterns, "key"))
    candidates = join_hot_keys(keyed_names, keyed_patterns, "key", known_small=small)
    # The limit of the early-stopping distance must be a literal: one branch per distance.
    close = F.lit(False)
    for d in distances:
        hit = F.levenshtein(F.col("name_bytes"), F.col("pattern_bytes"), d) >= 0
        close = F.when(F.col("distance") == d, hit).otherwise(close)
    # Worked out again for true pairs only: keys would make every candidate row many times as long.
    shared = F.array_intersect(
        F.expr(for_value("name_bytes", f"concat({name_keys})")),
        F.expr(for_value("pattern_bytes", _PATTERN_KEYS.format(d="distance"))),
    )
    once = F.when(close, F.array_min(shared) == F.col("key")).otherwise(F.lit(False))
    kept = [c for c in names.columns + patterns.columns if c != "text"]
    return candidates.filter(once).select(*kept)


def fuzzy_join(names: DataFrame, patterns: DataFrame, distance: int) -> DataFrame:
    """Distinct ``(name, pattern)`` with a byte edit distance of at most ``distance``.

    ``names`` has a column ``name``, ``patterns`` a column ``pattern``; case counts, so fold both
    sides first where it should not.
    """
    left = names.select("name").distinct().withColumn("text", F.col("name"))
    right = patterns.select("pattern").distinct().select(
        "pattern", F.col("pattern").alias("text"), F.lit(distance).alias("distance")
    )
    left = spread(left)
    return close_pairs(left, right, distances=[distance]).select("name", "pattern")
