"""Secrets in texts: keywords by Aho-Corasick, anchored patterns only where one was found.

Assignments, access keys and tokens start with a fixed word. One automaton finds all of them in one
pass over the text, and a pattern is tried at these places only. Tokens with a checksum of their own
are kept if it fits. Hexadecimal runs have no keyword; they are one plain character class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Order among spans with one start. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

# Keywords, prefixes and shapes of the kinds.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_REST = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_CHECKED = re.compile(r"([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN_LEAST, ACCESS_LEAST = 6, 20


def token_checksum(body: str) -> str:
    """CRC-32 of a token's first 30 characters as six digits of base 62."""
    value, digits = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits


@cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in _ASSIGN_WORDS:
        automaton.add_word(word, ("assign", len(word)))
    automaton.add_word("akia", ("access", 4))
    for prefix in _GITHUB_PREFIXES:
        automaton.add_word(prefix, ("github", 4))
    automaton.add_word("npm_", ("npm", 4))
    automaton.make_automaton()
    return automaton


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind as listed; code points, end exclusive."""
    text = text or ""
    found = [("hex", *m.span()) for m in _HEX.finditer(text)]
    # Per kind matches do not overlap; a match that is too short uses up its place all the same.
    free = dict.fromkeys(KINDS, 0)
    # No word contains another, so the hits come in the order of their starts.
    for last, (kind, length) in _automaton().iter(_ascii_lower(text)):
        start = last + 1 - length
        if start < free[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN_REST.match(text, last + 1)
            good = m is not None and len(m[1]) >= ASSIGN_LEAST
        elif kind == "access":
            m = _ACCESS.match(text, start)
            good = m is not None and m.end() - start >= ACCESS_LEAST
        else:
            plain = text[start : last + 1].islower()
            m = _CHECKED.match(text, last + 1) if plain else None
            good = m is not None and token_checksum(m[1]) == m[2]
        if m is not None:
            free[kind] = m.end()
            if good:
                found.append((kind, start, m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)``, one row per row of ``docs``; spans are ``(kind, start, end)``.

    Null texts are empty and have no spans; null ids are kept. Repeated rows have equal answers; an
    empty table gives no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text.as_py())]
                for text in batch["text"]
            ]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, span)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(per_batch, f"id {id_type}, spans {spans}")


def shown(spans: str | Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )


def of_kinds(spans: str | Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
