"""SentencePiece ids by the prefix table of a vocabulary of merges, and texts back from ids.

Every prefix of a text has its own encoding, and the last token of that encoding is unique: of all
pieces that end there (an Aho-Corasick automaton names them) it is the one that stands next to the
last token of the prefix before it without a merge across the border. So one pass from the left
stores a token per prefix, and one pass backwards over the table reads off the ids.

Where no piece of the vocabulary goes on after a word, or over the end of a line, a text is cut there,
and a process keeps the ids of the words it has seen.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A process remembers so many words, and once more as many that it used before those; longer ones not.
REMEMBERED, LONGEST = 200_000, 64
#: A process remembers so many answers about neighbours.
NEIGHBOURS = 400_000
#: So many texts are worked on at a time.
ROWS = 500

BLANK, LINE = "▁", "\n"


class Merges:
    """Which pieces may stand side by side in an encoding, from the pieces' scores alone.

    The best score merges first, of equal ones the leftmost. A piece is made by merges inside it, so
    the symbols at its left (right) end are a chain, from one character up to the piece, each with the
    moment at which the next one takes its place. A merge across the border between two pieces happens
    if two such end symbols exist at the same moment and make a piece that comes before either is used up.
    """

    def __init__(self, scores: dict[str, float]):
        self.moment = {piece: -score for piece, score in scores.items()}
        self._chains: dict[str, tuple | None] = {}

    def _merged(self, piece: str) -> tuple[list, list] | None:
        """The symbols at both ends of the piece with the moments they were made; ``None`` if merging
        its characters does not give the piece."""
        symbols, done = list(piece), -inf
        left, right = [(symbols[0], -inf)], [(symbols[-1], -inf)]
        while len(symbols) > 1:
            moment, at = min(
                (self.moment.get(a + b, inf), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            )
            if moment == inf:
                return None
            if moment < done:
                raise ValueError(f"{piece!r} is not made by merges of falling scores")
            done = moment
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if at == 0:
                left.append((symbols[0], moment))
            if at == len(symbols) - 1:
                right.append((symbols[-1], moment))
        return left, right

    def chains(self, piece: str) -> tuple[list, list] | None:
        """``(symbol, moment at which it is used up)`` at the left end and at the right end."""
        if piece not in self._chains:
            made = self._merged(piece)
            self._chains[piece] = made and tuple(
                [(s, until) for (s, _), (_, until) in zip(side, [*side[1:], ("", inf)])] for side in made
            )
        return self._chains[piece]

    def fit(self, before: str, piece: str) -> bool:
        """Whether nothing merges across the border of the two; before a first piece there is nothing."""
        made = self.chains(piece)
        if made is None or not before:
            return made is not None
        lasts, firsts = self.chains(before)[1], made[0]
        i = j = 0
        while True:
            (last, last_until), (first, first_until) = lasts[i], firsts[j]
            moment = self.moment.get(last + first, inf)
            # At one moment the merge further left goes first.
            if moment < inf and moment < last_until and moment <= first_until:
                return False
            if last_until == first_until == inf:
                return True
            if last_until <= first_until:
                i += 1
            else:
                j += 1


class _Fits(dict):
    """Pairs of neighbours to whether they fit."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= NEIGHBOURS:
            self.clear()
        found = self[pair] = self.merges.fit(*pair)
        return found


class _Ids(dict):
    """Pieces, and single characters, to their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: dict[str, int], as_bytes: dict[int, int]):
        super().__init__((piece, struct.pack("<I", i)) for piece, i in pieces.items())
        self.as_bytes = as_bytes

    def __missing__(self, sign: str) -> bytes:
        return b"".join(struct.pack("<I", self.as_bytes[b]) for b in sign.encode())


class _Words(dict):
    """Words to the ids that they have behind a blank; behind a line's end if it stands before them."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word[1:] if word[:1] == LINE else BLANK + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Ids of whole texts with begin and end id, equal to the library's, and its texts of ids."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        as_bytes = [i for i in range(size) if model.is_byte(i)]
        if len(as_bytes) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError(f"{path}: a vocabulary of merges with all bytes and without unused pieces is needed")
        others = special | set(as_bytes)
        pieces = {model.id_to_piece(i): i for i in range(size) if i not in others}
        self.ids = _Ids(pieces, {int(model.id_to_piece(i)[3:5], 16): i for i in as_bytes})
        self.fits = _Fits(Merges({p: model.get_score(i) for p, i in pieces.items() if len(p) > 1}))
        self.automaton = ahocorasick.Automaton()
        for piece in {*pieces, *"".join(pieces)}:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.known = frozenset("".join(pieces))
        self.by_word = not any(LINE in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.words = _Words(self.encode_part)
        self.begin, self.end = (struct.pack("<I", i) for i in (model.bos_id(), model.eos_id()))

    def tokens(self, text: str) -> list[str]:
        """The pieces of a text, and its unknown characters; nothing is normalised."""
        # The last token of each prefix, by the prefix's length.
        table: list[str | None] = [""] + [None] * len(text)
        if not self.known.issuperset(text):
            table[1:] = [None if c in self.known else c for c in text]
        fits = self.fits
        for last, (piece, length) in self.automaton.iter(text):
            end = last + 1
            if table[end] is None and fits[table[end - length], piece]:
                table[end] = piece
        found, at = [], len(text)
        while at:
            found.append(table[at])
            at -= len(table[at])
        return found[::-1]

    def encode_part(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.tokens(text)))

    def encode_blanks(self, words: list[str]) -> Iterator[bytes]:
        """Ids where blanks follow each other: they belong together with the word behind them."""
        blanks = ""
        for word in words[:-1]:
            if word:
                yield self.encode_part(blanks + BLANK + word)
                blanks = ""
            else:
                blanks += BLANK
        yield self.encode_part(blanks + BLANK + words[-1])

    def encode(self, text: str | None) -> bytes:
        """Begin id, ids and end id, little-endian unsigned 32-bit; a null text is empty."""
        text = self.library.normalize(text) if text else ""
        if not self.by_word:
            return self.begin + self.encode_part(text) + self.end
        found, known = [self.begin], self.words.__getitem__
        for at, line in enumerate(text.split(LINE)):
            if at:
                found.append(self.ids[LINE])
            first, *words = line.split(BLANK)
            if first:
                found.append(known(LINE + first))
            found.extend(self.encode_blanks(words) if "" in words else map(known, words))
        return b"".join((*found, self.end))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def codec(path: str) -> Codec:
    """One per Python process, for all its tasks.

    A task may bring its own copy of this module, so the process keeps the codecs.
    """
    kept = vars(sys).setdefault("_piece_codecs", {})
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def _recoded(rows: DataFrame, path: str, given: list[str], recode) -> DataFrame:
    """``(id, ids)`` and, where it is wanted, ``text``, from ``recode`` of a codec and of each row's value."""
    column, names = given[0], ["id", *given[1:]]
    types = {"ids": pa.binary(), "text": pa.string()}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = list(zip(*(recode(known, value.as_py()) for value in part[column])))
                made = [pa.array(values, types[name]) for values, name in zip(found, given[1:])]
                yield pa.RecordBatch.from_arrays([part["id"], *made], names)

    shown = {"ids": "ids binary", "text": "text string"}
    columns = ", ".join(["id " + rows.schema["id"].dataType.simpleString(), *(shown[n] for n in given[1:])])
    return rows.mapInArrow(per_batch, columns)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: one row per row of ``docs``; ids are little-endian unsigned 32-bit integers.

    Null and empty texts have the begin and the end id alone; null ids are kept, repeated rows have
    equal answers, an empty table gives no rows. Other columns are not read.
    """
    rows = _texts(docs, id_col, text_col)
    return _recoded(rows, path, ["text", "ids"], lambda known, text: (known.encode(text),))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(id, ids, text)`` of the rows of ``encode``: the text as the library gives it back. Rows whose
    ids are null have a null text."""

    def recode(known: Codec, ids: bytes | None) -> tuple:
        return ids, None if ids is None else known.decode(ids)

    return _recoded(encoded.select("id", "ids"), path, ["ids", "ids", "text"], recode)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``, in one pass of one Python process per task."""

    def recode(known: Codec, text: str | None) -> tuple:
        ids = known.encode(text)
        return ids, known.decode(ids)

    return _recoded(_texts(docs, id_col, text_col), path, ["text", "ids", "text"], recode)
