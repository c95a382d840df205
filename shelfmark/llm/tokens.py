"""Token ids of texts by a public tokenizer file, word by word.

Both kinds of tokenizer here split a text into words first and encode each word on its own. So a
text is split by the tokenizer's own pattern, and the tokenizers library encodes each different word
once per process. That only holds for texts of common characters; any other text, and any tokenizer
of another kind, is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata

import numpy as np

#: A process remembers so many words, unless told otherwise, and once more as many that it used before
#: those. Longer words are not remembered.
REMEMBERED, LONGEST = 200_000, 64

# Basic Latin, Latin-1 and Latin Extended-A, without those whose lower case has two characters and
# without unusual blanks: here all Unicode versions agree on letters, numbers and case.
_COMMON = [c for c in map(chr, (*range(0x20, 0x7F), *range(0xA1, 0x180))) if c != "İ"]
_LETTERS = "".join(c for c in _COMMON if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _COMMON if unicodedata.category(c)[0] == "N")
_ALL_COMMON = re.compile(f"[\t\n\r{re.escape(''.join(_COMMON))}]*")

# The splitting patterns of the two public tokenizers, over the characters above.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
# Words of letters are tried first: no ending begins like one.
_BYTE_WORDS = re.compile(
    rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|{_ENDINGS}| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
_LOWER_WORDS = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|{_ENDINGS}|[^\s{_LETTERS}{_NUMBERS}]+")


def _byte_signs() -> dict[int, int]:
    """The character that stands for each byte in the vocabularies: itself where it can be seen, else
    the next one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255) or b == 173]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()
_SPACE = chr(_BYTE_SIGNS[ord(" ")])


class _Words(dict):
    """Word to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, remembered: int):
        super().__init__()
        self.model, self.remembered = tokenizer.model, remembered
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            # The words are split already, so the model alone is asked, about their bytes as signs.
            if word.isascii() and word.lstrip(" ").isprintable():
                signs = word.replace(" ", _SPACE)
            else:
                signs = word.encode().decode("latin-1").translate(_BYTE_SIGNS)
            found = [token.id for token in self.model.tokenize(signs)]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST:
            if len(self) >= self.remembered:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.words = _Words(self.tokenizer, remembered)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described["added_tokens"]]
        normalizer, split = described["normalizer"], described["pre_tokenizer"] or {}
        self.lower, self.pattern = False, None
        if described["model"].get("dropout") is None:
            if normalizer is None and split.get("type") == "ByteLevel":
                if split["use_regex"] and not split["add_prefix_space"]:
                    self.pattern = _BYTE_WORDS
            elif [n["type"] for n in (normalizer or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                steps = split.get("pretokenizers", [{}])
                if steps[0].get("pattern", {}).get("Regex") == rf"{_ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+":
                    self.lower, self.pattern = True, _LOWER_WORDS

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; a null text has none."""
        text = text or ""
        plain = self.pattern is not None and _ALL_COMMON.fullmatch(text) is not None
        if not plain or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        words = self.pattern.findall(text.lower() if self.lower else text)
        return b"".join(map(self.words.__getitem__, words))

    def forget(self) -> None:
        """Give back the words remembered, when a task ends and the process may do other work next."""
        self.words.clear()
        self.words.before = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One per Python process, for all its tasks.

    A task may bring its own copy of this module, so the process keeps the encoders.
    """
    kept = vars(sys).setdefault("_token_encoders", {})
    if (path, remembered) not in kept:
        kept[path, remembered] = Encoder(path, remembered)
    return kept[path, remembered]


def public_path(name: str) -> str:
    """Where a public tokenizer file is; the files are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
