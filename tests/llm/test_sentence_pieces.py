import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from shelfmark.llm import sentence_pieces
from shelfmark.llm.queries import QUERIES
from shelfmark.llm.tokens import public_path

SF = "/root/testdata/sf0.01"
PATH = public_path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)


def brute(text):
    return [LIBRARY.bos_id(), *LIBRARY.encode(text or ""), LIBRARY.eos_id()]


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.fixture(scope="module")
def codec():
    return sentence_pieces.codec(PATH)


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_sentence_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = brute(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_random_pieces_equal_the_library(codec):
    rng = random.Random(13)
    pieces = [LIBRARY.id_to_piece(i) for i in range(LIBRARY.vocab_size())]
    others = [" ", "  ", " " * 9, " " * 33, "\n", "\n\n", "\t", "\r", "\0", "é", "日本", "😀", "é", "▁", "▁▁▁", "a", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces if rng.random() < 0.5 else others) for _ in range(rng.randrange(9)))
        for text in (text, text.replace("▁", " ")):
            ids = ids_of(codec.encode(text))
            assert ids == brute(text), text
            assert codec.decode(codec.encode(text)) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAbeinst 1.-=▁\n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_equals_the_library(text):
    assert ids_of(sentence_pieces.codec(PATH).encode(text)) == brute(text)


def test_the_last_token_of_each_prefix_is_unique(codec):
    """What the table rests on: exactly one piece that ends a prefix fits the token before it."""
    for text in ("▁untranslatable", "▁" * 21 + "the", "▁aaaaaaaaaaaaaaaaa", "▁--------=========", "▁日本語の"):
        table = [""]
        for end in range(1, len(text) + 1):
            fitting = [
                text[start:end] for start in range(end)
                if text[start:end] in codec.ids and codec.fits[table[start], text[start:end]]
            ]
            assert len(fitting) == 1
            table.append(fitting[0])
            assert codec.tokens(text[:end])[-1] == fitting[0]


def test_vocabularies_of_another_kind_are_refused():
    merges = sentence_pieces.Merges({"ab": -5.0, "abc": -1.0})
    with pytest.raises(ValueError, match="falling scores"):
        merges.chains("abc")
    # Not reached by merges, so never a token.
    assert sentence_pieces.Merges({"abc": -1.0}).chains("abc") is None


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    monkeypatch.setattr(sentence_pieces, "NEIGHBOURS", 5)
    own = sentence_pieces.Codec(PATH)
    text = "every word of this text is another one, and some of the words are the same words " * 2
    assert ids_of(own.encode(text)) == brute(text)
    assert len(own.words) <= 3 and len(own.fits) <= 5


def test_edge_cases(spark, docs):
    long = "x" * 200_000 + " " * 50_000 + "日本語" * 20_000
    frame = docs((1, None), (2, ""), (None, " no id"), (4, "same"), (4, "same"), (5, long), (6, "\n \n"))
    encoded = sentence_pieces.encode(frame, PATH)
    assert encoded.columns == ["id", "ids"]
    rows = sentence_pieces.decode(encoded, PATH).collect()
    assert len(rows) == 7
    by_id = {r.id: r for r in rows}
    for key, text in ((1, None), (2, ""), (None, " no id"), (4, "same"), (5, long), (6, "\n \n")):
        assert ids_of(by_id[key].ids) == brute(text)
        assert by_id[key].text == (text or "")
    key = lambda r: str(tuple(r))
    assert sorted(rows, key=key) == sorted(sentence_pieces.round_trip(frame, PATH).collect(), key=key)
    assert sentence_pieces.decode(encoded.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None)], "id long, ids binary")
    assert [tuple(r) for r in sentence_pieces.decode(nothing, PATH).collect()] == [(1, None, None)]
