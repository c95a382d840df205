import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import near_copies, packing
from shelfmark.llm.common import PORTION, portions
from shelfmark.llm.queries import QUERIES
from shelfmark.llm.tokens import Encoder, public_path

SF = "/root/testdata/sf0.001"
PATH = public_path("word_bpe_49k.json")


def check_places(rows, capacity):
    """Gapless from 0 in every sequence; how many sequences there are."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_equals_brute_force(spark):
    rows = QUERIES["op4_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer, wanted = Tokenizer.from_file(PATH), set()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            wanted.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == wanted
    assert len(rows) == len(wanted)
    least = -(-sum(r.length for r in rows) // 4096)
    assert check_places(rows, 4096) <= least + 2


def test_many_blocks_waste_little(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1.3, 60_000).astype(int) + 1, 4096)
    frame = spark.createDataFrame(
        [(i, 0, int(n)) for i, n in enumerate(lengths)], "row long, piece int, length long"
    ).repartition(4)
    rows = packing.pack(frame).join(frame, ["row", "piece"]).collect()
    assert len(rows) == len(lengths)
    assert check_places(rows, 4096) <= 1.01 * lengths.sum() / 4096


def test_edge_cases(spark, docs):
    frame = docs(None, "", (3, "same words"), (3, "same words"), (None, "x"), (4, "long " * 50_000))
    rows = packing.packed_documents(frame, PATH, 1).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 3 + 3 + 2 + 50_001
    check_places(rows, 4096)
    assert sorted(r.piece for r in rows if r.id == 4) == list(range(13))
    assert packing.packed_documents(frame.limit(0), PATH, 1).count() == 0


def test_word_by_word_equals_whole_texts():
    odd = [
        "'s x's 'S can't ''s !'s 's's  a  \n\n b \t c", "<|endoftext|>a", "İstanbul ŉ ſ Ÿ µ ª º ² ¼ x ­",
        "it's IT'S they'LL'ld", "  lead", "trail  ", "\n", "a\r\n b́ x", " ", "", "12 345 1a2b ½3",
        "日本語 text", "😀 x", "x\x1cy\x0bz\x85 w", "a" * 300, None,
    ]
    rng = np.random.default_rng(2)
    alphabet = list("a bB1'sStTdrelvm.!²½ \n\té×Ø ÿ'")
    odd += ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = Encoder(public_path(name))
        plain = Tokenizer.from_file(public_path(name))
        assert encode.pattern is not None
        for text in odd:
            ids = plain.encode(text or "", add_special_tokens=False).ids
            assert encode(text) == np.array(ids, "<u4").tobytes()


def test_portions_hold_all_rows_in_order():
    texts = ["abc", None, "", "é" * 50, "x" * 8, "y", None, "z" * 3, "w" * 30]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(9)), "text": pa.array(texts, pa.string())})
    parts = list(portions(iter([batch, batch.slice(3, 4), batch.slice(0, 0)]), 10))
    assert [r for p in parts for r in p.to_pylist()] == [*batch.to_pylist(), *batch.slice(3, 4).to_pylist()]
    assert [p.num_rows for p in parts] == [4, 1, 4, 1, 3, 0]


@pytest.mark.parametrize("stage", ["pieces", "prefixes"])
def test_a_batch_of_many_texts_leaves_in_portions(docs, monkeypatch, stage):
    frame, taken = docs("a"), []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    for module in (packing, near_copies):
        monkeypatch.setattr(module, "step", lambda df: df)
    monkeypatch.setattr(near_copies, "_frequent", lambda *a: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    if stage == "pieces":
        packing.pieces(frame, PATH, 1)
    else:
        near_copies._prefixes(near_copies._rows(frame, "doc_id", "text"), 5, 0.8)
    numbers = pa.array(range(900))
    columns = {"id": numbers, "row": numbers, "node": numbers, "doc": numbers.cast(pa.string())}
    batch = pa.RecordBatch.from_pydict(columns | {"text": ["some words " * 1500] * 900})
    out = list(taken[0](iter([batch])))
    assert [i for b in out for i in dict.fromkeys(b["id"].to_pylist())] == list(range(900))
    assert len(out) == -(-len("some words ") * 1500 * 900 // PORTION)
