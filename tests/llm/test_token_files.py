import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import rans, token_files
from shelfmark.llm.queries import QUERIES
from shelfmark.llm.tokens import public_path

SF = "/root/testdata/sf0.001"
PATH = public_path("byte_bpe_50k.json")


def test_query_equals_brute_force(spark):
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_token_files"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer, wanted, start = Tokenizer.from_file(PATH), {}, 0
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        wanted[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert found == wanted


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 3000), st.integers(0, 10**6))
def test_blocks_round_trip(n, kinds, seed):
    rng = np.random.default_rng(seed)
    symbols = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    counts = np.bincount(np.concatenate([symbols, [0, 7]]))
    present = np.flatnonzero(counts)
    table = rans.Table(present, counts[present])
    assert int(table.freq.sum()) == 1 << rans.PRECISION
    block = rans.encode(symbols, table)
    assert (rans.decode(block, table) == symbols).all()


def test_checkpoints_and_damage():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 900, 200_001).astype(np.uint16)
    table = rans.Table(np.arange(900), np.bincount(symbols))
    block = rans.encode(symbols, table)
    marks = rans.checkpoints(block, table)
    assert marks == 4
    parts = [rans.decode(block, table, i, i + 1) for i in reversed(range(marks))]
    assert (np.concatenate(parts[::-1]) == symbols).all()
    assert len(rans.decode(block, table, marks)) == 0
    assert len(block) < 200_001 * 10 / 8 * 1.1 + 5 * 8 * rans.LANES
    for damaged in (block[:-1], block[:50], b"x" + block[1:], block[:-9] + b"\0" + block[-8:]):
        with pytest.raises(rans.DamagedBlock):
            rans.decode(damaged, table)
    with pytest.raises(rans.DamagedBlock):
        rans.decode(block, rans.Table(np.arange(900), np.arange(1, 901)))
    with pytest.raises(ValueError):
        rans.encode(np.array([900]), table)


def test_blocks_of_other_lanes_are_read(monkeypatch):
    """Files say how many lanes they have; checkpoints stay where they were."""
    rng = np.random.default_rng(7)
    symbols = rng.integers(0, 900, 200_001).astype(np.uint16)
    table = rans.Table(np.arange(900), np.bincount(symbols))
    for lanes in (512, 1024):
        with monkeypatch.context() as patched:
            patched.setattr(rans, "LANES", lanes)
            block = rans.encode(symbols, table)
        assert rans.checkpoints(block, table) == 4
        assert (rans.decode(block, table) == symbols).all()
        assert (rans.decode(block, table, 1, 3) == symbols[1 << 16 : 3 << 16]).all()


def test_edge_cases(spark, docs, tmp_path):
    frame = docs((5, None), (5, ""), (None, "no id"), (9, "same"), (9, "same"), (-3, "long word " * 40_000))
    token_files.write_token_files(frame, f"{tmp_path}/a", PATH, 2, block=100)
    rows = token_files.read_token_files(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.id for r in rows] == [None, -3, 5, 5, 9, 9]
    assert [r.n_tokens for r in rows if r.id in (5, 9)] == [1, 1, 2, 2]
    at = 0
    for r in rows:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    token_files.write_token_files(frame.limit(0), f"{tmp_path}/b", PATH, 2)
    assert token_files.read_token_files(spark, f"{tmp_path}/b").count() == 0
