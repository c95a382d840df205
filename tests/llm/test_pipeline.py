import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm.tokens import public_path
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_near_copies import brute_first
from tests.llm.test_packing import check_places

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path, groups):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = benchmark.first().text
    first = documents.orderBy("doc_id").first()
    planted = [
        (100_001, "日本語の文章です。" * 20, "ja", "src1", 180), (100_002, None, "en", "src2", 0),
        (100_003, first.text.replace(" ", " \n\t", 1), "fr", "src3", 9), (100_004, first.text[0].swapcase() + first.text[1:], "fr", "src4", 9),
        (100_005, "In the " + passage, "en", "src5", 9), (100_006, " ... 12", "en", "src0", 7),
    ]
    both = documents.unionByName(spark.createDataFrame(planted, documents.schema))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id: r.text for r in both.collect()}
    for i in (100_001, 100_002, 100_006):
        del kept[i]
    seen = {}
    for i in sorted(kept):
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in seen.values()}
    first = brute_first(kept, groups)
    kept = {i: t for i, t in kept.items() if i in first}
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    judged = {i: hits(t, items) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not (judged[i][1] and 20 * judged[i][1] >= judged[i][0])}
    assert 100_003 not in kept and 100_004 not in kept and 100_005 not in kept
    tokenizer, wanted = Tokenizer.from_file(public_path("word_bpe_49k.json")), set()
    for i, text in kept.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            wanted.add((i, start // 4096, start, len(part), zlib.crc32(part.tobytes())))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == wanted
    assert len(rows) == len(wanted)
    assert check_places(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
