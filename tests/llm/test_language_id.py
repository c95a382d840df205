import pytest
from pyspark.sql import functions as F

from shelfmark.llm import language_id as li

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(documents):
    return li.fit_text_model(documents.filter("doc_id % 5 <> 0"))


def test_held_out_accuracy_of_the_text_alone(documents, model):
    rows = documents.filter("doc_id % 5 = 0")
    found = li.identify(rows, model).join(rows.withColumnRenamed("doc_id", "id"), "id")
    right, total = found.agg(F.sum((F.col("text_language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert total == rows.count() and right / total >= 0.97
    assert found.filter("NOT kept").count() == 0


def test_wrong_declarations_lose_their_weight(documents, model):
    """Two fifths of the rows declare a wrong language; short texts are still judged well."""
    rows = documents.filter("doc_id % 5 = 0").select(
        "doc_id", "lang", F.substring("text", 1, 400).alias("text"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("en-GB")).otherwise(F.col("lang")).alias("said"),
    )
    found = li.identify(rows, model, declared=F.col("said")).join(rows.withColumnRenamed("doc_id", "id"), "id")
    right, total = found.agg(F.sum((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right / total >= 0.95


def test_hosts_and_suffixes_decide_short_texts(spark, documents, model):
    """A text that says nothing follows its host, a new host its suffix, the rest all rows."""
    french = [r.text for r in documents.filter("lang = 'fr' AND n_chars > 300").limit(40).collect()]
    german = [r.text for r in documents.filter("lang = 'de' AND n_chars > 300").limit(60).collect()]
    rows = [(i, t, f"h{i % 2}.fr") for i, t in enumerate(french)]
    rows += [(1000 + i, t, "a.de") for i, t in enumerate(german)]
    rows += [(2000, "x", "h1.fr"), (2001, "x", "new.fr"), (2002, "x", None), (2003, "x", "new.de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, host string")
    plain = {r.id: r for r in li.identify(frame, model).collect()}
    fused = {r.id: r for r in li.identify(frame, model, host=F.col("host")).collect()}
    assert [fused[2000 + i].language for i in (0, 1, 3)] == ["fr", "fr", "de"]
    assert fused[2002].language == plain[2002].language
    assert fused[2000].posterior >= fused[2001].posterior


def test_edge_cases(spark, docs, model):
    long = "the thing that was " * 60_000
    frame = docs(None, "", "123 -- !", (3, "the whole of it"), (3, "the whole of it"), (None, long), "日本語の文章です" * 9)
    found = li.identify(frame, model, declared=F.col("id"), host=F.col("words"))
    got = [(r.id, r.language, r.kept) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(
        [(0, "und", False), (1, "und", False), (2, "und", False), (3, "en", True), (3, "en", True),
         (None, "en", True), (6, "und", False)], key=repr,
    )
    kept = li.keep_identified(frame, found)
    assert kept.columns == frame.columns
    assert sorted(r.text for r in kept.collect()) == sorted([long, "the whole of it", "the whole of it"])
    assert li.identify(frame.limit(0), model).count() == 0
    assert li.fit_text_model(frame.limit(0).withColumn("lang", F.lit("x"))).shape == (li.GRAMS, 5)
