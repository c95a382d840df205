"""The operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.llm import (
    decontaminate as dc,
    exact_dedup,
    language_id,
    merkle,
    packing,
    periodic_runs,
    quality,
    secrets,
    sentence_pieces,
    simhash,
    suffix_dedup,
    token_files,
    window_dedup,
)
from shelfmark.llm.common import table, text_or_empty
from shelfmark.llm.tokens import public_path
from shelfmark.plans.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the session and the table folder under a name."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query(
    "op6_exact_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS d
      FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, d AS text_sha256
    FROM n WINDOW g AS (PARTITION BY d)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.membership(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION_SQL = f"""
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bi AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
           FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM bi)),
    dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
           FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i
                 FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
    hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
    judged AS (SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
                      coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
                      coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
               FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id))"""


@query("op1_decontamination", f"WITH {DECONTAMINATION_SQL} SELECT * FROM judged")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        dc.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_path("word_bpe_49k.json")
    found = packing.pieces(table(spark, sf_dir, "documents"), tokenizer, end_id=1)
    placed = packing.pack(found)
    # Only the checksums travel to the places, not the ids.
    digests = found.select(
        F.col("id").alias("doc_id"), "row", "piece", "start", "length",
        F.crc32("ids").alias("ids_crc32"),
    )
    return digests.join(placed, ["row", "piece"]).drop("row")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    tokenizer = public_path("byte_bpe_50k.json")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2)
    return token_files.read_token_files(spark, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [
        F.size(secrets.of_kinds("spans", (kind,))).cast("bigint").alias(f"n_{kind}")
        for kind in secrets.BASE
    ]
    base = secrets.shown(secrets.of_kinds("spans", secrets.BASE))
    return found.select(
        F.col("id").alias("doc_id"), *counts,
        F.sha2(base, 256).alias("base_sha256"), secrets.shown("spans").alias("spans"),
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit_text_model(docs)
    found = language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    return found.select(
        F.col("id").alias("doc_id"), "declared", "text_language", "language", "posterior", "kept"
    )


@query("llm_page_languages")
def llm_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the text between the tags, the language in the markup, the host of the address."""
    model = language_id.fit_text_model(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ").alias("text"),
        F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"),
    )
    found = language_id.identify(
        pages, model, "page_id", declared=F.col("declared"), host=F.col("host")
    )
    return found.select(
        F.col("id").alias("page_id"), "declared", "host", "text_language", "language", "posterior", "kept"
    )


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op5_window_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
                FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d)),
    later AS (SELECT doc_id, i FROM windows
              QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k
             FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
    FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_path("piece_bpe_32k.model")
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), model).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth text or so, by its id, goes on with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        number = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        changed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, number(i).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", changed)).otherwise("")

    # The only element of an array of word lists, so that the text is split once.
    words = F.regexp_extract_all(text_or_empty("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(h % 10 == 0, F.transform(F.array(words), edited)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_periods(table(spark, sf_dir, "documents")))
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    first = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    ).alias("first")
    return found.select("*", first).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("first.col2")).alias("start"),
        F.col("first.length").alias("length"),
        (-F.col("first.col3")).alias("period"),
        F.floor(1000 * F.col("first.length") / -F.col("first.col3")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", shown), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


# CRC-32 bit by bit, as DuckDB has no function for it; a value is its length in bytes, a colon and itself.
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split({v}, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"""
_COUNTED = "coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
_HEAD = " || ".join(_COUNTED.format(v=c) for c in ("doc_id", "source", "lang", "n_chars"))

# Nodes level by level, their families, and the siblings on every document's way to the root.
MERKLE_SQL = f"""
    WITH RECURSIVE tampered AS (
      SELECT *, CASE WHEN {_CRC32.format(v="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '')
                     ELSE text END AS changed FROM documents),
    leaves AS (
      SELECT doc_id, coalesce('1' || source, '0') AS key, sha256({_HEAD} || {_COUNTED.format(v="text")}) AS leaf,
             sha256({_HEAD} || {_COUNTED.format(v="changed")}) AS changed FROM tampered),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n
      FROM leaves),
    node(key, level, i, n, d) AS (
      SELECT key, 0, i, n, leaf FROM numbered
      UNION ALL
      SELECT key, level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i))
      FROM node WHERE n > 1 GROUP BY key, level, i // 3),
    subroots AS (
      SELECT key, level AS height, d AS subroot, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n
      FROM node WHERE n = 1),
    upper_node(level, i, n, d) AS (
      SELECT 0, i, n, subroot FROM subroots
      UNION ALL
      SELECT level + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY i))
      FROM upper_node WHERE n > 1 GROUP BY level, i // 3),
    family AS (
      SELECT key, level, i // 3 AS p, list(d ORDER BY i) AS ds FROM node WHERE n > 1 GROUP BY ALL),
    upper_family AS (
      SELECT level, i // 3 AS p, list(d ORDER BY i) AS ds FROM upper_node WHERE n > 1 GROUP BY ALL),
    way AS (
      SELECT doc_id, level AS step, ds, i // CAST(pow(3, level) AS BIGINT) % 3 AS slot
      FROM numbered JOIN family f USING (key) WHERE p = i // CAST(pow(3, level + 1) AS BIGINT)
      UNION ALL
      SELECT doc_id, height + level, ds, s.i // CAST(pow(3, level) AS BIGINT) % 3
      FROM numbered JOIN subroots s USING (key) JOIN upper_family ON p = s.i // CAST(pow(3, level + 1) AS BIGINT)),
    beside AS (
      SELECT doc_id, step, array_to_string(ds[:slot], '') AS l, array_to_string(ds[slot + 2:], '') AS r FROM way),
    folded(doc_id, step, d) AS (
      SELECT doc_id, 0, changed FROM leaves
      UNION ALL
      SELECT f.doc_id, f.step + 1, sha256(l || d || r) FROM folded f JOIN beside b ON b.doc_id = f.doc_id AND b.step = f.step),
    proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM beside GROUP BY doc_id),
    ends AS (SELECT doc_id, arg_max(d, step) AS folded_root FROM folded GROUP BY doc_id)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM numbered JOIN subroots USING (key) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id),
         (SELECT d AS root FROM upper_node WHERE n = 1)
    """


@query("op12_merkle", MERKLE_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))
    ).otherwise(F.col("text"))

    def leaf(text: Column) -> Column:
        return merkle.leaf_digest(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)

    leaves = docs.select(
        F.col("doc_id").alias("id"), "source", leaf(F.col("text")).alias("digest"), leaf(tampered).alias("changed")
    )
    manifest = merkle.build(leaves)
    as_text = lambda c: F.lower(F.hex(c))
    return merkle.fold(manifest, "changed").select(
        F.col("id").alias("doc_id"), as_text("digest").alias("leaf"), as_text("subroot").alias("subroot"),
        F.lit(manifest.root).alias("root"), F.sha2(as_text("siblings"), 256).alias("proof_sha256"),
        as_text("folded").alias("folded_root"), (as_text("folded") == F.lit(manifest.root)).alias("verified"),
    )
