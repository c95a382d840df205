"""Languages of documents by Bayesian fusion of what the text, its markup and its address say.

* Text: likelihood of its hashed byte trigrams under each language, counted over all labelled rows.
  A uniform model stands for every language that is not among those asked for (``und``).
* Declared language (markup, metadata): P(declared | language), estimated from all rows by grouped
  sums of the text's posteriors, so a source of wrong declarations loses its weight.
* Address: the prior of a host is smoothed towards that of its suffix, that one towards the prior of
  all rows; a row's own text is left out of its host's sums.

Only grouped sums are shuffled, and the short evidence rows where a table of hosts is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import doc_key, only_with, packed, portions, step, unpacked
from shelfmark.plans.sizing import join_hot_keys

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "und"

#: Buckets of the hashed trigrams.
GRAMS = 1 << 15
#: Every byte is part of three trigrams, which are not independent.
TEMPER = 1 / 3
#: Weight of the parent's prior in rows, and added counts of a declared language.
SMOOTHING, ADDED = 20.0, 1.0
#: Share of rows in other languages before anything is known.
OTHER_PRIOR = 0.01
#: Least posterior with which a document is kept.
LEAST = 0.5

_SLICE = 1 << 20


def _grams(text: str | None) -> Iterator[np.ndarray]:
    """Trigram buckets of a text in slices; its ASCII letters lower-cased, blanks at both ends."""
    data = np.frombuffer(b" %b " % (text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    for at in range(0, len(data) - 2, _SLICE):
        part = data[at : at + _SLICE + 2].astype(np.uint32)
        code = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        yield (code * np.uint32(2654435761)) >> np.uint32(17)


def fit_text_model(
    docs: DataFrame,
    label_col: str = "lang",
    text_col: str = "text",
    languages: tuple[str, ...] = LANGUAGES,
) -> np.ndarray:
    """Log-probabilities of trigram buckets, one column per language and a uniform one.

    Counts cover all rows; rows with another label or none add nothing. The result has
    ``GRAMS`` x (languages + 1) values, whatever the corpus.
    """

    def per_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), GRAMS), np.int64)
        waiting: list[list[np.ndarray]] = [[] for _ in languages]

        def add(i: int) -> None:
            if waiting[i]:
                counts[i] += np.bincount(np.concatenate(waiting[i]), minlength=GRAMS)
                waiting[i].clear()

        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                i = languages.index(label.as_py())
                for grams in _grams(text.as_py()):
                    waiting[i].append(grams)
                    if len(waiting[i]) >= 64:
                        add(i)
        for i in range(len(languages)):
            add(i)
        which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[which, bucket])],
            ["language", "bucket", "count"],
        )

    rows = docs.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("label").isin(*languages))
    counted = rows.mapInArrow(per_part, "language int, bucket int, count long")
    found = counted.groupBy("language", "bucket").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros((GRAMS, len(languages)))
    counts[found["bucket"].to_numpy(), found["language"].to_numpy()] = found["count"].to_numpy()
    # Unseen buckets share one count in all per language, so rare ones stay below the uniform model.
    smooth = counts + 0.01
    logs = np.log(smooth / smooth.sum(axis=0))
    return np.column_stack([logs, np.full(GRAMS, -np.log(GRAMS))]).astype(np.float32)


def text_likelihoods(
    docs: DataFrame, model: np.ndarray, text_col: str = "text", keep: dict[str, Column] | None = None
) -> DataFrame:
    """The columns ``keep``, ``ll`` (log-likelihood per language, last: other), ``t`` (posteriors by the
    text alone) and ``letters``. Written once."""
    rows = docs.select(*(c.alias(n) for n, c in (keep or {}).items()), F.col(text_col).alias("text"))
    names = rows.columns[:-1]

    def likelihood(text: str | None) -> np.ndarray:
        total = np.zeros(model.shape[1])
        for grams in _grams(text):
            total += model[grams].sum(axis=0, dtype=np.float64)
        return total * TEMPER

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [t.as_py() for t in batch["text"]]
            found = np.array([likelihood(t) for t in texts]).reshape(len(texts), -1)
            found = found.reshape(len(texts), model.shape[1])
            alone = _softmax(found + np.log(_base(model.shape[1])))
            letters = pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), _lists(found), _lists(alone), letters],
                [*names, "ll", "t", "letters"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return step(rows.mapInArrow(per_batch, f"{kept}, ll array<double>, t array<double>, letters boolean"))


def _base(kinds: int) -> np.ndarray:
    """The prior before anything is known; the last one is for other languages."""
    return np.array([(1 - OTHER_PRIOR) / (kinds - 1)] * (kinds - 1) + [OTHER_PRIOR])


def _softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1) * values.shape[1]
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values.ravel(), pa.float64()))


def suffix_of(host: str | Column) -> Column:
    """The last label of a host name; null without a dot."""
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def declared_of(value: str | Column) -> Column:
    """The primary tag of a language tag, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(value, r"^\s*([A-Za-z]{2,3})\b", 1)), F.lit(""))


def identify(
    docs: DataFrame,
    model: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    least: float = LEAST,
) -> DataFrame:
    """``(id, doc, declared, host, text_language, language, posterior, kept)``, a row per row of ``docs``.

    Null or blank evidence changes nothing. A text without a letter has the language ``und``.
    Rejected (``kept`` is false) are documents of other languages, and those whose best language has
    a posterior below ``least``. Equal posteriors go to the language listed first. Repeated rows
    count as often as they occur and get the same answer.
    """
    none = F.lit(None).cast("string")
    declared = none if declared is None else declared_of(declared)
    host = none if host is None else F.nullif(F.lower(F.trim(host)), F.lit(""))
    named = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), declared.alias("declared"),
        host.alias("host"),
    )
    keep = {
        "id": F.col("id"), "doc": doc_key(), "declared": F.coalesce("declared", F.lit("")),
        "host": F.coalesce("host", F.lit("")),
    }
    rows = text_likelihoods(named, model, "text", keep)
    every = (*languages, OTHER)
    places = range(len(every))
    said = rows.withColumn("suffix", F.coalesce(suffix_of("host"), F.lit("")))

    def sums(by: list[str], name: str) -> DataFrame:
        own = [F.sum(F.col("t")[i].cast("decimal(20,12)")).cast("double") for i in places]
        return said.filter("letters").groupBy(*by).agg(F.array(*own).alias(name))

    def added(frame: DataFrame, by: str, name: str) -> DataFrame:
        few = sums([by], name)
        # Keys whose rows all lack letters have no sums; they get zeros.
        zero = F.array_repeat(F.lit(0.0), len(every)).alias(name)
        missing = said.select(by).distinct().join(few.select(by), by, "left_anti").select(by, zero)
        return join_hot_keys(frame, step(few.unionByName(missing)), by)

    base = _base(len(every))
    total = np.array([x or 0.0 for x in sums([], "g").first().g])
    top = (total + SMOOTHING * base) / (total.sum() + SMOOTHING)
    kinds = said.agg(F.approx_count_distinct("declared")).first()[0]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def smoothed(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
            return (counts + SMOOTHING * parent) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)

        for batch in batches:
            letters = np.array(batch["letters"].to_pylist(), bool)
            ll, t, d, h, s = (
                batch[c].flatten().to_numpy().reshape(-1, len(every)) for c in ("ll", "t", "d", "h", "s")
            )
            # A row's own text is no evidence about its host.
            own = np.where(letters[:, None], t, 0.0)
            d, h, s = (np.maximum(x - own, 0) for x in (d, h, s))
            none = {c: np.array([not v for v in batch[c].to_pylist()], bool)[:, None] for c in ("declared", "host", "suffix")}
            of_suffix = np.where(none["suffix"], top, smoothed(s, top))
            of_host = np.where(none["host"], of_suffix, smoothed(h, of_suffix))
            said_so = np.log((d + ADDED) / (total + ADDED * kinds))
            found = _softmax(ll + np.log(of_host) + np.where(none["declared"], 0.0, said_so))
            best = found.max(axis=1)

            def named(posteriors: np.ndarray) -> list[str]:
                return [every[i] if some else OTHER for i, some in zip(posteriors.argmax(axis=1), letters)]

            language = named(found)
            kept = [name != OTHER and p >= least for name, p in zip(language, best)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in ("id", "doc", "declared", "host")), pa.array(named(t), pa.string()),
                    pa.array(language, pa.string()), pa.array(best.round(6)), pa.array(kept, pa.bool_()),
                ],
                ["id", "doc", "declared", "host", "text_language", "language", "posterior", "kept"],
            )

    frame = added(added(added(said, "declared", "d"), "host", "h"), "suffix", "s")
    id_type = rows.schema["id"].dataType.simpleString()
    found = frame.select("id", "doc", "declared", "host", "suffix", "letters", "ll", "t", "d", "h", "s").mapInArrow(
        fuse,
        f"id {id_type}, doc string, declared string, host string, text_language string, language string, "
        "posterior double, kept boolean",
    )
    blank = F.lit("")
    return found.withColumns({c: F.nullif(F.col(c), blank) for c in ("declared", "host")})


def keep_identified(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``identify`` keeps, with all their columns."""
    rejected = step(found.filter("NOT kept").select("doc").distinct())
    rows = packed(docs, id_col, text_col).select("row", doc_key().alias("doc"))
    return unpacked(only_with(rows, rejected, "doc", "left_anti"))
