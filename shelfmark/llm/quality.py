"""Text quality without hand-made labels: heuristic votes, their accuracies by EM, a linear scorer.

Labellers look at one property each and vote good, bad or not at all. Documents with the same votes are
counted together; expectation-maximisation over these counts (at most 3 ** labellers rows, whatever
the corpus) estimates how often each labeller is right, and with that how likely a document is good
given its votes. These posteriors, as soft labels of a bounded sample of documents, train a logistic
regression over hashed words, word shapes and votes, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.common import doc_key, step

#: Documents in the training sample, on average: the bound of what the regression is fitted on.
SAMPLE = 10_000
#: Buckets of the hashed features.
FEATURES = 1 << 16
#: Rounds of the label model and of the regression, and the weight of its penalty.
ROUNDS, STEPS, PENALTY = 100, 200, 1e-5
#: Score from which a document is kept.
LEAST = 0.5

LABELLERS = (
    "symbols", "odd_ends", "no_words", "marks", "capitals", "digits", "word_length", "vocabulary",
    "stutter", "repeated_lines", "sentences", "length",
)

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SYMBOLS = b"*&%$#|~^<>{}[]\\_=+@"
_STOPS = b".,;:)\"'"


def _shape_table() -> bytes:
    """Small letters and all beyond ASCII as a, capitals as A, digits as 9, ! and ? as !, stops as a dot,
    blanks as they are, other signs as a dash."""
    table = bytearray(b"-" * 128 + b"a" * 128)
    for signs, sign in (
        (b"abcdefghijklmnopqrstuvwxyz", b"a"), (_UPPER, b"A"), (_DIGITS, b"9"), (b"!?", b"!"),
        (_STOPS, b"."), (b" \t\n\r\x0b\x0c", b" "),
    ):
        for c in signs:
            table[c] = sign[0]
    return bytes(table)


_SHAPES = _shape_table()


def _share_vote(share: float, good_up_to: float, bad_above: float) -> str:
    return "-" if share > bad_above else "+" if share <= good_up_to else "0"


def votes_and_tokens(text: str | None) -> tuple[str, set[bytes]]:
    """One of ``+``, ``-``, ``0`` per labeller; the different words, word shapes and votes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, shapes = data.split(), data.translate(_SHAPES).split()
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    n, size = len(words), max(1, len(data))

    def counted(signs: bytes) -> int:
        return len(data) - len(data.translate(None, signs))

    votes = dict.fromkeys(LABELLERS, "0")
    if n >= 3:
        odd = sum(s.endswith((b"-", b"!!")) for s in shapes)
        empty = sum(not s.strip(b"-.!") for s in shapes)
        votes["symbols"] = _share_vote(counted(_SYMBOLS) / size, 0.01, 0.03)
        votes["odd_ends"] = _share_vote(odd / n, 0.05, 0.2)
        votes["no_words"] = _share_vote(empty / n, 0.03, 0.15)
        votes["marks"] = _share_vote(counted(b"!?") / n, 0.15, 0.5)
        votes["capitals"] = _share_vote(counted(_UPPER) / size, 0.12, 0.3)
        votes["digits"] = _share_vote(counted(_DIGITS) / size, 0.08, 0.25)
        votes["word_length"] = "+" if 3 <= size / n <= 13 else "-"
    if n >= 50:
        votes["vocabulary"] = _share_vote(1 - len(set(words)) / n, 0.6, 0.8)
    if n >= 10:
        votes["stutter"] = _share_vote(sum(map(eq, words, words[1:])) / n, 0.05, 0.2)
    if len(lines) >= 4:
        ended = sum(x.rstrip(b"\"')]").endswith((b".", b"!", b"?")) for x in lines)
        votes["repeated_lines"] = _share_vote(1 - len(set(lines)) / len(lines), 0.1, 0.3)
        votes["sentences"] = _share_vote(1 - ended / len(lines), 0.3, 0.7)
    votes["length"] = "-" if n == 0 else "+" if n >= 8 else "0"
    shown = "".join(votes[name] for name in LABELLERS)
    tokens = set(data.lower().split())
    # A shape is how a word begins and ends.
    tokens |= {b"\x00" + s[:1] + s[-2:] for s in set(shapes)}
    tokens |= {b"\x01%d%b" % (i, v.encode()) for i, v in enumerate(shown)}
    return shown, tokens


def _buckets(tokens: set[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    hashes = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    return np.unique((hashes % np.uint64(FEATURES)).astype(np.int32))


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of a good document; per labeller, where it votes, P(bad, good | bad, good document)."""

    prior: float
    emissions: np.ndarray  # labellers x document x vote

    def posterior(self, votes: str) -> float:
        """P(good | votes); a labeller that does not vote says nothing."""
        odds = np.log(self.prior) - np.log(1 - self.prior)
        for vote, e in zip(votes, self.emissions):
            if vote != "0":
                odds += np.log(e[1, "-+".index(vote)]) - np.log(e[0, "-+".index(vote)])
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    def accuracies(self) -> list[float]:
        """Per labeller: how often a vote of it is right."""
        return [float((1 - self.prior) * e[0, 0] + self.prior * e[1, 1]) for e in self.emissions]


def fit_label_model(patterns: list[tuple[str, int]], rounds: int = ROUNDS) -> LabelModel:
    """EM over ``(votes, count)``.

    It starts from the votes against a document alone, since most labellers look for one kind of fault
    only: two of them make it bad at first, a single one leaves a doubt.
    """
    if not patterns:
        return LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 0.5))
    counts = np.array([c for _, c in patterns], float)
    shown = np.array([[[v == "-", v == "+"] for v in p] for p, _ in patterns], float)
    good = 1 / (1 + np.exp(4 * shown[:, :, 0].sum(axis=1) - 3))
    prior, emissions = 0.5, np.full((shown.shape[1], 2, 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        # One vote is added everywhere, so nothing is impossible.
        seen = np.einsum("cp,pjv->jcv", weight, shown) + 1
        emissions = seen / seen.sum(axis=2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        odds = np.einsum("jv,pjv->p", np.log(emissions[:, 1] / emissions[:, 0]), shown)
        odds = np.clip(odds + np.log(prior / (1 - prior)), -500, 500)
        before, good = good, 1 / (1 + np.exp(-odds))
        if np.abs(before - good).max() < 1e-9:
            break
    return LabelModel(prior, emissions)


def fit_scorer(buckets: list[np.ndarray], good: np.ndarray) -> np.ndarray | None:
    """Weights of a logistic regression on soft labels, the last one its constant; ``None`` without
    documents. Every document is a vector of length one, so long texts weigh no more than short ones."""
    sizes = np.array([len(b) for b in buckets])
    if not sizes.sum():
        return None
    columns = np.concatenate(buckets)
    rows = np.repeat(np.arange(len(buckets)), sizes)
    values = 1 / np.sqrt(sizes[rows])
    weights, mean, spread = np.zeros((3, FEATURES + 1))
    for i in range(1, STEPS + 1):
        scores = np.bincount(rows, values * weights[columns], len(buckets)) + weights[-1]
        error = 1 / (1 + np.exp(-scores)) - good
        slope = np.append(np.bincount(columns, values * error[rows], FEATURES), error.sum()) / len(good)
        slope[:-1] += PENALTY * weights[:-1]
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        weights = weights - 0.1 * (mean / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8)
    return weights


def score_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    least: float = LEAST,
) -> DataFrame:
    """``(id, votes, label, score, kept)``, one row per row of ``docs``.

    ``label`` is P(good) given the votes, ``score`` the regression's P(good), ``kept`` says that it is
    at least ``least``. Texts without words, null ones too, have the score 0. Repeated rows count as
    often as they occur. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # A share of the rows by their hash: the same rows in every run.
    share = int(min(1.0, sample / max(1, rows.count())) * (1 << 30))
    chosen = F.pmod(F.xxhash64(doc_key()), F.lit(1 << 30)) < share

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, buckets = [], []
            for text, taken in zip(batch["text"], batch["chosen"]):
                votes, tokens = votes_and_tokens(text.as_py())
                shown.append(votes)
                buckets.append(_buckets(tokens) if taken.as_py() else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shown, pa.string()), pa.array(buckets, pa.list_(pa.int32()))], ["votes", "buckets"]
            )

    voted = step(rows.select("text", chosen.alias("chosen")).mapInArrow(vote, "votes string, buckets array<int>"))
    patterns = sorted(tuple(r) for r in voted.groupBy("votes").agg(F.count(F.lit(1))).collect())
    model = fit_label_model(patterns)
    labels = {votes: model.posterior(votes) for votes, _ in patterns}
    taken = voted.filter(F.col("buckets").isNotNull()).toArrow()
    weights = fit_scorer(
        [b.values.to_numpy() for b in taken["buckets"]], np.array([labels[v] for v in taken["votes"].to_pylist()])
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, scores = [], []
            for text in batch["text"]:
                votes, tokens = votes_and_tokens(text.as_py())
                buckets = _buckets(tokens)
                total = weights[buckets].sum() / np.sqrt(len(buckets)) + weights[-1]
                shown.append(votes)
                # Votes and their shapes are all that a text without words has.
                some = any(not t.startswith((b"\x00", b"\x01")) for t in tokens)
                scores.append(round(float(1 / (1 + np.exp(-total))), 6) if some else 0.0)
            label = [round(labels[v], 6) for v in shown]
            kept = [s >= least for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(shown, pa.string()), pa.array(label, pa.float64()),
                 pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())],
                ["id", "votes", "label", "score", "kept"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {id_type}, votes string, label double, score double, kept boolean")
