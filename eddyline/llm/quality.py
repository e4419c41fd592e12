"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Their
accuracies are estimated by expectation maximisation over the counts of vote
patterns - all documents, and no more rows on the driver than there are patterns (3 to the
number of labellers). The posteriors then train a linear scorer on hashed word shapes: logistic
regression on a sample of at most TRAIN_ROWS different documents, chosen by hash, each as often as it
occurs. Every document is scored, whole.

Texts are read by Python once: votes and counted shapes are written, and training and scoring
read those. What is rejected is then told by document, so only texts that go, and a few others, are shuffled.

Defined cases: a document without words (or with null text) gets score 0 and is rejected; repeated
rows get equal results; with no documents, or votes of one class only, the prior
decides; a score equal to ``keep`` is kept; texts of any length are whole; columns other than doc_id and text don't matter,
whatever they are called.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, KeyFilter, Words, cut, tidy, whole_row, written

#: Documents that train the scorer at most, hashed features, and the score from which a document is kept.
TRAIN_ROWS, DIMENSION, KEEP = 8_000, 1 << 12, 0.5
ROUNDS, STEPS = 100, 400
#: Labellers: the share that is measured, where it votes good and where bad: (up to, from); those with -1 speak up on faults only. With few words all abstain but the first.
LABELLERS = (
    ("odd", 0.12, 0.40),  # words that are not plain: letters of one case but for the first, one mark at most at the end, not the word before again
    ("symbols", -1.0, 0.20),  # characters that are neither letters, digits, white space nor common punctuation
    ("repeats", -1.0, 0.30),  # words equal to the one before
    ("same", -1.0, 0.93),  # words that occur before in their stretch of BLOCK words, over all stretches
    ("capitals", -1.0, 0.60),  # words in capitals only, of three letters or more
    ("shouts", -1.0, 0.30),  # words that end in two marks or more
    ("bars", -1.0, 0.20),  # words without a letter or digit
    ("long", -1.0, 0.20),  # words of over 30 characters
)
FEW = 12
BLOCK = 200
#: Words whose shapes are taken in one step.
SHAPES = 8_192
_COMMON = re.compile(r"[^\w\s.,;:!?'\"()\-]|_")
_PLAIN = re.compile(r"[(\"']?[^\W\d_](?:[^\W\d_]|['’-])*[)\"']?[.,;:!?]?|[0-9]+[.,;:!?]?")
_MARKS = re.compile(r"[^\w\s]{2,}$")


def _shape_of(word: str) -> tuple:
    """Odd characters, characters, capitals only, ends in marks, has no letter or digit, hashed shape, over-long, not plain."""
    odd, n = len(_COMMON.findall(word)), len(word)
    bare = not any(c.isalnum() for c in word)
    caps = word.isupper() and sum(c.isalpha() for c in word) >= 3
    marks = bool(_MARKS.search(word))
    classes = re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))
    text = f"{classes}|{min(n, 16).bit_length()}"
    return odd, n, caps, marks, bare, xxhash.xxh32_intdigest(text) % (DIMENSION - 1), n > 30, caps or not _PLAIN.fullmatch(word)


@functools.cache
def _like(word: str) -> tuple:
    return _shape_of(word)


def _shape(word: str) -> tuple:
    """As _shape_of; words of letters, small but for the first, with one mark at most, look like others of their length."""
    n = len(word)
    tail = word[-1:] if word[-1:] in ".,;:!?" else ""
    body = word[: n - len(tail)]
    if 1 < len(body) <= 30 - len(tail) and body.isalpha() and body[1:].islower():
        first = "A" if body[0].isupper() else "a" if body[0].islower() else ""
        if first:
            return _like(first + "a" * (len(body) - 1) + tail)
    return _shape_of(word)


def _shapes(words: pa.Array) -> np.ndarray:
    """The shapes of some words, a row for each measure; few of the words are Python's at a time."""
    out = np.zeros((8, len(words)), np.int32)
    for k in range(0, len(words), SHAPES):
        out[:, k : k + SHAPES] = np.array([_shape(w) for w in words.slice(k, SHAPES).to_pylist()], np.int32).T
    return out


class Measures:
    """Shares for the labellers, and hashed shapes, of some texts. The last feature is a word that repeats the one before."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        table = _shapes(words.uniques)
        codes, starts = words.codes, words.offsets
        self.n = np.diff(starts)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        # Stretches of each text, numbered through; the last one may be shorter.
        stretch = np.r_[0, np.cumsum(-(-self.n // BLOCK))]
        place = stretch[owner] + (np.arange(len(codes)) - np.repeat(starts[:-1], self.n)) // BLOCK
        pairs = place * np.int64(table.shape[1] + 1) + codes
        pairs.sort()
        first = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]] // (table.shape[1] + 1)
        distinct = np.bincount(np.repeat(np.arange(len(self.n)), np.diff(stretch))[first], minlength=len(self.n))
        del pairs, place, first
        total = lambda v: np.bincount(owner, v, len(self.n))
        n = np.maximum(1, self.n)
        own = lambda k: table[k][codes]  # noqa: E731  a column at a time
        self.shares = np.stack(
            [
                total(own(7).astype(bool) | again) / n,
                total(own(0)) / np.maximum(1, total(own(1))),
                total(again) / n,
                1 - distinct / n,
                *(total(own(k)) / n for k in (2, 3, 4, 6)),
            ],
            1,
        )
        self.owner, self.shapes, self.again = owner, own(5), again

    def votes(self) -> list[str]:
        good = np.array([x[1] for x in LABELLERS])
        bad = np.array([x[2] for x in LABELLERS])
        letters = np.where(self.shares <= good, 2, np.where(self.shares >= bad, 0, 1))
        letters[:, 1:][self.n < FEW] = 1
        return ["".join("bag"[v] for v in row) for row in letters]

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, share of its words)."""
        repeated = np.flatnonzero(self.again)
        key = np.r_[self.owner, self.owner[repeated]] * DIMENSION + np.r_[self.shapes, np.full(len(repeated), DIMENSION - 1)]
        key, counts = np.unique(key, return_counts=True)
        return key // DIMENSION, key % DIMENSION, counts / self.n[key // DIMENSION]

    def packed(self) -> list[bytes]:
        """Each document's features and their shares: whole numbers of 16 bits, then floats of 32."""
        doc, feature, share = self.sparse()
        cuts = np.searchsorted(doc, np.arange(len(self.n) + 1))
        feature, share = feature.astype("<u2"), share.astype("<f4")
        return [feature[a:b].tobytes() + share[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def unpacked(stored: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, share) of some documents' ``packed`` features."""
    sizes = np.array([len(x) // 6 for x in stored], np.int64)
    feature = np.concatenate([np.frombuffer(x, "<u2", n) for x, n in zip(stored, sizes, strict=True)]) if len(stored) else np.zeros(0, "<u2")
    share = np.concatenate([np.frombuffer(x, "<f4", n, 2 * n) for x, n in zip(stored, sizes, strict=True)]) if len(stored) else np.zeros(0, "<f4")
    return np.repeat(np.arange(len(stored)), sizes), feature.astype(np.int64), share.astype(float)


def scores(stored: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    doc, feature, share = unpacked(stored)
    logit = bias + np.bincount(doc, weights[feature] * share, len(stored))
    return np.where(np.array([len(x) > 0 for x in stored], bool), 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 0.0)


def accuracies(counts: dict[str, int]) -> tuple[float, np.ndarray]:
    """By expectation maximisation: the share of good documents, and P(vote | class) by labeller, class (bad, good) and vote (b, a, g)."""
    votes = np.array([["bag".index(v) for v in p] for p in counts]).reshape(-1, len(LABELLERS))
    weight = np.array(list(counts.values()), float)
    # One bad vote is a first guess; the estimates then decide how much each says.
    post = np.where((votes == 0).any(1), 0.1, np.where((votes == 2).any(1), 0.9, 0.5))
    table = np.full((len(LABELLERS), 2, 3), 1 / 3)
    prior = 0.5
    for _ in range(ROUNDS):
        prior = float(np.clip((post @ weight + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6))
        for k in range(len(LABELLERS)):
            for c, p in enumerate((1 - post, post)):
                seen = np.bincount(votes[:, k], p * weight, 3) + 0.5
                table[k, c] = seen / seen.sum()
        logit = np.log(prior / (1 - prior)) + sum((np.log(table[k, 1, votes[:, k]]) - np.log(table[k, 0, votes[:, k]]) for k in range(len(LABELLERS))), np.zeros(len(votes)))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return prior, table


def posterior(prior: float, table: np.ndarray, pattern: str) -> float:
    logit = np.log(prior / (1 - prior)) + sum(np.log(table[k, 1, "bag".index(v)] / table[k, 0, "bag".index(v)]) for k, v in enumerate(pattern))
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(stored: list[bytes], y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels y of documents that occur so many times, by accelerated gradient steps with a small penalty."""
    if not len(stored):
        return np.zeros(DIMENSION), 0.0
    owner, at, value = unpacked(stored)
    # Both classes weigh the same.
    good = times[y >= 0.5].sum() / times.sum()
    mass = times * np.where(y >= 0.5, 0.5 / max(1e-9, good), 0.5 / max(1e-9, 1 - good))
    mass = mass / mass.sum()
    w, b, vw, vb = np.zeros(DIMENSION), 0.0, np.zeros(DIMENSION), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(owner, w[at] * value, len(stored)), -30, 30)))
        g = (p - y) * mass
        vw = 0.9 * vw - 2.0 * (np.bincount(at, g[owner] * value, DIMENSION) + 1e-5 * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def _keyed(docs: DataFrame, *more: F.Column) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(*more, docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, votes and packed features of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", 2 * STEP_BYTES):
                m = Measures(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(m.votes()), pa.array(m.packed(), pa.binary())], ["doc_id", "text_key", "votes", "features"])
        tidy()

    return written(_keyed(docs).mapInArrow(run, "doc_id long, text_key long, votes string, features binary"), "measures")


def fit(rows: DataFrame) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(weights, bias, prior, accuracies) from ``measured`` rows."""
    # At most 3 to the number of labellers rows.
    counts = {r[0]: r[1] for r in rows.groupBy("votes").count().collect()}
    prior, table = accuracies(counts) if counts else (0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    # The sample: documents with the least hashes. Repeated rows are one, with their number; TRAIN_ROWS rows of a few hundred bytes reach the driver.
    key = F.xxhash64("doc_id", "text_key").alias("key")
    keys = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).orderBy("key").limit(TRAIN_ROWS)
    sample = rows.select("*", key).join(F.broadcast(keys), "key").groupBy("key").agg(F.first("features").alias("features"), F.first("votes").alias("votes"), F.first("times").alias("times"))
    found = sample.orderBy("key").toArrow()
    stored = found.column("features").to_pylist()
    y = np.array([posterior(prior, table, p) for p in found.column("votes").to_pylist()])
    full = np.array([len(x) > 0 for x in stored], bool)
    weights, bias = train([x for x in stored if x], y[full] if len(y) else y, np.asarray(found.column("times")).astype(float)[full] if len(y) else y)
    # Training gave both classes one weight; a score is a probability at their true shares.
    return weights, bias + float(np.log(prior / (1 - prior))), prior, table


def _scored(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, score and votes of every document."""
    rows = measured(docs)
    weights, bias, _, _ = fit(rows)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 32 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores(batch.column("features").to_pylist(), held.value, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(score), batch.column("votes")], ["doc_id", "text_key", "score", "votes"])
        tidy()

    return rows.mapInArrow(run, "doc_id long, text_key long, score double, votes string")


def classify(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, score, keep, votes."""
    return _scored(docs).select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= keep).alias("keep"), "votes")


def good_documents(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with all their columns."""
    bad = _scored(docs).where(F.col("score") < keep).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text")).distinct()
    bad = written(bad, "rejected")
    known, packed = KeyFilter(bad.select(F.col("__text").alias("text_key")), "text_key"), _keyed(docs, whole_row()).drop("text")
    met = known.inside(packed).join(bad, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__text")), "left_anti")
    return known.outside(packed).select("row").unionAll(met.select("row")).select("row.*")
