"""Toxicity by a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (N bytes of the lower-cased words,
with their borders) that it has at least once, twice or four times, in a hashed
space. A feature's value is its log-count ratio between the classes, and
logistic regression learns a weight for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices

#: Lengths of the n-grams in bytes, and the number of hashed n-grams.
N, SPACE = (4, 5, 6), 1 << 20
#: An n-gram is one feature for each of these counts that it reaches in a text.
LEVELS = (1, 2, 4)
#: In longer texts (words) counts are scaled down to this length, as chance finds grow with it.
WORDS = 1500
#: At most so many labelled rows of each class are learned from: those with the least hash of their doc_id.
MOST_ROWS = 1500
#: A feature must occur in so many training texts, and its log-count ratio must be at least so far from 0.
LEAST_TEXTS, LEAST_RATIO = 5, 1.0
#: A score from here on is toxic.
CUT = 0.7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def ngrams(text: str) -> tuple[np.ndarray, int]:
    """Hashed numbers of all n-grams of a whole text, and its count of words. An n-gram has a blank at its ends alone."""
    a = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    blank = a == 32
    words = int(np.count_nonzero(blank[:-1] & ~blank[1:]))
    n, found = len(a), []
    a = a.astype(np.uint32)
    h, inside = a + np.uint32(1), None
    for size in range(2, N[-1] + 1):
        m = n - size + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x9E3779B1)) ^ a[size - 1 :]
        h ^= h >> np.uint32(13)
        if size > 2:
            middle = blank[size - 2 : size - 2 + m]
            inside = middle if inside is None else inside[:m] | middle
        if size in N:
            mixed = h[~inside] * np.uint32(0x85EBCA6B)
            found.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(SPACE - 1))
    return (np.concatenate(found) if found else np.zeros(0, np.uint32)), words


def features(grams: np.ndarray, words: int) -> np.ndarray:
    """Distinct feature numbers: n-gram + SPACE * level for each level whose count the n-gram reaches."""
    found, counts = np.unique(grams, return_counts=True)
    counts = counts * min(1.0, WORDS / max(words, 1))
    return np.concatenate([found, *(found[counts >= c].astype(np.int64) + SPACE * k for k, c in enumerate(LEVELS) if k)]).astype(np.int64)


class Model:
    """Weights of the features (of fixed size), and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.used = (weights.reshape(len(LEVELS), SPACE) != 0).any(axis=0)

    def score(self, text: str) -> float:
        grams, words = ngrams(text)
        got = features(grams[self.used[grams]], words)
        z = self.intercept + float(self.weights[got].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-z)) if z >= 0 else np.exp(z) / (1 + np.exp(z)))


def learn(texts: list[str], toxic: list[int], rounds: int = 300, ridge: float = 1e-3) -> Model:
    """Log-count ratios, then logistic regression by gradient steps with momentum. Without both classes every score is the toxic share."""
    y, size = np.array(toxic, np.float64), len(LEVELS) * SPACE
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(size, np.float32), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    n1, n0 = y.sum(), len(y) - y.sum()
    # Two passes over the texts, so that only chosen features are held.
    in_toxic, in_all = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for t, toxic_one in zip(texts, y > 0, strict=True):
        got = features(*ngrams(t))
        in_all[got] += 1
        if toxic_one:
            in_toxic[got] += 1
    # Shares of a class's texts that have the feature, each count one up.
    ratio = np.log((in_toxic + 1) / np.float32(n1 + 2)) - np.log((in_all - in_toxic + 1) / np.float32(n0 + 2))
    use = np.nonzero((in_all >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO))[0]
    place = np.full(size, -1, np.int32)
    place[use] = np.arange(len(use))
    ratio = ratio[use].astype(np.float64)
    del in_toxic, in_all
    rows = []
    for t in texts:
        got = place[features(*ngrams(t))]
        rows.append(got[got >= 0])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    del place
    value = ratio[flat]
    w, b, vw, vb = np.zeros(len(use)), float(np.log(n1 / n0)), np.zeros(len(use)), 0.0
    step = 4.0 / (np.bincount(owner, weights=value**2, minlength=len(rows)).mean() + 1)
    for _ in range(rounds):
        z = np.bincount(owner, weights=value * w[flat], minlength=len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        vw = 0.9 * vw - step * (np.bincount(flat, weights=value * g[owner], minlength=len(use)) + ridge * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    out = np.zeros(size, np.float32)
    out[use] = ratio * w
    return Model(out, float(b))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from rows of docs that labels (doc_id, toxic) marks and that aren't held out, MOST_ROWS of each class at most.

    Contradictory labels of one id count as toxic; null labels, ids or texts are
    left out, and of rows that repeat an id the text that sorts first is taken.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("turn", "doc_id").limit(MOST_ROWS).unionByName(known.where("toxic = 0").orderBy("turn", "doc_id").limit(MOST_ROWS))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most 2 * MOST_ROWS ids, a proven bound.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "turn").agg(F.min("text").alias("text")).orderBy("turn", "doc_id").collect()
    return learn([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text; a null text scores as an empty one. Repeated rows score alike; other columns are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text scores under CUT, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([shared.value.score(t or "") < CUT for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
