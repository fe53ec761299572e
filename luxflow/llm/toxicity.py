"""Toxicity by non-negative positive-unlabelled learning on hashed words.

Confirmed toxic documents are the positive sample, any documents the unlabelled one.
The risk of the negative class is that of the unlabelled sample less the share of the
class prior in it, and is kept from falling below zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, texts_of, thrifty
from .folds import held_out, share
from .hashing import word_hashes


def word_features(text: str) -> np.ndarray:
    """Hashes of the words that occur in text, in order."""
    return np.unique(word_hashes(text))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _found(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in vocabulary of the words that it has, and which those are."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    hit = vocabulary[at] == words
    return at[hit], hit


class Rows:
    """Rows of words of a sorted vocabulary that are present or not."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray):
        self.n = len(rows)
        row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.at, hit = _found(np.concatenate([*rows, np.empty(0, np.uint64)]), vocabulary)
        self.row = row[hit]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def grad(self, pull: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, pull[self.row], size)


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted hashes of words
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: int = 4, rounds: int = 400, rate: float = 0.1, sparse: float = 4e-4) -> ToxicityModel:
        """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss, with a soft threshold on weights.

        Words of fewer than `least` rows are left out.
        """
        words, n = np.unique(np.concatenate(positive + unlabelled), return_counts=True)
        vocabulary = np.append(words[n >= least], np.uint64(0xFFFFFFFFFFFFFFFF))
        positive, unlabelled = Rows(positive, vocabulary), Rows(unlabelled, vocabulary)
        size = len(vocabulary)
        w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
        m, v = np.zeros(size), np.zeros(size)
        for t in range(1, rounds + 1):
            sp, su = _sigmoid(positive.dot(w) + b), _sigmoid(unlabelled.dot(w) + b)
            # of -log(1 - s): the loss of calling a row toxic that is not
            negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
            up = prior * (sp - 1) / positive.n
            down_u, down_p = su / unlabelled.n, -prior * sp / positive.n
            if negative >= 0:
                pull_p, pull_u = up + down_p, down_u
            else:  # below zero: only that part's step, and backwards
                pull_p, pull_u = -down_p, -down_u
            grad = positive.grad(pull_p, size) + unlabelled.grad(pull_u, size)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = rate / (1 + t / 200)
            size_of = np.sqrt(v / (1 - 0.99**t)) + 1e-5
            w -= step * (m / (1 - 0.9**t)) / size_of
            w = np.sign(w) * np.maximum(np.abs(w) - step * sparse / size_of, 0)
            b -= step * float(pull_p.sum() + pull_u.sum()) * 5
        kept = (w != 0) | (np.arange(size) == size - 1)
        return cls(vocabulary[kept], w[kept], b)

    def calibrate(self, rows: list[np.ndarray], toxic: np.ndarray, rounds: int = 100) -> None:
        """Platt scaling on labelled rows, by Newton steps."""
        z = Rows(rows, self.vocabulary).dot(self.weights) + self.bias
        n1 = toxic.sum()
        target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (len(toxic) - n1 + 2))
        a, c = 1.0, 0.0
        x = np.stack([z, np.ones_like(z)])
        for _ in range(rounds):
            p = _sigmoid(a * z + c)
            h = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, x @ (p - target) + 1e-3 * np.array([a - 1, 0]))
            a, c = a - step[0], c - step[1]
            if abs(step).max() < 1e-6:
                break
        if a > 0 and np.isfinite([a, c]).all():
            self.slope, self.shift = float(a), float(c)

    def score(self, text: str) -> float:
        z = self.weights[_found(word_features(text), self.vocabulary)[0]].sum() + self.bias
        return float(_sigmoid(np.float64(self.slope * z + self.shift)))


def _feature_rows(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in columns(batches, "toxic", "text"):
            for i in range(0, len(texts), 512):
                yield pa.RecordBatch.from_arrays([pa.array(toxic[i : i + 512], pa.int32()), pa.array([word_features(t)[:words].astype("<u8").tobytes() for t in texts[i : i + 512]])], ["toxic", "at"])

    return run


def train(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 6000, checked: int = 6000, words: int = 2048) -> ToxicityModel | None:
    """A model from about that many toxic, unlabelled and labelled rows outside the held-out fold; None without toxic ones.

    The class prior is the toxic share of all labelled rows of that part. Rows are
    taken by their id's hash, so which ones, and how many, don't hang on the input's size;
    of a labelled id that repeats, the text of least hash counts, and of its labels the
    largest: toxic once is toxic. At most `words` different words of a text are learnt
    from, those of least hash, so what reaches the driver is bounded.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n1 = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    learn = texts_of(docs).where(~held_out(F.col("doc_id")))
    total = learn.count()
    if not n1 or not total:
        return None
    draw = share(F.col("doc_id"))
    picked = known.where(((F.col("toxic") == 1) & (draw < positives / n1)) | (draw < checked / n)).orderBy(F.xxhash64("doc_id", F.lit(2))).limit(2 * (positives + checked))
    marked = learn.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")  # bounded by the limit above
    plain = learn.where(share(F.struct("doc_id", F.length("text")), 1) < unlabelled / total).orderBy(F.xxhash64("doc_id", "text")).limit(2 * unlabelled).select("text", F.lit(-1).alias("toxic"))
    rows = marked.unionAll(plain).select("toxic", "text").mapInArrow(thrifty(_feature_rows(words)), "toxic int, at binary").orderBy("toxic", F.xxhash64("at")).collect()
    found: dict[int, list[np.ndarray]] = {-1: [], 0: [], 1: []}
    for r in rows:
        found[r["toxic"] if r["toxic"] in found else 0].append(np.frombuffer(bytes(r["at"]), "<u8").astype(np.uint64))
    if not found[1] or not found[-1]:
        return None
    model = ToxicityModel.fit(found[1], found[-1], float(np.clip(n1 / n, 0.001, 0.9)))
    if found[0]:
        # positives may be drawn more often than others: the prior is put back by repeating the rest
        keep = found[1][: max(1, round(len(found[0]) * n1 / max(n - n1, 1)))]
        model.calibrate(found[0] + keep, np.array([0] * len(found[0]) + [1] * len(keep)))
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, from whole texts.

    Null texts are empty and score as a text without words. Without toxic labels to
    learn from, every score is 0. Rows with a null doc_id aren't held out. Labels that
    contradict each other, or repeat, count as train says; null ones don't.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for ids, out_fold, texts in columns(batches, "doc_id", "held_out", "text"):
            found = np.array([model.score(t) if model is not None else 0.0 for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out_fold), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts_of(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(thrifty(run), "doc_id long, held_out boolean, score double, predicted int")
