"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; for each bit a binary classifier on hashed n-grams
predicts it, and the language whose codeword has the least weighted loss wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, lean, texts_of, thrifty, written
from .folds import held_out, share

UNKNOWN = "und"
FEATURES = 8192
_BYTE = np.array([(b | 32 if chr(b).isalpha() else 32) if b < 128 else b for b in range(256)], np.uint32)


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed 2-, 3- and 4-gram of bytes occurs; all but letters count as one space."""
    raw = _BYTE[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])] if len(raw) else raw
    b = np.concatenate([[32], raw, [32, 32]]).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    four = three[:-1] << 8 | b[3:]
    grams = np.concatenate([two * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995), three * np.uint32(0x85EBCA6B), four * np.uint32(0xC2B2AE35)])
    return np.bincount(grams >> np.uint32(32 - 13), minlength=FEATURES).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """classes x bits of -1 and 1: all splits of up to 7 classes, else random words, the farthest apart of 50 draws."""
    if classes <= 7:
        bits = max(1, 2 ** (classes - 1) - 1)
        return np.array([[1] * bits] + [[1 if (b >> (k - 1)) & 1 else -1 for b in range(bits)] for k in range(1, classes)])[:classes]
    rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(classes)))
    drawn = (rng.choice([-1, 1], (classes, bits)) for _ in range(50))
    usable = [c for c in drawn if (np.abs(c.sum(axis=0)) < classes).all()]
    return max(usable, key=lambda c: -(c @ c.T - 2 * bits * np.eye(classes)).max())


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss: its classifier's accuracy beyond chance

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], rounds: int = 200, decay: float = 1e-4) -> LanguageModel:
        languages = sorted(set(y))
        codes = codewords(len(languages))
        number = {c: i for i, c in enumerate(languages)}
        row = np.array([number[c] for c in y])
        target = codes[row].astype(np.float32)
        weight = (len(row) / len(languages) / np.bincount(row))[row, None].astype(np.float32) / len(row)
        w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
        scale, (m, v) = np.float32(8.0), (np.zeros_like(w), np.zeros_like(w))
        for t in range(1, rounds + 1):  # Adam on the logistic loss of every bit at once
            pull = -target * weight / (1 + np.exp(np.clip(target * (x @ w * scale + b), -30, 30)))
            grad = x.T @ pull * scale + decay * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            b -= 0.5 * pull.sum(axis=0)
        hit = ((x @ w * scale + b) * target > 0) * weight
        trust = np.maximum(2 * hit.sum(axis=0) - 1, 0.01)
        return cls(languages, codes, w * scale, b, trust)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and margin to the next language, of each row of features."""
        bits = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -bits * code) * self.trust).sum(axis=1) for code in self.codes], axis=1)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        order = np.sort(chance, axis=1)
        margin = order[:, -1] - (order[:, -2] if chance.shape[1] > 1 else 0)
        return chance.argmax(axis=1), order[:, -1], margin


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, texts in columns(batches, "lang", "text"):
        for i in range(0, len(texts), 512):
            counts = [ngram_counts(t) for t in texts[i : i + 512]]
            used = [np.nonzero(c)[0] for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array(langs[i : i + 512]), pa.array([u.astype("<u2").tobytes() for u in used]), pa.array([c[u].astype("<u2" if c.max() < 65536 else "<f4").tobytes() for c, u in zip(counts, used, strict=True)])], ["lang", "at", "n"])


def train(docs: DataFrame, sample: int = 4000) -> LanguageModel | None:
    """A model from about `sample` labelled rows outside the held-out fold, as many of each language; None without any.

    The rows of a language are those whose hash is below that language's share, so the
    sample needs no sort of the table and is the same in every run; rows that repeat in
    id and text count once. Where there are more languages than `sample`, those of which
    a row is drawn are learnt.
    """
    h = F.xxhash64("text")
    learn = texts_of(docs, "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = written(learn.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sizes.count()
    if not languages:
        return None
    chosen = learn.join(sizes, "lang").withColumn("h", h).where(share(F.struct("doc_id", "h")) < sample / languages / F.col("n"))
    once = chosen.groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text")).withColumn("draw", F.xxhash64("doc_id", "h", F.lit(3)))
    # one short text's copies under many ids may be drawn more often than asked for
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "h"))).where(F.col("place") <= 2 * sample // languages + 1)
    rows = ranked.orderBy("draw", "doc_id", "h").limit(2 * sample).select("lang", "text").mapInArrow(thrifty(_train_rows), "lang string, at binary, n binary").orderBy("lang", F.xxhash64("at", "n")).collect()
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        at = np.frombuffer(bytes(r["at"]), "<u2")
        x[i, at] = np.frombuffer(bytes(r["n"]), "<u2" if len(r["n"]) == 2 * len(at) else "<f4")
    if not rows:
        return None
    langs = [r["lang"] for r in rows]
    del rows, r
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)  # as features, in place
    return LanguageModel.fit(np.sqrt(x, out=x), langs)


def identify(docs: DataFrame, sample: int = 4000, margin: float = 0.2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per input row, from whole texts.

    Null texts and those without letters are `und` with score 0, as is all where no
    row may be learnt from. ambiguous: the next language is within margin. Null
    languages are never learnt; rows with a null doc_id aren't held out.
    """
    model = train(docs, sample)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for ids, out_fold, texts in columns(batches, "doc_id", "held_out", "text"):
            lang, score, unsure = [UNKNOWN] * len(ids), np.zeros(len(ids)), np.zeros(len(ids), bool)
            known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for k in range(0, len(known), 256):
                at = known[k : k + 256]
                best, chance, lead = m.predict(features(np.stack([ngram_counts(texts[i]) for i in at])))
                for i, b in zip(at, best.tolist(), strict=True):
                    lang[i] = m.languages[b]
                score[at], unsure[at] = chance, lead < margin
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out_fold), pa.array(lang), pa.array(np.clip(score, 0, 1)), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return texts_of(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(thrifty(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, sample: int = 4000, least: float = 0.5) -> DataFrame:
    """docs without the rows that have no letters (null texts too) or whose best language scores below least; all stay where nothing can be learnt."""
    model = train(docs, sample)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            kept = []
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            for k in range(0, len(known), 256):
                at = known[k : k + 256]
                chance = m.predict(features(np.stack([ngram_counts(texts[i]) for i in at])))[1]
                kept += [i for i, c in zip(at, chance.tolist(), strict=True) if c >= least]
            yield batch.take(pa.array(kept, pa.int64()))

    lean(docs.sparkSession)
    return docs.mapInArrow(thrifty(run), docs.schema)
