"""Quality scores from a logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.labelled import Features, fold, logistic, score_documents, train

BITS = 18
_LOWER, _UPPER, _DIGIT = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    """64-bit hashes of each word (bytes) and of its shape: runs of letters and digits become one sign each."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 300_000:
            self.clear()
        shape = _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))
        value = self[word] = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(shape, seed=1))
        return value


_WORDS = _Words()


def ngrams(text: bytes | None) -> Features:
    """Buckets of the 1- and 2-grams of words and 1- to 3-grams of word shapes, and whether a word follows itself.

    Values are 1 + ln(count), scaled so that the vector has length 1.
    """
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    w, s = both[:, 0], both[:, 1]
    same = np.where(w[1:] == w[:-1], np.uint64(11), np.uint64(13)) * _C
    grams = np.concatenate([w * _A, w[:-1] * _B + w[1:] * _C, s * _A, s[:-1] * _A + s[1:] * _B, s[:-2] * _B + s[1:-1] * _C + s[2:] * _A, same])
    grams ^= grams >> np.uint64(31)
    grams *= _B
    buckets, counts = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    values = 1 + np.log(counts)
    return buckets, (values / np.sqrt((values * values).sum())).astype(np.float32)


@dataclass
class LinearModel:
    bias: float
    weight: np.ndarray

    def margin(self, x: Features) -> float:
        return self.bias + float(self.weight[x[0]] @ x[1])


def fit(rows: list[Features], y: np.ndarray, *, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, seed: int = 9) -> LinearModel:
    """Follow the regularised leader with a step size for each coordinate; classes weigh alike.

    ``z`` holds each coordinate's adjusted sum of gradients and ``n`` that of their squares; its weight is zero while
    ``|z| <= l1``. The last coordinate is the bias, which isn't regularised by ``l1``.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    penalty = np.full(size, l1)
    penalty[-1] = 0
    positive = max(1.0, float(y.sum()))
    weights = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * max(1.0, len(y) - positive)))
    rng = np.random.default_rng(seed)
    inputs = [(np.append(i, size - 1), np.append(x, 1.0)) for i, x in rows]

    def leader(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= penalty[at], 0.0, -(zz - np.sign(zz) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = inputs[k]
            w = leader(at)
            g = (logistic(float(w @ x)) - y[k]) * weights[k] * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(slice(None))
    return LinearModel(float(w[-1]), w[:-1].astype(np.float32))


def _score(model: LinearModel, text: bytes | None) -> float:
    return logistic(model.margin(ngrams(text)))


def quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", folds: int = 3, held_out: int = 1, per_class: int = 5000, most_terms: int = 4_000_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Learns from at most ``per_class`` labelled rows of either class, with about ``most_terms`` features together, outside the
    held-out fold (crc32 of doc_id as text modulo ``folds``); a document's score depends on its text alone, all of it. Null and empty texts get the
    score of no n-grams. Without labels every score is 0.5. Null ids aren't held out. Repeated rows get equal scores.
    """
    model = train(docs, labels, "quality", fold(F.col("doc_id"), folds) != held_out, per_class, most_terms, ngrams, fit, text)
    out = score_documents(docs, model, _score, keep=["doc_id"], text=text)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
