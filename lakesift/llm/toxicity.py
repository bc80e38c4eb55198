"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.labelled import Features, fold, logistic, score_documents, train

BITS = 18
_TRIM = b".,;:!?\"'()[]{}<>|#*$%&-_~`/\\=+^@"


class _Terms(dict):
    """Buckets of each word (bytes): of its lower-cased form without marks at either end, and of the first five characters."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 300_000:
            self.clear()
        bare = word.strip(_TRIM).decode().lower()
        value = self[word] = (xxhash.xxh3_64_intdigest(bare) >> (64 - BITS), xxhash.xxh3_64_intdigest(bare[:5], seed=5) >> (64 - BITS))
        return value


_TERMS = _Terms()


def terms(text: bytes | None) -> Features:
    """Buckets of the distinct terms of a whole text, words and their beginnings, each with value 1."""
    words = set(text.split()) if text else ()
    found = np.unique(np.array(list(map(_TERMS.__getitem__, words)), dtype=np.int32))
    return found, np.ones(len(found), dtype=np.float32)


@dataclass
class FactorizationMachine:
    """score = bias + sum of weights + sum over pairs of terms of the product of their factors.

    Terms are taken from buckets with a place in ``place`` (-1: none), those of enough training texts; texts are sets
    of terms, and the pairs' sum is divided by the number of terms, so that it doesn't grow with the length of the text.
    """

    bias: float
    place: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray) -> float:
        at = self.place[at]
        at = at[at >= 0]
        if not len(at):
            return self.bias
        v = self.factors[at]
        total = v.sum(axis=0)
        return float(self.bias + self.weight[at].sum() + 0.5 * (total @ total - (v * v).sum()) / len(at))


def fit(rows: list[Features], y: np.ndarray, *, factors: int = 8, epochs: int = 12, rate: float = 0.1, l2: float = 2e-4, least_texts: int = 4, clearly: float = 4.5, least_pace: float = 0.005, seed: int = 8) -> FactorizationMachine:
    """Logistic loss, one text at a time in a fixed random order, with AdaGrad steps; classes weigh alike.

    All terms of ``least_texts`` texts have a weight and factors. A term whose share of texts differs between the classes
    by fewer than ``clearly`` standard errors learns more slowly, down to ``least_pace``, and never not at all: it may
    matter only beside another term.
    """
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64), minlength=1 << BITS)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    positive = max(1.0, float(y.sum()))
    negative = max(1.0, len(y) - positive)
    among = np.bincount(np.concatenate([r[0] for r, t in zip(rows, y) if t == 1] + [np.empty(0, np.int64)]).astype(np.int64), minlength=1 << BITS)
    share = seen / max(1, len(y))
    apart = np.abs(among / positive - (seen - among) / negative) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive + 1 / negative))
    active = np.flatnonzero(seen >= least_texts)
    pace = rate * (np.maximum(least_pace, np.minimum(1, apart[active] / clearly) ** 8) if clearly else np.ones(len(active)))
    place[active] = np.arange(len(active))
    w, v = np.zeros(len(active)), rng.normal(0, 0.05, (len(active), factors))
    gw, gv, bias, gb = np.full(len(active), 1e-2), np.full((len(active), factors), 10.0), 0.0, 1e-2
    weights = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * negative))
    local = [(lambda a: a[a >= 0])(place[r[0]]) for r in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at = local[k]
            vk = v[at]
            total = vk.sum(axis=0)
            n = max(1, len(at))
            z = bias + w[at].sum() + 0.5 * (total @ total - (vk * vk).sum()) / n
            g = (logistic(z) - y[k]) * weights[k]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            dw = g + l2 * w[at]
            gw[at] += dw * dw
            w[at] -= pace[at] * dw / np.sqrt(gw[at])
            dv = g * (total - vk) / n + l2 * vk
            gv[at] += dv * dv
            v[at] -= rate * dv / np.sqrt(gv[at])
    return FactorizationMachine(float(bias), place, w.astype(np.float32), v.astype(np.float32))


def _score(model: FactorizationMachine, text: bytes | None) -> float:
    return logistic(model.margin(terms(text)[0]))


def toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", folds: int = 5, held_out: int = 0, per_class: int = 6000, most_terms: int = 4_000_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Learns from at most ``per_class`` labelled rows of either class, with about ``most_terms`` features together, outside the
    held-out fold (crc32 of doc_id as text modulo ``folds``); a document's score depends on its text alone. Null and empty texts get the score of no
    terms. Without labels every score is 0.5. Null ids aren't held out. Repeated rows get equal scores.
    """
    model = train(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held_out, per_class, most_terms, terms, fit, text)
    out = score_documents(docs, model, _score, keep=["doc_id"], text=text)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
