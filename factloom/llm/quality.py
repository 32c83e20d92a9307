"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from the shares of
character classes, of pairs of classes, and of repeated byte strings in it; gated attention weighs
the encodings; the weighted sum is scored. Encoder, attention and score are learned together from
document labels, in numpy, from a bounded sample, with a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import labelled_sample

PASSAGE = 512
#: Learning reads at most this many labelled documents, and all passages of each.
SAMPLE_DOCUMENTS = 6000
HIDDEN, ATTENTION = 24, 12
BATCH, ROUNDS, RATE = 256, 400, 0.01
#: Passages computed side by side; bounds the memory of a task.
BLOCK = 2048
THRESHOLD = 0.7

_CLASSES, _REPEATS = 16, 509
_PAD = _CLASSES - 1


def _class_table() -> np.ndarray:
    table = np.full(256, 10, dtype=np.uint8)
    table[:32] = 14
    for k, signs in enumerate((b" ", b"\n\r\t", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".", b",;:", b"!?", b"|/\\", b"%&*#$@~^")):
        table[list(signs)] = k
    table[0x80:0xC0], table[0xC0:0xC5], table[0xC5:] = 11, 12, 13
    return table


_TABLE = _class_table()
FEATURES = _CLASSES + _CLASSES * _CLASSES + 2


def passages_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes ``(n, PASSAGE)``, the length of each passage, and the index of its text; whole texts, one passage at least."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(-(-sizes // PASSAGE), 1)
    flat = np.zeros(int(counts.sum()) * PASSAGE, dtype=np.uint8)
    at = 0
    for text, count in zip(texts, counts.tolist()):
        flat[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        at += count * PASSAGE
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat.reshape(-1, PASSAGE), np.clip(sizes[owner] - place * PASSAGE, 0, PASSAGE), owner


def features(passages: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``(n, FEATURES)``: roots of the shares of classes and class pairs, repetition, length."""
    n = len(passages)
    real = np.arange(PASSAGE) < lengths[:, None]
    classes = np.where(real, _TABLE[passages], _PAD).astype(np.int32)
    rows = np.arange(n, dtype=np.int32)[:, None]
    size = np.maximum(lengths, 1)[:, None].astype(np.float32)
    out = np.empty((n, FEATURES), dtype=np.float32)
    pairs = np.bincount((rows * _CLASSES**2 + classes[:, :-1] * _CLASSES + classes[:, 1:]).ravel(), minlength=n * _CLASSES**2).reshape(n, _CLASSES, _CLASSES)
    pairs[:, _PAD, :] = 0
    single = pairs.sum(axis=2)
    single[:, _PAD] = 0
    pairs[:, :, _PAD] = 0
    out[:, :_CLASSES] = np.sqrt(single / size)
    out[:, _CLASSES:-2] = np.sqrt(pairs.reshape(n, -1) / size)
    wide = passages.astype(np.int32)
    codes = (wide[:, :-3] + 31 * wide[:, 1:-2] + 961 * wide[:, 2:-1] + 29791 * wide[:, 3:]) % _REPEATS
    codes[~real[:, 3:]] = _REPEATS
    counts = np.bincount((rows * (_REPEATS + 1) + codes).ravel(), minlength=n * (_REPEATS + 1)).reshape(n, -1)[:, :_REPEATS]
    out[:, -2] = np.sqrt((counts.astype(np.float32) ** 2).sum(axis=1)) / size[:, 0]
    out[:, -1] = np.log1p(lengths) / 6
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The model: encoder ``w``, gated attention ``v, u, a``, score ``c``; biases are the last column or entry."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        shapes = {"w": (FEATURES + 1, HIDDEN), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN + 1,)}
        self.weights = {k: draw.normal(0, 0.3 / np.sqrt(s[0] / 16), s).astype(np.float32) for k, s in shapes.items()}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encodings, the two halves of the gate, and the attention logit of each passage."""
        w = self.weights
        h = np.tanh(x @ w["w"][:-1] + w["w"][-1])
        t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        return h, t, s, (t * s) @ w["a"]

    def gradients(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the documents; every document owns a passage."""
        w, n = self.weights, len(labels)
        h, t, s, logit = self.encode(x)
        share = np.exp(logit - logit.max())
        share /= np.maximum(np.bincount(owner, share, n), 1e-30)[owner]
        bag = np.zeros((n, HIDDEN), dtype=np.float32)
        np.add.at(bag, owner, share[:, None] * h)
        error = (_sigmoid(bag @ w["c"][:-1] + w["c"][-1]) - labels) / n
        to_bag = error[:, None] * w["c"][:-1]
        along = (to_bag[owner] * h).sum(axis=1)
        to_logit = share * (along - np.bincount(owner, share * along, n)[owner])
        to_gate = to_logit[:, None] * w["a"]
        to_t, to_s = to_gate * s * (1 - t * t), to_gate * t * s * (1 - s)
        to_h = (share[:, None] * to_bag[owner] + to_t @ w["v"].T + to_s @ w["u"].T) * (1 - h * h)
        return {
            "w": np.vstack([x.T @ to_h, to_h.sum(axis=0)]), "v": h.T @ to_t, "u": h.T @ to_s,
            "a": (to_logit[:, None] * t * s).sum(axis=0), "c": np.append(bag.T @ error, error.sum()),
        }

    def fit(self, x: np.ndarray, owner: np.ndarray, labels: np.ndarray, seed: int = 17) -> None:
        draw = np.random.default_rng(seed)
        starts = np.searchsorted(owner, np.arange(len(labels) + 1))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, ROUNDS + 1):
            pick = draw.integers(0, len(labels), min(BATCH, len(labels)))
            rows = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            owners = np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick])
            rate = RATE * (1 - (step - 1) / ROUNDS)
            for k, g in self.gradients(x[rows], owners, labels[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] * (1 - 1e-4) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def train(rows: list[tuple[str, int]]) -> Attention | None:
    """A model from ``(text, label)`` rows; None without any."""
    if not rows:
        return None
    rows = sorted(rows)
    counts, x = [], []
    for text, _ in rows:
        # One text at a time, so that besides the features only its own passages take memory.
        passages, lengths, _ = passages_of([text.encode("utf-8", "replace")])
        counts.append(len(lengths))
        x.extend(features(passages[i : i + BLOCK], lengths[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK))
    x, owner = np.concatenate(x), np.repeat(np.arange(len(rows)), counts)
    model = Attention()
    model.fit(x, owner, np.array([label for _, label in rows], dtype=np.float32))
    return model


def score_texts(model: Attention | None, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 of each whole text; null counts as empty; 0.5 without a model."""
    n = len(texts)
    if model is None or not n:
        return np.full(n, 0.5)
    passages, lengths, owner = passages_of([(t or "").encode("utf-8", "replace") for t in texts])
    weight, bag = np.zeros(n), np.zeros((n, HIDDEN))
    for at in range(0, len(owner), BLOCK):
        here = slice(at, at + BLOCK)
        h, _, _, logit = model.encode(features(passages[here], lengths[here]))
        share = np.exp(logit.astype(np.float64))
        weight += np.bincount(owner[here], share, n)
        for k in range(HIDDEN):
            bag[:, k] += np.bincount(owner[here], share * h[:, k], n)
    c = model.weights["c"]
    return _sigmoid(bag / weight[:, None] @ c[:-1].astype(np.float64) + c[-1])


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_DOCUMENTS) -> Attention | None:
    return train([(r["text"], r["label"]) for r in labelled_sample(documents, labels, label, limit).collect()])


def score_quality(documents: DataFrame, model: Attention | None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score, predicted`` to ``documents(text, ...)``, without a shuffle; rows and other columns stay.

    Null and empty texts are one empty passage. Columns of these two names in the input are replaced.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    schema = documents.select(*kept).schema.add("score", "double")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = score_texts(model, batch["text"].tolist())
            yield batch

    return documents.select(*kept).mapInPandas(judge, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
