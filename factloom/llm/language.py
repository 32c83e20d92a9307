"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in stretches of ``STEPS`` bytes; one network reads each stretch
forward, another backward, and every position gets log-probabilities of the languages from both
states. A document's language is the one with the greatest mean over all positions of its whole
text. The network is trained in numpy by backpropagation through time on the driver, from a bounded
sample of stretches, with a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, has_letter, hash_sample, held_out, tidied

UNKNOWN = "und"
HIDDEN, STEPS = 8, 64
#: Learning reads at most this many documents, and this many stretches of them.
SAMPLE_DOCUMENTS, SAMPLE_STRETCHES = 2000, 8192
BATCH, ROUNDS, RATE = 256, 260, 0.02
#: Stretches computed side by side; bounds the memory of a task.
BLOCK = 4096

_PAD = 0


def _gates(x: np.ndarray, u: np.ndarray, h: np.ndarray):
    """One step of the cell on columns: update and reset gates, the reset part, the candidate, the new state."""
    k = HIDDEN
    inner = u @ h
    zr = x[: 2 * k] + inner[: 2 * k]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[:k], zr[k:]
    n = r * inner[2 * k :]
    n += x[2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return z, r, inner[2 * k :], n, new


class Network:
    """Weights: per direction an input table (gates x bytes) and a recurrent matrix; one output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        k = HIDDEN
        self.languages = languages
        self.weights = {
            "v": draw.normal(0, 0.3, (len(languages), 2 * k)), "b": np.zeros((len(languages), 1)),
            **{f"w{d}": draw.normal(0, 0.3, (3 * k, 256)) for d in (0, 1)}, **{f"u{d}": draw.normal(0, 0.3, (3 * k, k)) for d in (0, 1)},
        }
        self.weights = {name: value.astype(np.float32) for name, value in self.weights.items()}

    def states(self, stretches: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions per position: ``(steps, 2 * hidden, columns)`` for bytes ``(steps, columns)``."""
        steps, columns = stretches.shape
        out = np.empty((steps, 2 * HIDDEN, columns), dtype=np.float32)
        for d in (0, 1):
            w, u = self.weights[f"w{d}"], self.weights[f"u{d}"]
            h = np.zeros((HIDDEN, columns), dtype=np.float32)
            trail = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                before = h
                z, r, inner, n, h = _gates(np.take(w, stretches[t], axis=1, mode="clip"), u, h)
                out[t, d * HIDDEN : (d + 1) * HIDDEN] = h
                if keep is not None:
                    trail.append((t, z, r, inner, n, before))
            if keep is not None:
                keep.append(trail)
        return out

    def log_probabilities(self, states: np.ndarray) -> np.ndarray:
        """``(steps, languages, columns)``."""
        logits = self.weights["v"] @ states
        logits += self.weights["b"]
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits

    def gradients(self, stretches: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions: backpropagation through time."""
        k, keep = HIDDEN, []
        states = self.states(stretches, keep)
        error = np.exp(self.log_probabilities(states))
        error[:, labels, np.arange(len(labels))] -= 1
        error *= (mask / max(mask.sum(), 1))[:, None, :]
        out = {"v": np.einsum("tlc,thc->lh", error, states), "b": error.sum(axis=(0, 2))[:, None]}
        to_states = self.weights["v"].T @ error
        for d in (0, 1):
            u = self.weights[f"u{d}"]
            codes, inputs, du = [], [], np.zeros_like(u)
            carried = np.zeros((k, len(labels)), dtype=np.float32)
            for t, z, r, inner, n, before in reversed(keep[d]):
                carried = carried + to_states[t, d * k : (d + 1) * k]
                dn = carried * (1 - z) * (1 - n * n)
                dz = carried * (before - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                into_u = np.concatenate([dz, dr, dn * r])
                into_x = np.concatenate([dz, dr, dn])
                du += into_u @ before.T
                codes.append(stretches[t])
                inputs.append(into_x)
                carried = carried * z + u.T @ into_u
            code, into = np.concatenate(codes), np.concatenate(inputs, axis=1)
            out[f"w{d}"], out[f"u{d}"] = np.stack([np.bincount(code, row, 256) for row in into]), du
        return out

    def fit(self, stretches: np.ndarray, mask: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam over random batches of columns."""
        draw = np.random.default_rng(seed)
        first = {name: np.zeros_like(w) for name, w in self.weights.items()}
        second = {name: np.zeros_like(w) for name, w in self.weights.items()}
        for step in range(1, ROUNDS + 1):
            pick = draw.integers(0, stretches.shape[1], min(BATCH, stretches.shape[1]))
            rate = RATE * (1 - (step - 1) / ROUNDS)
            for name, g in self.gradients(stretches[:, pick], mask[:, pick], labels[pick]).items():
                np.clip(g, -1, 1, out=g)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                change = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                self.weights[name] = (self.weights[name] - change).astype(np.float32)


def stretches_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes ``(steps, n)``, the mask of real positions, and per stretch the index of its text; whole texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = -(-sizes // STEPS)
    flat = np.full(int(counts.sum()) * STEPS, _PAD, dtype=np.uint8)
    real = np.zeros(len(flat), dtype=bool)
    at = 0
    for text, count in zip(texts, counts.tolist()):
        flat[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        real[at : at + len(text)] = True
        at += count * STEPS
    owner = np.repeat(np.arange(len(texts)), counts)
    return flat.reshape(-1, STEPS).T, real.reshape(-1, STEPS).T, owner


def train(rows: list[tuple[str, str]]) -> Network | None:
    """A network from ``(text, lang)`` rows; None without any text."""
    rows = sorted((t, lang) for t, lang in rows if has_letter(t))
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    network = Network(languages)
    stretches, mask, owner = stretches_of([t.encode("utf-8", "replace") for t, _ in rows])
    labels = np.array([languages.index(lang) for _, lang in rows])[owner]
    draw = np.random.default_rng(3)
    pick = draw.permutation(stretches.shape[1])[:SAMPLE_STRETCHES]
    network.fit(stretches[:, pick], mask[:, pick].astype(np.float32), labels[pick])
    return network


def classify(network: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its mean probability over all positions, per text."""
    languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if network is not None and has_letter(t)]
    if not known:
        return languages, scores
    stretches, mask, owner = stretches_of([texts[i].encode("utf-8", "replace") for i in known])
    logs = np.zeros((len(network.languages), len(known)))
    shares = np.zeros_like(logs)
    for at in range(0, len(owner), BLOCK):
        here = slice(at, at + BLOCK)
        found = network.log_probabilities(network.states(stretches[:, here]))
        real = mask[:, here]
        for k in range(len(network.languages)):
            logs[k] += np.bincount(owner[here], np.where(real, found[:, k], 0).sum(axis=0), len(known))
            shares[k] += np.bincount(owner[here], np.where(real, np.exp(found[:, k]), 0).sum(axis=0), len(known))
    best = logs.argmax(axis=0)
    lengths = np.bincount(owner, mask.sum(axis=0), len(known))
    for n, i in enumerate(known):
        languages[i] = network.languages[best[n]]
        scores[i] = min(max(shares[best[n], n] / lengths[n], 0.0), 1.0)
    return languages, scores


def learn(documents: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> Network | None:
    """Trains on at most ``limit`` documents that are not held out and have a text and a language."""
    rows = documents.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return train([(r["text"], r["lang"]) for r in hash_sample(rows, limit).select("text", "lang").collect()])


def identify(documents: DataFrame, network: Network | None) -> DataFrame:
    """Adds ``lang_pred, score`` to ``documents(text, ...)``, without a shuffle; rows and other columns stay.

    ``und`` with score 0 for a null text, one without a letter, or where nothing could be learned.
    Columns of these two names in the input are replaced.
    """
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    schema = documents.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_bytes(batches):
            batch["lang_pred"], batch["score"] = classify(network, batch["text"].tolist())
            yield batch

    return documents.select(*kept).mapInPandas(tidied(label), schema)
