"""Toxicity from a lexicon that is matched with misspellings and read in context.

The lexicon is learned: words, and stems of words, that stand in toxic documents far more often than
chance (a likelihood ratio test), with their log-odds. A word of a text is matched whole, by a stem
it starts with, or by running its Levenshtein automaton over the trie of the words and stems. Every
match is read in a window of words: quotation marks around it or a word of reporting nearby make it a
quotation, a form of address nearby makes it an attack. A logistic model over the counts of these
kinds gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD_CACHE, labelled_sample
from factloom.llm.near_duplicates import minwise, shingle_set

#: Learning reads at most this many labelled documents; every term that passes the tests on them is kept.
SAMPLE_DOCUMENTS = 8000
THRESHOLD = 0.3
WINDOW = 6
_LEAST_RATIO, _LEAST_TEST = 3.0, 28.0
_STEMS = range(3, 9)

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»]")
REPORTING = frozenset("said says say called wrote writes quote quoted quotes word term means sagte schrieb nannte wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your youre u du dich dein deine ihr euch tu toi ton ta vous votre tú usted eres tus".split())


def max_distance(term: str) -> int:
    """Edits allowed for the letters of a word, or of a stem with its ``*``."""
    n = len(term.rstrip("*"))
    return 0 if n < 4 else 1 if n < 9 else 2


class Lexicon:
    """Terms with weights as a trie; :meth:`match` finds the closest term of a word.

    A term that ends in ``*`` is a stem: any word that starts with it matches, and any word with a
    start within the distance allowed for its letters.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = dict(sorted(weights.items()))
        self.root: dict = {}
        self.pieces: dict[tuple[int, str], set[tuple[int, int, bool]]] = {}
        self.stems = {len(t) - 1: {s for s in self.weights if s[-1] == "*" and len(s) == len(t)} for t in self.weights if t[-1] == "*"}
        for term in self.weights:
            letters = term.rstrip("*")
            node = self.root
            for letter in letters:
                node = node.setdefault(letter, {})
            node.setdefault("", []).append(term)
            # k edits leave one of k + 1 pieces of the term whole, moved by at most k places.
            k = max_distance(term)
            cuts = [len(letters) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                self.pieces.setdefault((k, letters[a:b]), set()).add((a, len(letters), term[-1] == "*"))
        self.sizes = sorted({(k, len(p)) for k, p in self.pieces if k})
        self.seen: dict[str, tuple[str, int] | None] = {}

    def _may_match(self, word: str) -> bool:
        for k, size in self.sizes:
            for at in range(len(word) - size + 1):
                known = self.pieces.get((k, word[at : at + size]))
                if known and any(abs(at - a) <= k and len(word) >= n - k and (stem or len(word) <= n + k) for a, n, stem in known):
                    return True
        return False

    def _stem(self, word: str) -> tuple[str, int] | None:
        found = [s for size, stems in self.stems.items() if size <= len(word) and (s := word[:size] + "*") in stems]
        return (max(found, key=len), 0) if found else None

    def _walk(self, word: str, most: int) -> tuple[str, int] | None:
        """The closest term within its allowance; ties go to the term that sorts first.

        Bit i of state e says that the automaton of the word can have read i of its letters with e
        edits; it steps along the trie and a branch ends where no state is left. A word is accepted
        where all letters are read, a stem after any of them.
        """
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << i
        full = (1 << len(word) + 1) - 1
        start = tuple((1 << e + 1) - 1 & full for e in range(most + 1))
        best: tuple[int, str] | None = None
        todo = [(self.root, start)]
        while todo:
            node, states = todo.pop()
            for term in node.get("", ()):
                for e, state in enumerate(states[: max_distance(term) + 1]):
                    if state if term[-1] == "*" else state >> len(word) & 1:
                        if best is None or (e, term) < best:
                            best = (e, term)
                        break
            for letter, child in node.items():
                if not letter:
                    continue
                mask = masks.get(letter, 0)
                new, lower, lower_new = [], 0, 0
                for e, state in enumerate(states):
                    now = (state & mask) << 1
                    if e:
                        now |= lower | lower << 1 | lower_new << 1
                    now &= full
                    new.append(now)
                    lower, lower_new = state, now
                if new[-1]:
                    todo.append((child, tuple(new)))
        return best and (best[1], best[0])

    def match(self, word: str) -> tuple[str, int] | None:
        """``(term, distance)`` or None; remembered for up to ``WORD_CACHE`` words."""
        if word in self.seen:
            return self.seen[word]
        if len(self.seen) >= WORD_CACHE:
            self.seen.clear()
        found = (word, 0) if word in self.weights else self._stem(word) or (self._walk(word, 2) if self._may_match(word) else None)
        self.seen[word] = found
        return found


FEATURES = 9


def context_features(lexicon: Lexicon, text: str | None) -> np.ndarray:
    """Counts of matches by kind, their weights and density, for a whole text; null counts as empty."""
    out = np.zeros(FEATURES)
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    hits = {w: m for w in set(words) if (m := lexicon.match(w)) is not None}
    out[8] = math.log1p(len(words)) / 10
    if not hits:
        return out
    places = [(i, f) for i, f in enumerate(_WORD.finditer(low)) if f[0] in hits]
    quotes = [q.start() for q in _QUOTES.finditer(low)]
    at = 0
    weight = strongest = 0.0
    for i, found in places:
        term, distance = hits[found[0]]
        while at < len(quotes) and quotes[at] < found.start():
            at += 1
        near = words[max(i - WINDOW, 0) : i + WINDOW + 1]
        # Inside quotation marks if an odd number stands before the word and the closing one is near.
        inside = at % 2 == 1 and at < len(quotes) and quotes[at] - found.end() < 12 * WINDOW
        quoted = inside or not REPORTING.isdisjoint(near)
        out[3 if quoted else min(distance, 2)] += 1
        out[4] += not ADDRESS.isdisjoint(near)
        if not quoted:
            value = lexicon.weights[term] / (1 + distance)
            weight += value
            strongest = max(strongest, value)
    out[:5] = np.log1p(out[:5])
    out[5], out[6], out[7] = math.log1p(weight), strongest, math.log1p(100 * weight / len(words))
    return out


def _with_stems(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in _STEMS if n < len(w)}


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """Words and stems that mark label 1: by document counts, a ratio and a likelihood ratio test.

    A stem goes where a shorter one holds, or where it says no more than one word. The words that a
    stem holds stay beside it, for their misspelled forms.
    """
    marked, plain = Counter(), Counter()
    n = [0, 0]
    for text, label in rows:
        (marked if label else plain).update(_with_stems(set(_WORD.findall(text.lower()))))
        n[label] += 1
    weights = {}
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    for term, count in marked.items():
        both = count + plain[term]
        if len(term) < 3 or count < _LEAST_RATIO * share * both:
            continue
        test = 2 * count * math.log(count / (both * share))
        if plain[term]:
            test += 2 * plain[term] * math.log(plain[term] / (both * (1 - share)))
        if test >= _LEAST_TEST:
            weights[term] = math.log((count + 0.5) / (plain[term] + 0.5)) - math.log(share / (1 - share))
    widest = Counter()
    for word in marked:
        if word[-1] != "*":
            for n_letters in _STEMS:
                stem = word[:n_letters] + "*"
                if n_letters < len(word) and stem in weights:
                    widest[stem] = max(widest[stem], marked[word])
    kept: dict[str, float] = {}
    beside: dict[str, list[str]] = {}
    for term in sorted(weights, key=lambda t: (t[-1] != "*", len(t), t)):
        letters = term.rstrip("*")
        holding = [s for k in _STEMS if k <= len(letters) and kept.get(s := letters[:k] + "*", -math.inf) >= 0.7 * weights[term]]
        if not holding and (term[-1] != "*" or marked[term] >= 1.5 * widest[term]):
            kept[term] = weights[term]
        elif term[-1] != "*":
            for stem in holding:
                beside.setdefault(stem, []).append(term)
    words = [w for stem in kept for w in beside.get(stem, ())]
    return Lexicon({w: weights[w] for w in (*kept, *words)})


class Model:
    """The lexicon and the weights of the logistic model over its features."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def __reduce__(self):
        return _restored, (self.lexicon.weights, self.weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([context_features(self.lexicon, t) for t in texts]).reshape(-1, FEATURES)
        return _probability(x, self.weights)


_RESTORED: dict[int, Model] = {}


def _restored(terms: dict[str, float], weights: np.ndarray) -> Model:
    """One model per worker and content, so that its remembered words outlive a task."""
    key = hash((tuple(terms.items()), weights.tobytes()))
    if key not in _RESTORED:
        _RESTORED.clear()
        _RESTORED[key] = Model(Lexicon(terms), weights)
    return _RESTORED[key]


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = _probability(x, w)
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each group of copies and near copies, told by three minwise tokens of the shingles.

    Otherwise each rare word of a document with many copies would look like a frequent mark.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in sorted(rows):
        found = shingle_set(text)
        tokens = {(k, int(t)) for k, t in enumerate(minwise(found)[:3])} if len(found) else {(3, 0)}
        if seen.isdisjoint(tokens):
            out.append((text, label))
        seen |= tokens
    return out


def train(rows: list[tuple[str, int]]) -> Model:
    """Two thirds of the distinct rows give the lexicon, the rest the weights of the score.

    Without rows the lexicon is empty and every score is 0.5, as nothing is known of either label.
    """
    rows = without_copies(rows)
    lexicon = learn_lexicon([r for i, r in enumerate(rows) if i % 3])
    rest = rows[::3]
    if not rest:
        return Model(lexicon, np.zeros(FEATURES + 1))
    x = np.array([context_features(lexicon, t) for t, _ in rest])
    return Model(lexicon, _fit(x, np.array([label for _, label in rest], dtype=float)))


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_DOCUMENTS) -> Model:
    return train([(r["text"], r["label"]) for r in labelled_sample(documents, labels, label, limit).collect()])


def score_toxicity(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score, predicted`` to ``documents(text, ...)``, without a shuffle; rows and other columns stay.

    Null and empty texts have no matches and get the score of such a text; a model learned without
    labels scores 0.5 for all, which is over the threshold. Columns of these two
    names in the input are replaced.
    """
    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    schema = documents.select(*kept).schema.add("score", "double")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = model.score(batch["text"].tolist())
            yield batch

    return documents.select(*kept).mapInPandas(judge, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
