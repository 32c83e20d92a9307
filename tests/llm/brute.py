"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import random
import re

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, n int, component string, anchor string, _words string, score string, starts int"
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SYLLABLES = "tha ren est ing ora lim bel dun kos fer mar til".split()


def words(draw, n):
    return ["".join(draw.choice(_SYLLABLES) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def row(doc_id, text, lang="en"):
    """A document with extra columns whose names the operators use inside."""
    return (doc_id, text, lang, "s", None if text is None else len(text), "k", 7, 1, "c", "a", "w", "s", 3)


def odd_documents(seed=1):
    """Nulls, empties, short and long texts, copies, near copies, shared passages, repeated and clashing ids."""
    draw = random.Random(seed)
    base = words(draw, 160)
    passage = " ".join(words(draw, 60))
    out = [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "One"), row(6, "a b c d"), row(7, "..!!"), row(None, " ".join(base)), row(None, None)]
    for i in range(40):
        near = list(base)
        for _ in range(draw.randint(0, 5)):
            near[draw.randrange(len(near))] = "changed" + str(draw.randint(0, 99))
        out.append(row(100 + i, " ".join(near)))
    for i in range(10):
        out.append(row(200 + i, " ".join([*words(draw, draw.randint(0, 80)), passage, *words(draw, draw.randint(0, 80))])))
    out += [row(300, "é" * 260), row(301, "xé" + "é" * 250), row(302, "z" * 450), row(303, "".join(chr(97 + draw.randrange(26)) for _ in range(30_000)))]
    out += [row(400, "same row again " * 30)] * 2 + [row(401, "first text of this id " + " ".join(base)), row(401, "other text " + " ".join(words(draw, 50)))]
    return out


def shingles(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1))) if found else frozenset()


def near_duplicates(rows):
    """``{(doc_id, text): (n, component, kept)}``."""
    texts = [(r[0], r[1], shingles(r[1])) for r in rows]
    parent = {r[0]: r[0] for r in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _, s) in enumerate(texts):
        for b, _, t in texts[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {(i, t): (len(s), None if i is None else find(i), i is None or find(i) == i) for i, t, s in texts}


def repeats(texts, length=200):
    """Per text (size, removed, runs, what is left)."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        marks = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                marks[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])) == 1).sum())
        out.append((len(d), int(marks.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~marks])))
    return out


def contaminated(text, items):
    """(words, hit words, item ids)."""
    found = _WORDS.findall((text or "").translate(_LOW))
    hit, ids = set(), set()
    for item_id, item in items:
        own = _WORDS.findall((item or "").translate(_LOW))
        for s in range(max(len(own) - 9, 1)) if own and item_id is not None else ():
            window = own[s : s + 10]
            for i in range(len(found) - len(window) + 1):
                if found[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    ids.add(str(item_id))
    return len(found), len(hit), sorted(ids)


def sha(value):
    return hashlib.sha256(value).hexdigest()
