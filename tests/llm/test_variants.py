"""Spelling variants against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest
from brute import SCHEMA, odd_documents, row

from factloom.llm import variants as V

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced character lies between them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def made(seed=3):
    draw = random.Random(seed)
    base = ["".join(draw.choice("aabé") for _ in range(draw.randint(5, 7))) for _ in range(150)] + ["Zürich×er", "aaaaaa", "aaaaaaa", "aaaaaaaa", "ÉCOLES", "x" * 300, "x" * 299]
    out = []
    for doc in range(80):
        some = [draw.choice(base[: 1 + int(len(base) * draw.random() ** 2)]) for _ in range(60)]
        out.append(row(doc, draw.choice([" ", "-", "1"]).join(some)))
    return out + [row(7, "Écoles " * 40 + "aaaaab " * 300), row(None, "aaaaaa_bbbbbb " * 9), row(None, None), row(3, "")]


@pytest.mark.parametrize("tile", [1024, 8])
def test_variants(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE", tile)
    for rows in (made(), odd_documents()):
        found = V.variants(spark.createDataFrame(rows, SCHEMA))
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        expected = brute([r[:2] for r in rows])
        assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == expected
    assert any(r[4] > 3 for r in brute([r[:2] for r in made()]))


def test_chains_end(spark):
    words = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("zzzzzz", 9)]
    forms = spark.createDataFrame([(a[0], b[0]) for a, b in zip(words, words[1:5])], "word string, form string")
    assert {tuple(r) for r in V.roots(forms).collect()} == {(w, "aabbbb") for w, _ in words[:4]}


def test_empty(spark):
    assert V.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.variants(spark.createDataFrame([row(1, None), row(2, "too few")], SCHEMA)).collect() == []
