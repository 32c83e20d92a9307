"""SimHash fingerprints and their components against plain versions."""

import random

import numpy as np
import pytest
import xxhash
from brute import SCHEMA, odd_documents, row

from factloom.llm import fingerprints as S


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """The smallest position in ``prints`` that each one reaches."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def crowd(n, seed=2):
    """Clusters around centres, chains of four bits a step, pairs at five bits, and unrelated prints."""
    draw = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in draw.sample(range(64), k))
    out = [draw.getrandbits(64) for _ in range(n)]
    for _ in range(5):
        centre = draw.getrandbits(64)
        out += [flip(centre, draw.randint(0, 3)) for _ in range(n // 5)]
    for k in (4, 4, 5, 5):
        x = draw.getrandbits(64)
        for _ in range(8):
            out.append(x)
            x = flip(x, k)
    return list(dict.fromkeys([0, (1 << 64) - 1, *out]))


def test_fingerprint():
    for r in odd_documents():
        assert S.fingerprint(r[1]) == plain_print(r[1])
    assert S.fingerprint(" A b\u0085 C d e " * 3) == plain_print(" A b\u0085 C d e " * 3)
    long = " ".join(str(k % 977) for k in range(200_000))
    assert S.fingerprint(long) == plain_print(long)


def test_counts_are_a_lower_bound():
    prints = np.array(crowd(200), dtype=np.uint64)
    counts = S.segment_counts(prints).astype(int)
    manhattan = np.abs(counts[:, None] - counts[None, :]).sum(axis=2)
    assert (manhattan <= np.bitwise_count(prints[:, None] ^ prints[None, :])).all()


@pytest.mark.parametrize("levels", [1, 2])
def test_near_prints_meet(levels):
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(300)]
    pairs = [(x, x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4)))) for x in base]
    prints = np.array([p for pair in pairs for p in pair], dtype=np.uint64)
    at = {}
    for rows, cell, visits in S.cells(prints, levels):
        for r, c in zip(rows.tolist(), cell.tolist()):
            at.setdefault(r, {})[c] = visits
    for k in range(len(pairs)):
        a, b = at[2 * k], at[2 * k + 1]
        assert any(a[c] & b[c] == 0 for c in a.keys() & b.keys())


@pytest.mark.parametrize("levels, most", [(1, 4096), (1, 16), (2, 4096), (2, 16)])
def test_components_of_prints(spark, monkeypatch, levels, most):
    monkeypatch.setattr(S, "CROWD", most)
    prints = crowd(400)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    found = {r.node: r.component for r in S.link_components(nodes, levels).collect()}
    label = plain_components(prints)
    groups, expected = {}, {}
    for p, k in zip(signed, label):
        groups.setdefault(found.get(p, p), set()).add(p)
        expected.setdefault(k, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_documents(spark):
    rows = odd_documents()
    table = spark.createDataFrame(rows, SCHEMA)
    prints = [plain_print(r[1]) for r in rows]
    distinct = list(dict.fromkeys(prints))
    label = dict(zip(distinct, plain_components(distinct)))
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[label[p]] = min(least.get(label[p], r[0]), r[0])
    expected = sorted(((r[0], p, least.get(label[p])) for r, p in zip(rows, prints)), key=str)
    found = [(r.doc_id, r.print % (1 << 64), r.component_id) for r in S.simhash_groups(table).collect()]
    assert sorted(found, key=str) == expected


def test_empty_and_alone(spark):
    assert S.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in S.simhash_groups(spark.createDataFrame([row(None, None)], SCHEMA)).collect()] == [(None, 0, None)]
