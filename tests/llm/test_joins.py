"""Near duplicates, repeated bytes, benchmark passages and packing against plain versions."""

import collections
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from brute import SCHEMA, contaminated, near_duplicates, odd_documents, repeats, row, words
from tokenizers import Tokenizer

from factloom.llm import bwt
from factloom.llm import decontaminate as D
from factloom.llm import near_duplicates as N
from factloom.llm import packing as P
from factloom.llm import repeats as R
from factloom.llm.components import connected_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "odd")
    spark.createDataFrame(odd_documents(), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 1), 50: 50, 55: 50, 60: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, documents, monkeypatch):
    want = near_duplicates([(r.doc_id, r.text) for r in documents.collect()])
    ids = collections.Counter()
    for (i, _), (n, c, k) in want.items():
        ids[i, n, c, k] += 1
    ids[400, want[400, "same row again " * 30][0], 400, True] += 1
    # Small leaves and few levels make the later steps work too.
    for leaf, depth, block in ((8_000_000, 10, 4096), (20, 3, 7)):
        monkeypatch.setattr(N, "LEAF_PAIRS", leaf)
        monkeypatch.setattr(N, "DEPTH", depth)
        monkeypatch.setattr(N, "BLOCK", block)
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(documents).collect())
        assert got == ids
    assert N.near_duplicates(empty(spark)).count() == 0


def test_unlinked_members_of_a_node_are_found(spark):
    """Pairs around the bound in one large group: every link counts, also those not through the first."""
    draw = random.Random(4)
    base = words(draw, 100)
    rows = []
    for i in range(60):
        text = list(base)
        for at in draw.sample(range(100), draw.randint(1, 5)):
            text[at] = f"w{draw.randint(0, 4)}"
        rows.append(row(1000 - i, " ".join(text)))
    want = near_duplicates([(r[0], r[1]) for r in rows])
    got = {(r.doc_id): r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: c for (i, _), (_, c, _) in want.items()}


def test_small_leaves_are_compared_together():
    """Leaves side by side give the pairs that each gives alone, and cuts of batches do not part a leaf."""
    draw = np.random.default_rng(7)
    sizes = [1, 2, 3, 2, N.SMALL_LEAF, 5, 1, 9]
    key = np.repeat(np.arange(len(sizes)) - 3, sizes)
    n = draw.integers(80, 120, len(key))
    component = draw.integers(0, 3, len(key))
    base = draw.integers(0, 256, (len(sizes), N.COORDINATES), dtype=np.uint8)
    other = draw.integers(0, 256, (len(key), N.COORDINATES), dtype=np.uint8)
    sketch = np.where(draw.random((len(key), N.COORDINATES)) < 0.16, other, base[key + 3])
    sets = [np.unique(np.concatenate([np.arange(70, dtype=np.uint32), draw.integers(0, 1 << 32, m - 70, dtype=np.uint32)])) for m in n]
    want = set()
    for k in np.unique(key):
        own = np.flatnonzero(key == k)
        for i, js in N.likely_across(component[own], n[own], sketch[own]):
            want |= {tuple(sorted((int(own[i]), int(own[j])))) for j in js}
    i, j = N.likely_beside(key, component, n, sketch)
    assert want and collections.Counter(zip(i.tolist(), j.tolist())) == collections.Counter(want)
    links = N.linking_beside(key, component, n, sketch, sets)
    assert {(key[i], component[i]) for i, _ in links}
    for k in np.unique(key):
        own = np.flatnonzero(key == k)
        alone = N.linking_pairs(component[own], n[own], sketch[own], [sets[at] for at in own])
        assert len(alone) == len([1 for i, _ in links if key[i] == k])
    table = pd.DataFrame({"key": key, "at": np.arange(len(key))})
    for size in (1, 2, 7, len(key)):
        pieces = list(N._whole_leaves(iter([table.iloc[at : at + size] for at in range(0, len(key), size)])))
        assert pd.concat(pieces)["at"].tolist() == table["at"].tolist()
        assert sum(p["key"].nunique() for p in pieces) == len(sizes)


def test_leaves_do_not_cost_a_batch_each():
    """Thousands of small leaves come back in as many tables as there were batches, not as leaves."""
    key = np.repeat(np.arange(3000), 2)
    found = list(N._whole_leaves(iter([pd.DataFrame({"key": key})])))
    assert len(found) <= 2


@pytest.mark.parametrize("most", [50_000, 1])
def test_repeats(spark, documents, monkeypatch, most):
    monkeypatch.setattr(R, "MAX_STRINGS", most)
    rows = documents.collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, repeats([r.text for r in rows])))
    got = R.cut_repeats(documents).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert got[0].source == "s" and got[0].anchor == "a" and got[0].starts == 3


def test_repeats_of_an_empty_table(spark):
    assert R.cut_repeats(empty(spark)).count() == 0


def test_spans_of_texts_beyond_a_chunk(monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 500)
    draw = random.Random(2)
    texts = [bytes(draw.choice(b"abcdefgh") for _ in range(n)) for n in (0, 199, 200, 201, 700, 5000, 90)]
    owner, place, first, last, anchor, span = R.spans_of(texts)
    covered = sorted((int(o), s) for o, a, b in zip(owner, first, last) for s in range(a, b + 1))
    assert sorted(set(covered)) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 199)]
    assert all(0 <= p - f <= 152 and p >= b for p, f, b in zip(place, first, last))


def test_transforms_and_their_merge():
    draw = np.random.default_rng(1)
    for _ in range(40):
        strings = [draw.integers(1, 4, draw.integers(0, 9)).tolist() for _ in range(draw.integers(3, 12))]
        cuts = [0, *sorted(draw.integers(1, len(strings), 2).tolist()), len(strings)]
        cuts = sorted(set(cuts))
        shards = [bwt.transform(np.array(sum(strings[a:b], []), dtype=np.int64), np.array([len(s) for s in strings[a:b]])) for a, b in zip(cuts, cuts[1:])]
        merged = bwt.merge(shards, 99)
        got = [(int(shards[s].string[r]) + cuts[s], int(shards[s].start[r])) for s, r in zip(merged.shard, merged.row)]
        want = sorted(((i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)), key=lambda t: [(1, c) for c in strings[t[0]][t[1] :]] + [(0, t[0])])
        assert got == want
        for (a, b), (c, d), n in zip(want, want[1:], merged.shared[1:]):
            x, y = strings[a][b:], strings[c][d:]
            assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def item_table(spark, documents):
    text = next(r.text for r in documents.collect() if r.doc_id == 205).split()
    items = [(1, " ".join(text[-90:-60]).upper()), (2, "one"), (3, None), (4, ""), (None, "a b c"), (5, "b C d"), (6, "never seen in any text of these at all really"),
             (7, " ".join(text[-95:-85])), (7, " ".join(text[-95:-85])), (10, "same row again same row again same")]
    return items, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, key string")


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_decontamination(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", broadcast)
    items, table = item_table(spark, documents)
    want = collections.Counter()
    for r in documents.collect():
        n, hit, ids = contaminated(r.text, items)
        want[r.doc_id, n, hit, len(ids), ",".join(ids), hit > 0] += 1
    got = D.find_items(documents, table).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in got) == want
    assert sum(k[2] > 0 for k in want) > 5


def test_decontamination_without_rows(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in D.find_items(documents, none).collect()} == {(0, False)}
    assert D.find_items(empty(spark), item_table(spark, documents)[1]).count() == 0


def test_words_are_lower_cased_in_ascii_only(spark):
    found = spark.createDataFrame([("ÉCOLE Éc ABCİx 1A-b",)], "t string").select(D.words_of("t").alias("w")).first()
    assert found.w == ["École", "Éc", "abcİx", "1a", "b"]


HARD = ["a'b c's d'...x", "<|endoftext|>. A<|startoftext|>b", "Σίσυφος ΣΑΣ. İstanbul", "é ́x  y\tz  w\r\n q", "don't!! 123,45%%% x'", "\x0bvt \x1c fs", "''..'' ...' '...", "ABC123abc 'S 'Ll", "ﬁ Ⅷ x² a　b", " ", "\n"]


def test_tokens_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text in HARD + [r[1] for r in odd_documents() if r[1]]:
        assert np.frombuffer(P.text_ids(text, TOKENIZER), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_words_go_straight_to_the_model_and_few_are_kept(monkeypatch):
    """Letters, digits and signs need no step of the tokenizer; beyond the bound older chunks are forgotten."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    words = ["Straße,", "NIÑO!?", "ªµº×÷", "don't", "it's's", "a1b22", "x<|>y", "'re'Re", "3/4%", "Öl"] + [f"w{c}{d}" for c in "abcé" for d in "xyzÿ"]
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    monkeypatch.setattr(P, "CHUNK_CACHE", 8)
    ids, calls = P._Ids(tokenizer), []
    monkeypatch.setattr(ids, "encode", lambda *a, **k: calls.append(a) or tokenizer.encode(*a, **k))
    for _ in range(2):
        for word, found in zip(words, want):
            assert np.frombuffer(ids[word], "<u4").tolist() == found
            assert len(ids) + len(ids.older) <= 16 + 1
    assert {a[0] for a in calls} <= {"ªµº×÷", "x<|>y"}


def check_plan(counts, capacity=4096):
    used, fill = collections.Counter(), collections.defaultdict(list)
    for s in P.pack_lengths(counts, capacity):
        used[s.length] += s.copies * s.times
        for t in {0, s.times - 1}:
            fill[s.sequence + t] += [(s.offset + i * s.length, s.length) for i in range(s.copies)]
    assert used == collections.Counter(counts)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return max((s.sequence + s.times for s in P.pack_lengths(counts, capacity)), default=0)


def test_plans():
    draw = random.Random(8)
    assert check_plan({}) == 0
    assert check_plan({4096: 3, 4095: 2, 1: 2}) == 5
    assert check_plan({10: 3, 5: 2, 3: 1, 2: 1}, 10) == 5
    assert check_plan({6: 1, 4: 1, 3: 2, 2: 2}, 10) == 2
    assert check_plan({1: 100_000}) == -(-100_000 // 4096)
    assert check_plan({2048: 5}) == 3
    for _ in range(6):
        counts = collections.Counter(min(4096, int(draw.expovariate(1 / 600)) + 1) for _ in range(4000))
        total = sum(k * v for k, v in counts.items())
        assert check_plan(counts) <= -(-total // 4096) + 1


def test_packing(spark, documents):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = P.pack_documents(documents, TOKENIZER, capacity=512).collect()
    want = collections.Counter()
    for r in documents.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[r.doc_id, k // 512, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    room = []
    for r in sorted(rows, key=lambda r: -r.length):
        fits = [k for k, left in enumerate(room) if left >= r.length]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= r.length
        else:
            room.append(512 - r.length)
    assert len(places) <= len(room)
    assert P.pack_documents(empty(spark), TOKENIZER).count() == 0
