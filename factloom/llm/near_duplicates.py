"""Near-duplicate documents by a chosen-path set similarity join.

A document's set of word shingles gets ``COORDINATES`` minwise tokens. In each of ``TREES``
independent trees, documents are branched by the token at randomly chosen coordinates, one or two
per node, so that a pair of similarity s meets in a child with probability at least s. A node with at
most ``LEAF_PAIRS`` pairs to compare is a leaf and is compared exhaustively; a larger one is branched
again.

Links only matter where they join components, which keeps groups of copies from being written out in
all pairs. Documents with equal sets are one node from the start. First every node of the trees'
first level compares its members with one of them; the links found give components. Then only nodes
that still hold several components are branched on and compared, and only across components: by
sizes and sketches, and where these leave partners, by the sets (32 bits a shingle), of which each
leaf gives the links that join its components. Every link is confirmed on the full shingle sets.

A pair of similarity 0.75 meets in a leaf of one tree with probability 0.75 or more where leaves lie
at the first level, and 0.75 to the power of the level below. Sixteen trees with 22 roots miss it with
probability under 1e-12 at the first level and under 1e-5 at the second; deeper leaves need thousands
of unlinked documents that share tokens. Sketches of 128 bytes drop pairs whose estimated similarity
lies five deviations below the bound.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import by_bytes, mix, tidied, word_hashes
from factloom.llm.components import connected_components
from factloom.session import cut_lineage

SHINGLE, PERCENT = 5, 75
COORDINATES, TREES = 128, 16
#: A node with at most so many pairs across components is a leaf; sketches of a leaf are compared in one task.
LEAF_PAIRS = 8_000_000
#: Nodes that are larger still at this level are compared in blocks of ``BLOCK`` documents.
DEPTH, BLOCK = 10, 4096
#: Ids of documents to confirm are broadcast up to this count (16 bytes each), and joined by shuffle beyond it.
BROADCAST_IDS = 2_000_000
#: Five standard deviations of an estimate from 128 tokens at 0.75.
LEAST_ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / COORDINATES) ** 0.5

_draw = np.random.default_rng(20)
_XOR = _draw.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_ODD = _draw.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Coordinates at the roots: every third tree branches on two.
_ROOTS = np.split(np.arange(TREES + (TREES + 2) // 3), np.cumsum([2 if t % 3 == 0 else 1 for t in range(TREES)])[:-1])
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)

#: Leaves of at most so many rows are compared together, all rows some places apart at once.
SMALL_LEAF = 64


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; one for a text of fewer words, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = word_hashes(words)
    n = max(len(words) - size + 1, 1)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(min(len(words), size)))
        for k in range(min(size, len(words))):
            total += mix(hashes[k : k + n] ^ _TIMES[k % len(_TIMES)]) * _TIMES[(k + 1) % len(_TIMES)]
    found = mix(total)
    found.sort()
    new = np.ones(n, dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The ``COORDINATES`` minwise tokens of a set that is not empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, ((low[at : at + 1024] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=best)
    return best


def is_link(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers; empty sets never do."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def signatures(documents: DataFrame) -> DataFrame:
    """``doc_id, n, s1, s2, tokens, sketch`` per row; ``n, s1, s2`` tell sets apart (128 bits and the size)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_bytes(batches):
            n, s1, s2, tokens, sketch = [], [], [], [], []
            for text in batch["text"].tolist():
                found = shingle_set(text)
                n.append(len(found))
                with np.errstate(over="ignore"):
                    s1.append(int(found.sum(dtype=np.uint64).astype(np.int64)))
                    s2.append(int(mix(found ^ _TIMES[2]).sum(dtype=np.uint64).astype(np.int64)))
                best = minwise(found) if len(found) else None
                tokens.append(None if best is None else best.tobytes())
                sketch.append(None if best is None else (best & 255).astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "s1": s1, "s2": s2, "tokens": tokens, "sketch": sketch})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidied(sign), "doc_id long, n long, s1 long, s2 long, tokens binary, sketch binary")


def _token_matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, COORDINATES)


def _roots(nodes: DataFrame) -> DataFrame:
    """``key, node``: the children of every tree's root that a node falls into."""

    def branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = _token_matrix(batch["tokens"]).astype(np.uint64)
            for tree, coordinates in enumerate(_ROOTS):
                for c in coordinates:
                    yield pd.DataFrame({"key": mix(tokens[:, c] | np.uint64(tree * COORDINATES + c) << np.uint64(32)).view(np.int64), "node": batch["node"]})

    return nodes.select("node", "tokens").mapInPandas(tidied(branch), "key long, node long")


def _branches(members: DataFrame) -> DataFrame:
    """``key, node``: the children of ``members(key, node, tokens)``; a key draws its one or two coordinates."""

    def branch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = _token_matrix(batch["tokens"])
            key = batch["key"].to_numpy().view(np.uint64)
            drawn, rows = mix(key ^ _TIMES[3]), np.arange(len(key))
            for k in range(2):
                c = (drawn >> np.uint64(8 + 8 * k)) % np.uint64(COORDINATES)
                child = mix(mix(key ^ (c + np.uint64(1))) ^ tokens[rows, c.astype(np.int64)]).view(np.int64)
                took = (drawn % np.uint64(3) == 0) if k else np.ones(len(key), dtype=bool)
                yield pd.DataFrame({"key": child[took], "node": batch["node"].to_numpy()[took]})

    return members.select("key", "node", "tokens").mapInPandas(tidied(branch), "key long, node long")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b`` of the distinct pairs that sizes and sketches do not rule out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("sketch").alias("_sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("sketch").alias("_sb"))
    # A node with several sets gives several rows, one of which is enough.
    known = pairs.distinct().join(left, "a").join(right, "b")
    known = known.filter(100 * F.least("_na", "_nb") >= PERCENT * F.greatest("_na", "_nb")).select("a", "b", "_sa", "_sb")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, COORDINATES) for c in ("_sa", "_sb"))
            yield batch.loc[(x == y).mean(axis=1) >= LEAST_ESTIMATE, ["a", "b"]].drop_duplicates()

    return known.mapInPandas(tidied(keep), "a long, b long")


def _confirmed(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """``a, b`` of ``pairs`` (a written table) whose full sets are similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = F.broadcast(ids) if 2 * pairs.count() <= BROADCAST_IDS else ids
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    known = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb")), "b")
    known = known.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta")), "a")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str | None) -> np.ndarray:
            found = recent.pop(text, None)
            recent[text] = shingle_set(text) if found is None else found
            if len(recent) > 64:
                recent.popitem(last=False)
            return recent[text]

        for batch in batches:
            yield batch.loc[[is_link(of(x), of(y)) for x, y in zip(batch["_ta"], batch["_tb"])], ["a", "b"]]

    return known.select("a", "b", "_ta", "_tb").mapInPandas(tidied(confirm), "a long, b long")


def _first(node: str) -> Column:
    """An order of nodes that has nothing to do with their ids, to choose the one to compare with."""
    return F.struct(F.xxhash64(node), F.col(node))


def _centre_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: each member of a node of several with the one that comes first in it."""
    centre = members.groupBy("key").agg(F.min(_first("node")).alias("_c"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return members.join(centre, "key").filter("node <> _c.node").select(F.col("_c.node").alias("a"), F.col("node").alias("b"))


def _mixed(members: DataFrame) -> DataFrame:
    """``key, node, component, _m, _pairs`` of nodes that hold several components; ``_pairs`` lie across them."""
    size = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_c")).groupBy("key").agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    size = size.select("key", "_m", F.expr("(_m * _m - _q) DIV 2").alias("_pairs")).filter("_pairs > 0")
    return members.join(size, "key")


def _blocks(members: DataFrame) -> DataFrame:
    """Splits nodes of any size into pairs of blocks, each pair a node of its own."""
    count = F.ceil(F.col("_m") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    rows = members.select("key", "node", "component", own.alias("_own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_other"))
    return rows.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "node", "component")


def _equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places sketches, or equal halves of them, have the same byte."""
    found = (a == b).view(np.uint64)
    while found.shape[1] > 1:
        half = found.shape[1] // 2
        found = found[:, :half] + found[:, half:]
    return (found[:, 0] * np.uint64(0x0101010101010101)) >> np.uint64(56)


def likely_across(component: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per row outside the largest component, the rows of other components that sizes and sketches do not rule out.

    Rows that are both outside it come up once.
    """
    _, group, counts = np.unique(component, return_inverse=True, return_counts=True)
    outside = group != counts.argmax()
    most = counts.max()
    # Two sketches with enough equal places have at least so many in the first half.
    half, least = np.ascontiguousarray(sketch[:, : COORDINATES // 2]), LEAST_ESTIMATE * COORDINATES - COORDINATES // 2
    for i in np.flatnonzero(outside).tolist():
        ok = (group != group[i]) & (100 * np.minimum(n[i], n) >= PERCENT * np.maximum(n[i], n))
        if most < len(n):
            ok[:i] &= ~outside[:i]
        j = np.flatnonzero(ok)
        if len(j):
            j = j[_equal_places(half[j], half[i]) >= least]
            j = j[_equal_places(sketch[j], sketch[i]) >= LEAST_ESTIMATE * COORDINATES]
            if len(j):
                yield i, j


def likely_beside(key: np.ndarray, component: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs for many small leaves whose rows lie side by side, as two arrays of rows."""
    first, second = [], []
    for apart in range(1, SMALL_LEAF):
        beside = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(beside):
            break
        i, j = beside, beside + apart
        ok = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        ok = _equal_places(sketch[i], sketch[j]) >= LEAST_ESTIMATE * COORDINATES
        first.append(i[ok])
        second.append(j[ok])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(first or none), np.concatenate(second or none)


def _n_shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linking_pairs(component: np.ndarray, n: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that join the components of a leaf: one for each merge, no more."""
    label = np.unique(component, return_inverse=True)[1]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    own = np.zeros(len(ids), dtype=bool)
    out = []
    for i, j in likely_across(component, n, sketch):
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        mine = ids[ends[i] - sizes[i] : ends[i]]
        own[mine] = 1
        # Shingles of one set that are equal in 32 bits count as if they were shared.
        shared = np.minimum(n[i] - sizes[i], n[j] - sizes[j])
        for k, other in enumerate(j.tolist()):
            shared[k] += np.count_nonzero(own[ids[ends[other] - sizes[other] : ends[other]]])
        own[mine] = 0
        linked = j[100 * shared >= PERCENT * (n[i] + n[j] - shared)]
        for other in np.unique(label[linked]).tolist():
            out.append((i, int(linked[label[linked] == other][0])))
            label[label == other] = label[i]
    return out


def linking_beside(key: np.ndarray, component: np.ndarray, n: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """What :func:`linking_pairs` gives, for many small leaves whose rows lie side by side."""
    label = np.unique(np.stack([key, component]), axis=1, return_inverse=True)[1].reshape(-1)
    merged = list(range(int(label.max()) + 1))

    def of(row: int) -> int:
        at = label[row]
        while merged[at] != at:
            at = merged[at]
        return at

    out = []
    for i, j in zip(*(rows.tolist() for rows in likely_beside(key, component, n, sketch))):
        a, b = of(i), of(j)
        if a != b:
            shared = _n_shared(sets[i], sets[j]) + min(n[i] - len(sets[i]), n[j] - len(sets[j]))
            if 100 * shared >= PERCENT * (n[i] + n[j] - shared):
                merged[a] = b
                out.append((i, j))
    return out


def _whole_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows, sorted by key, in pieces that hold all rows of their keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        key = batch["key"].to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1]["key"].iloc[-1] != key[0]):
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _per_leaf(rows: DataFrame, schema: str, beside, work) -> DataFrame:
    """Applies ``work`` to the rows of each key, a task holding few keys at a time, and ``beside`` to those of all small leaves held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _whole_leaves(batches):
            key = piece["key"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(starts, append=len(key))
            small = np.repeat(sizes <= SMALL_LEAF, sizes)
            if small.any():
                yield beside(piece[small])
            for low, size in zip(starts[sizes > SMALL_LEAF].tolist(), sizes[sizes > SMALL_LEAF].tolist()):
                yield work(piece.iloc[low : low + size])

    return rows.repartition(F.col("key")).sortWithinPartitions("key").mapInPandas(tidied(run), schema)


def _sketches(leaf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(leaf["sketch"]), np.uint8).reshape(-1, COORDINATES)


def _columns(leaf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return leaf["component"].to_numpy(), leaf["n"].to_numpy(), _sketches(leaf)


def _promising(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, node, component`` of members of leaves that have a likely partner in another component."""
    rows = members.select("key", "node", "component").join(nodes.select("node", "n", "sketch"), "node")

    def chosen(leaf: pd.DataFrame, pairs) -> pd.DataFrame:
        found = np.zeros(len(leaf), dtype=bool)
        for i, j in pairs:
            found[i] = True
            found[j] = True
        return leaf.loc[found, ["key", "node", "component"]]

    def beside(leaves: pd.DataFrame) -> pd.DataFrame:
        return chosen(leaves, [likely_beside(leaves["key"].to_numpy(), *_columns(leaves))])

    def work(leaf: pd.DataFrame) -> pd.DataFrame:
        return chosen(leaf, likely_across(*_columns(leaf)))

    return _per_leaf(rows, "key long, node long, component long", beside, work)


def _linking(members: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """``a, b``: links that join components within leaves of ``members(key, node, component)`` (a written table)."""
    ids = members.select(F.col("node").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if members.count() <= BROADCAST_IDS else ids
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique((shingle_set(t) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"node": batch["doc_id"], "shingles": found})

    sets = texts.mapInPandas(tidied(shorten), "node long, shingles binary").distinct()
    rows = members.join(nodes.select("node", "n", "sketch"), "node").join(sets, "node")
    # A node of several sets has several texts: sizes tell which belong together.
    rows = rows.filter((F.length("shingles") / 4).between(0.99 * F.col("n") - 4, F.col("n")))

    def links(leaf: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
        node = leaf["node"].to_numpy()
        return pd.DataFrame([(int(node[i]), int(node[j])) for i, j in pairs], columns=["a", "b"], dtype="int64")

    def sets_of(leaf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint32) for x in leaf["shingles"]]

    def beside(leaves: pd.DataFrame) -> pd.DataFrame:
        return links(leaves, linking_beside(leaves["key"].to_numpy(), *_columns(leaves), sets_of(leaves)))

    def work(leaf: pd.DataFrame) -> pd.DataFrame:
        return links(leaf, linking_pairs(*_columns(leaf), sets_of(leaf)))

    return _per_leaf(rows, "a long, b long", beside, work)


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest id reached over links of at least 75 % similar shingle sets,
    ``kept`` whether that is the row's own. Null and empty texts link with nothing. Rows of one id
    are one document, linked by whichever of their texts; rows without an id have no component and
    are kept. Repeated rows give repeated results; an empty table gives none; other columns are not
    read. ``documents`` is read several times and must not change.
    """
    signed = cut_lineage(signatures(documents), "signatures")
    sets = ["n", "s1", "s2"]
    full = signed.filter("n > 0 AND doc_id IS NOT NULL")
    first = full.groupBy(*sets).agg(F.min_by(F.struct("doc_id", "tokens", "sketch"), "doc_id").alias("_f"))
    nodes = cut_lineage(first.select(*sets, F.col("_f.doc_id").alias("node"), "_f.tokens", "_f.sketch"), "nodes")
    classes = nodes.select(*sets, "node")

    # Rows of one id with different sets belong together.
    several = full.groupBy("doc_id").agg(F.min("s1").alias("_lo"), F.max("s1").alias("_hi")).filter("_lo <> _hi").select("doc_id")
    several = cut_lineage(several, "several")
    same_id = None
    if not several.isEmpty():
        same_id = full.join(several, "doc_id", "left_semi").join(classes, sets).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    members = _roots(nodes)
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    members = cut_lineage(members.join(crowded, "key", "left_semi"), "members")
    likely = cut_lineage(_likely(_centre_pairs(members), nodes), "pairs")
    links = _confirmed(likely, documents)
    links = links if same_id is None else links.unionByName(same_id)
    found = cut_lineage(connected_components(links), "components")

    promising = None
    now = cut_lineage(_mixed(_with_components(members, found)), "mixed")
    for level in range(2, DEPTH + 1):
        if now.isEmpty():
            break
        large = now.filter(F.col("_pairs") > LEAF_PAIRS)
        deeper = level < DEPTH and not large.isEmpty()
        leaves = now.filter(F.col("_pairs") <= LEAF_PAIRS)
        if not deeper:
            leaves = leaves.select("key", "node", "component").unionByName(_blocks(large))
        here = _promising(leaves, nodes)
        promising = here if promising is None else promising.unionByName(here)
        if not deeper:
            break
        children = _branches(large.join(nodes.select("node", "tokens"), "node")).distinct()
        now = cut_lineage(_mixed(_with_components(children, found)), "mixed")
    everywhere = _with_components(classes, found)
    more = None
    if promising is not None:
        promising = cut_lineage(promising, "promising")
        linking = cut_lineage(_linking(promising, nodes, documents).distinct(), "pairs")
        more = cut_lineage(_confirmed(linking, documents), "more")
    if more is not None and not more.isEmpty():
        ends = _with_components(more.select(F.col("a").alias("node"), "b"), found).select(F.col("component").alias("a"), F.col("b").alias("node"))
        ends = _with_components(ends, found).select("a", F.col("component").alias("b"))
        merged = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("_wide"))
        everywhere = everywhere.join(merged, "component", "left").withColumn("component", F.coalesce("_wide", "component"))
    everywhere = everywhere.select(*sets, "component")

    rows = signed.select("doc_id", *sets).join(everywhere, sets, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
