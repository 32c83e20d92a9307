"""Near-duplicate documents by SimHash fingerprints: a grid over segment bit counts.

A fingerprint of 64 bits is embedded as the counts of set bits of its 32 segments of two bits. The
Manhattan distance of two such points never exceeds the Hamming distance of the fingerprints, so
what links at ``MOST_BITS`` = 4 lies within Manhattan distance 4. The segments form three blocks; if
the distances of the blocks were 2, 2 and 1 or more, they would add up to 5, so a pair within 4 lies
within 1 in the first block, or within 1 in the second, or has the third in common. Each block is a
grid of its own whose cells are count vectors: a point is at home in its cell, and in a block of
radius 1 it visits every cell one step up, so that two points one step apart meet exactly where the
lower one is at home. Whoever meets is verified on the fingerprints. With ``levels`` = 2 a cell is cut
again by a grid over the other two blocks, for tables so large that cells of one level are crowded.

Links only matter where they join components. A cell gives at most one link for each merge, never all
pairs. Cells of more than ``CROWD`` points are first linked with one of their points; where several
components remain, blocks of the points outside the largest are compared with blocks of all others,
so no task holds more than a block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import per_key
from factloom.llm.components import connected_components
from factloom.session import cut_lineage

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Segments of two bits by block, and how far a block's neighbours are looked up.
BLOCKS, RADII = ((0, 11), (11, 22), (22, 32)), (1, 1, 0)
#: Cells with more points are compared in blocks of so many.
CROWD = 4096
#: Beyond so many different fingerprints cells are cut a second time.
SECOND_LEVEL = 50_000_000
PAIR = "a long, b long"
#: Shingles of a document that are held at a time.
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of all shingles of ``size`` words, repeats included; zero without words.

    A-Z are lower-cased, words end at ASCII white space; fewer words than ``size`` are one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - size + 1, 1)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    of, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for low in range(0, n, _CHUNK):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(first[low : low + _CHUNK], last[low : low + _CHUNK])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, print`` (the fingerprint as a signed long) per row of ``documents(doc_id, text)``."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch["text"].tolist()], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc": batch["doc"], "print": prints})

    # Ids travel as text, which keeps nulls and all digits.
    rows = documents.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInPandas(sign, "doc string, print long")
    return rows.select(F.col("doc").cast("long").alias("doc_id"), "print")


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """The embedding: set bits of each of the 32 segments of two bits."""
    pairs = prints.astype(np.uint64)[:, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)
    return (pairs & np.uint64(1)).astype(np.int8) + (pairs >> np.uint64(1)).astype(np.int8)


def _cells(counts: np.ndarray, segments: list[int], radius: int, name: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``rows, key, visits``: the cell at home, then with a radius the cells one step up."""
    place = np.uint64(4) ** np.arange(len(segments), dtype=np.uint64)
    home = (counts[:, segments].astype(np.uint64) * place).sum(axis=1, dtype=np.uint64) | np.uint64(name) << np.uint64(60)
    yield np.arange(len(counts)), home, False
    for k in range(len(segments) if radius else 0):
        rows = np.flatnonzero(counts[:, segments[k]] < 2)
        yield rows, home[rows] + place[k], True


def cells(prints: np.ndarray, levels: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``rows, cell, visits`` of the grid: points are at home where ``visits`` is 0; a bit is set for each level they visit at.

    Two points are to be compared in a cell if no level has both as visitors.
    """
    counts = segment_counts(prints)
    for b, (block, radius) in enumerate(zip(BLOCKS, RADII)):
        for rows, key, visits in _cells(counts, [*range(*block)], radius, b + 1):
            if levels == 1:
                yield rows, key.view(np.int64), int(visits)
                continue
            rest = [s for s in range(32) if not block[0] <= s < block[1]]
            third = -(-len(rest) // 3)
            for c, inner_radius in enumerate(RADII):
                for inner, inner_key, inner_visits in _cells(counts[rows], rest[c * third : (c + 1) * third], inner_radius, c + 1):
                    with np.errstate(over="ignore"):
                        both = (key[inner] * np.uint64(0x9E3779B97F4A7C15)) ^ inner_key
                        both *= np.uint64(0xC2B2AE3D27D4EB4F)
                    yield rows[inner], both.view(np.int64), int(visits) | 2 * int(inner_visits)


def _members(nodes: DataFrame, levels: int) -> DataFrame:
    """``cell, print, visits`` for all cells that a fingerprint is in."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch["print"].to_numpy()
            for rows, cell, visits in cells(prints.view(np.uint64), levels):
                yield pd.DataFrame({"cell": cell, "print": prints[rows], "visits": np.int8(visits)})

    return nodes.select("print").mapInPandas(place, "cell long, print long, visits byte")


def cell_links(prints: np.ndarray, visits: np.ndarray, label: np.ndarray, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs of a cell within ``MOST_BITS`` bits that join different labels: one for each merge, no more.

    With ``first`` only the first so many points are compared with the rest. ``label`` is used up.
    """
    out = []
    if len(prints) < 2 or not (visits == 0).any() and not (visits > 1).any():
        return out
    rows = np.arange(len(prints) if first is None else first)
    if visits.max(initial=0) <= 1:
        rows = rows[visits[rows] == 0] if first is None else rows
    step = max((1 << 18) // len(prints), 1)
    for low in range(0, len(rows), step):
        some = rows[low : low + step]
        near = np.bitwise_count(prints[some, None] ^ prints[None, :]) <= MOST_BITS
        near &= (visits[some, None] & visits[None, :]) == 0
        near &= label[some, None] != label[None, :]
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            i = int(some[r])
            j = np.flatnonzero(near[r])
            j = j[label[j] != label[i]]
            for k in j[np.unique(label[j], return_index=True)[1]].tolist():
                out.append((i, k))
                label[label == label[k]] = label[i]
    return out


def _link_cell(prints: np.ndarray, visits: np.ndarray) -> list[tuple[int, int]]:
    found = cell_links(prints.view(np.uint64), visits, np.arange(len(prints)))
    return [(int(prints[i]), int(prints[j])) for i, j in found]


def _link_blocks(prints: np.ndarray, visits: np.ndarray, component: np.ndarray, outside: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(~outside, kind="stable")
    prints, visits, label = prints[order], visits[order], np.unique(component[order], return_inverse=True)[1]
    found = cell_links(prints.view(np.uint64), visits, label, int(outside.sum()))
    return [(int(prints[i]), int(prints[j])) for i, j in found]


def _crowded_links(members: DataFrame, found: DataFrame) -> DataFrame:
    """``a, b``: links across components within the crowded cells ``members(cell, print, visits)``.

    The largest component of a cell is left alone with itself: blocks of the points outside it meet
    blocks of all.
    """
    known = members.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    known = cut_lineage(known, "crowded")
    size = known.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("_n"))
    size = size.groupBy("cell").agg(F.max_by("component", F.struct("_n", "component")).alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")).filter("_most < _all")
    rows = known.join(size, "cell")
    outside = F.col("component") != F.col("_main")
    here, there = F.ceil((F.col("_all") - F.col("_most")) / CROWD).cast("int"), F.ceil(F.col("_all") / CROWD).cast("int")
    spread = F.xxhash64("print")
    # As one compared a point belongs to one block of those outside, as one to compare with to a block of all.
    left = rows.filter(outside).select("*", F.lit(True).alias("outside"), F.pmod(spread, here).alias("_p"), F.explode(F.sequence(F.lit(0), there - 1)).alias("_q"))
    right = rows.select("*", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), here - 1)).alias("_p"), F.pmod(spread, there).alias("_q"))
    nodes = left.select("cell", "_p", "_q", "print", "visits", "component", "outside").unionByName(right.select("cell", "_p", "_q", "print", "visits", "component", "outside"))
    return per_key(nodes.withColumn("node", F.xxhash64("cell", "_p", "_q")), "node", _link_blocks, ["print", "visits", "component", "outside"], PAIR)


def link_components(nodes: DataFrame, levels: int = 1) -> DataFrame:
    """``node, component`` of the fingerprints ``nodes(print)`` (a written table without repeats) that link with another."""
    members = _members(nodes, levels)
    crowd = members.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.min_by("print", F.struct("visits", F.xxhash64("print"))).alias("_centre")).filter(F.col("_n") > CROWD)
    crowd = cut_lineage(crowd.select("cell", "_centre"), "crowd")
    if crowd.isEmpty():
        return connected_components(cut_lineage(per_key(members, "cell", _link_cell, ["print", "visits"], PAIR).distinct(), "links"))
    links = per_key(members.join(crowd, "cell", "left_anti"), "cell", _link_cell, ["print", "visits"], PAIR)
    full = cut_lineage(members.join(crowd, "cell"), "full")
    near = (F.bit_count(F.col("print").bitwiseXOR(F.col("_centre"))) <= MOST_BITS) & (F.col("print") != F.col("_centre"))
    links = links.unionByName(full.filter(near).select(F.col("print").alias("a"), F.col("_centre").alias("b"))).distinct()
    found = cut_lineage(connected_components(cut_lineage(links, "links")), "components")
    more = cut_lineage(_crowded_links(full.select("cell", "print", "visits"), found).distinct(), "links")
    if more.isEmpty():
        return found
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(stars.unionByName(more))


def simhash_groups(documents: DataFrame, levels: int | None = None) -> DataFrame:
    """``doc_id, print, component_id`` per row of ``documents(doc_id, text)``.

    ``component_id`` is the smallest id reached over links of at most ``MOST_BITS`` differing bits.
    Texts that are null, empty or without words have the fingerprint zero and link like any other.
    Rows of one fingerprint are one node, whatever their ids; rows that share an id but not the
    fingerprint are linked only by their bits. A row without an id links others and gets the smallest
    id that it reaches, null if there is none. Repeated rows give repeated results, an empty table
    gives none; long texts are read whole; other columns are not read.
    """
    signed = cut_lineage(fingerprints(documents), "prints")
    nodes = cut_lineage(signed.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    if levels is None:
        levels = 1 if nodes.count() <= SECOND_LEVEL else 2
    found = link_components(nodes, levels)
    known = nodes.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(least, "component").select("print", "component_id")
    return signed.join(named, "print").select("doc_id", "print", "component_id")
