"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

Strings are sequences of symbols 1, 2, ...; each ends in a terminator of its own, which sorts before
every symbol and by the order of the strings. A transform holds, for all suffixes in order, the
symbol before each. Merging never sorts suffixes again: starting from the shards one after the
other, the interleave of their rows is refined one symbol at a time, as the suffixes that start with
a symbol come in the order in which that symbol stands in the interleaved transforms. A border that
appears in round h parts rows that share h - 1 symbols, so the rounds also give the common prefixes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Transform(NamedTuple):
    """``symbols``: the symbol before each suffix (0: the suffix is a whole string); ``string, start``: whose suffix it is."""

    symbols: np.ndarray
    string: np.ndarray
    start: np.ndarray


def transform(symbols: np.ndarray, lengths: np.ndarray) -> Transform:
    """Of one shard: strings of ``lengths`` laid end to end in ``symbols``; suffixes sorted by prefix doubling."""
    m, n = len(lengths), len(symbols) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(n, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    text[inside] = symbols
    rank = text + m
    rank[ends] = np.arange(m)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + int(rank.max()) + 2) + after if step == 1 else rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or step > n:
            break
        step *= 2
    string = np.repeat(np.arange(m), lengths + 1)
    start = np.arange(n) - np.repeat(ends - lengths, lengths + 1)
    before = np.where(start[order] > 0, text[order - 1], 0)
    return Transform(before, string[order], start[order])


class Merged(NamedTuple):
    """Suffixes of all shards in the order of their first ``depth`` symbols: ``shard, row`` in it, and ``shared``.

    ``shared`` is the number of symbols that a suffix has in common with the one before it, ``depth``
    standing for that many or more.
    """

    shard: np.ndarray
    row: np.ndarray
    shared: np.ndarray


def merge(shards: list[Transform], depth: int) -> Merged:
    """Refines the interleave of the shards' rows ``depth`` times, or until every row stands apart."""
    sizes = np.array([len(s.symbols) for s in shards])
    n = int(sizes.sum())
    symbols = np.concatenate([s.symbols for s in shards])
    small = int(symbols.max(initial=0)) < 1 << 16
    symbols = symbols.astype(np.uint16 if small else np.int32)
    label = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    terminators = np.repeat(np.arange(len(shards), dtype=np.uint16), [int((s.symbols == 0).sum()) for s in shards])
    m = len(terminators)
    rows = np.arange(n)
    shared = np.full(n, depth, dtype=np.int32)
    shared[:1] = 0
    border = np.zeros(n, dtype=bool)
    border[:1] = True
    for h in range(depth):
        now = symbols[rows]
        order = np.argsort(now, kind="stable")
        block = np.cumsum(border)[order]
        now = now[order]
        label = label[order]
        # The suffixes that are only a terminator keep the order of their strings.
        label[:m] = terminators
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (now[1:] != now[:-1]) | (block[1:] != block[:-1])
        fresh[:m] = True
        shared[fresh & ~border] = h
        border |= fresh
        rows = np.empty(n, dtype=np.int64)
        rows[np.argsort(label, kind="stable")] = np.arange(n)
        if border.all():
            break
    first = np.cumsum(sizes) - sizes
    return Merged(label, rows - first[label], shared)
