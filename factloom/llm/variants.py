"""Spelling variants: words that differ by one inserted, deleted or replaced character, by dense tiling.

Two words are near exactly when the lengths of their common prefix and common suffix add up to the
length of the longer one, L, less one at least. One of the two then has L // 2 characters or more, so
near words share a block: the same L and the same first L // 2 characters, or the same last ones. A
word belongs to the blocks of its own length and of the next one, and a pair counts in its prefix
block, or in its suffix block if its prefix is too short.

Within a block, words are rows of a padded matrix of code points (one byte each, as no word has a
character over U+00FF). Tiles of rows are compared with tiles of rows, all pairs of a tile at once,
column by column: the prefix runs on from the shared part, and so does the suffix from the other end.
A block of more than ``TILE`` words is dealt into tiles and every pair of tiles is a task's work of
its own. Tiles return a row for each word that has near words, their number and the best of them,
never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import per_key
from factloom.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a tile; a task compares two tiles at a time.
TILE = 1024
#: Of the words' checksums one in so many plants a misspelling.
PLANTED = 199
#: Words that a task counts before it hands them on.
_HELD = 1 << 17

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8 after lower-casing A-Z.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def damaged(doc_id: str, text: str | None) -> Counter[bytes]:
    """Words of a text with planted misspellings: by checksum of ``<doc_id>:<word>`` one character is left out."""
    found: Counter[bytes] = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(_RUN.findall((text or "").encode("utf-8", "replace").lower())).items():
        h = zlib.crc32(word, start)
        if h % PLANTED == 0:
            letters = word.decode()
            at = h % len(letters)
            word = (letters[:at] + letters[at + 1 :]).encode()
        found[word] += n
    return found


def words(documents: DataFrame) -> DataFrame:
    """``word, n`` of the words of at least ``LEAST_LENGTH`` characters and ``LEAST_COUNT`` occurrences.

    Tasks count what they read and hand counts on, so a frequent word is a row for each task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())})

        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                for word, n in damaged(doc, text).items():
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) >= _HELD:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counted = documents.select(doc.alias("doc"), "text").mapInPandas(count, "word string, n long")
    return counted.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _matrix(words_: list[str], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words_), np.uint8).reshape(len(words_), width)


def _run_length(a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """How many leading columns all pairs of rows have in common, of which ``known`` are sure."""
    alive = np.ones((len(a), len(b)), dtype=bool)
    length = np.full((len(a), len(b)), known, dtype=np.uint16)
    for k in range(known, a.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        length += alive
    return length


def near_in_tiles(first: list[str], second: list[str], longer: int, suffix: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both lists of near pairs whose longer word has ``longer`` characters, pieces of the first at a time.

    All words share their first ``longer // 2`` characters, or (``suffix``) the last; pairs of a
    suffix block that share as many at the front are left to their prefix block.
    """
    shared = longer // 2
    ahead = [_matrix(w, longer) for w in (first, second)]
    back = [_matrix([x[::-1] for x in w], longer) for w in (first, second)]
    full = [np.array([len(x) == longer for x in w]) for w in (first, second)]
    step = max((1 << 18) // max(len(second), 1), 1)
    for low in range(0, len(first), step):
        rows = slice(low, low + step)
        front = _run_length(ahead[0][rows], ahead[1], 0 if suffix else shared)
        rear = _run_length(back[0][rows], back[1], shared if suffix else 0)
        near = front + rear >= longer - 1
        near &= full[0][rows, None] | full[1][None, :]
        if suffix:
            near &= front < shared
        i, j = np.nonzero(near)
        yield i + low, j


def _tile(word: np.ndarray, n: np.ndarray, longer: np.ndarray, suffix: np.ndarray, part: np.ndarray) -> list[tuple]:
    """``word, n_near, best, best_n`` of a pair of tiles (parts 0 and 1) or of a tile with itself (part 2)."""
    if len(word) < 2:
        return []
    own = part[0] == 2
    first = np.flatnonzero(part != 1)
    second = first if own else np.flatnonzero(part == 1)
    lists = [[word[k] for k in places] for places in (first, second)]
    count: Counter[int] = Counter()
    best: dict[int, tuple[int, str]] = {}
    for i, j in near_in_tiles(*lists, int(longer[0]), bool(suffix[0])):
        for a, b in zip(first[i].tolist(), second[j].tolist()):
            # In a tile with itself a pair comes up from both sides, and a word with itself is no pair.
            if a == b:
                continue
            for x, y in ((a, b),) if own else ((a, b), (b, a)):
                count[x] += 1
                found = (-int(n[y]), word[y])
                if x not in best or found < best[x]:
                    best[x] = found
    return [(word[k], total, best[k][1], -best[k][0]) for k, total in count.items()]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of the words of ``vocabulary(word, n)`` that have near words.

    ``best`` is the near word of largest ``n``, of several the first in code-point order.
    """
    length = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer"))
    half = F.floor(F.col("longer") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(False).alias("suffix"), F.substring("word", F.lit(1), half).alias("affix")),
        F.struct(F.lit(True).alias("suffix"), F.substring("word", -half, half).alias("affix")),
    )
    block = ["longer", "suffix", "affix"]
    rows = rows.select("word", "n", "longer", F.inline(sides))
    large = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TILE)
    large = cut_lineage(large.select(*block, F.ceil(F.col("_n") / TILE).cast("int").alias("_tiles")), "blocks")
    rows = rows.join(large, block, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("word"), F.col("_tiles")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("_tiles") - 1),
        lambda k: F.struct(F.least(k, tile).alias("_a"), F.greatest(k, tile).alias("_b"), F.when(k == tile, 2).when(tile < k, 0).otherwise(1).alias("part")),
    )
    rows = rows.select("word", "n", *block, F.inline(others)).withColumn("node", F.xxhash64(*block, "_a", "_b"))
    tiles = per_key(rows, "node", _tile_of_blocks, ["word", "n", "longer", "suffix", "affix", "part"], "word string, n_near long, best string, best_n long")
    return tiles.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), "best")).alias("_b")).select("word", "n_near", "_b.best", "_b.best_n")


def _tile_of_blocks(word, n, longer, suffix, affix, part) -> list[tuple]:
    """Blocks whose 64-bit keys are equal by chance are told apart again."""
    if len(word) < 2:
        return []
    blocks = pd.Series(list(zip(longer.tolist(), suffix.tolist(), affix, (part == 2).tolist())))
    if blocks.nunique() == 1:
        return _tile(word, n, longer, suffix, part)
    return [x for _, at in blocks.groupby(blocks).indices.items() for x in _tile(word[at], n[at], longer[at], suffix[at], part[at])]


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chains of ``forms(word, form)`` end, by doubling the steps taken.

    A form is at least ``RATIO`` times as frequent as its word, so chains are short and never closed.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        now = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return now


def variants(documents: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``documents(doc_id, text)``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, after planting
    misspellings by :func:`damaged`. A word's ``form`` is its most frequent near word if that is
    ``RATIO`` times as frequent at least, ``root`` the end of the chain of forms. Null texts have no
    words; a null id counts as an empty one in the checksum; rows that share an id or are repeated
    all count. Texts and words of any length are read whole. Tables without words give no rows; other
    columns are not read.
    """
    vocabulary = cut_lineage(words(documents), "words")
    near = cut_lineage(near_words(vocabulary), "near")
    known = vocabulary.join(near, "word", "left")
    known = cut_lineage(known.withColumn("_is", F.coalesce(F.col("best_n") >= RATIO * F.col("n"), F.lit(False))), "known")
    ends = roots(known.filter("_is").select("word", F.col("best").alias("form")))
    return known.join(ends, "word", "left").select(
        "word", F.when(F.col("_is"), F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("best_n")).alias("form_n"),
    )
