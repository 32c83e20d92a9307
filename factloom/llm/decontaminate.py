"""Benchmark passages in documents by a prefix-filtered set join. DataFrame functions only.

An item's windows are runs of consecutive words; a window's tokens are its shingles of a few words.
Shingles are ordered by how often they stand in the documents. As a window must be contained whole,
the filter prefix is its rarest shingle: a document without it cannot hold the window, and windows
with a shingle that no document has are dropped before the join. Documents meet windows on that
shingle; the shingle's place in the window bounds where the window would start and end, and the
words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
SHINGLE = 4
#: The windows of a benchmark are broadcast up to this count (some 200 bytes each), and shuffled beyond it.
BROADCAST_WINDOWS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words of a text, with only A-Z lower-cased; none for null."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BETWEEN_WORDS), "")


def _key(words: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from 0-based ``at`` on."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def _places(words: Column, size: int, first: int = 0) -> Column:
    """0-based starts of the shingles of ``size`` words, after the extra start ``first`` = -1 if asked for."""
    n = F.size(words)
    return F.when(n >= size, F.sequence(F.lit(first), n - size)).otherwise(F.array(F.lit(-1)) if first < 0 else F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, words, shingle``: the windows of ``items(item_id, text)``, each once per item.

    An item with fewer words than a window is one window; without words, or without an id, it has
    none. ``shingle`` is the number of words of the window's shingles.
    """
    rows = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("_all"))
    rows = rows.filter(F.size("_all") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_all") - window + 1, F.lit(1))))
    rows = rows.select("item_id", "_all", start.alias("_start"))
    rows = rows.select("item_id", F.slice("_all", F.col("_start"), window).alias("words")).distinct()
    return rows.withColumn("shingle", F.least(F.size("words"), F.lit(SHINGLE)))


def _sizes(windows: DataFrame) -> list[int]:
    return sorted(r[0] for r in windows.select("shingle").distinct().collect())


def _shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The windows with each of their shingles: ``item_id, words, shingle, at, key``."""
    parts = []
    for size in sizes:
        rows = windows.filter(F.col("shingle") == size).select("*", F.explode(_places(F.col("words"), size)).alias("at"))
        parts.append(rows.withColumn("key", _key(F.col("words"), F.col("at"), size)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("_text_hash"), words_of("text").alias("_words"))


def rarest_shingles(documents: DataFrame, windows: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """``item_id, words, key, at``: per window its rarest shingle; windows that cannot occur are left out."""
    shingles = _shingles(windows, sizes)
    keys = shingles.select("key").distinct()
    keys = F.broadcast(keys) if small else keys
    seen = None
    for size in sizes:
        found = _rows(documents).select("_words", F.explode(_places(F.col("_words"), size)).alias("_at"))
        found = found.select(_key(F.col("_words"), F.col("_at"), size).alias("key")).join(keys, "key", "left_semi")
        seen = found if seen is None else seen.unionByName(found)
    counts = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = shingles.join(counts, "key", "left").groupBy("item_id", "words", "shingle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at")).alias("_first")
    )
    return ranked.filter("_first.n > 0").select("item_id", "words", "shingle", "_first.key", "_first.at")


def _matches(documents: DataFrame, prefixes: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """``doc_id, _text_hash, n_words, start, end, item_id``: every occurrence, and one row without item per document."""
    out = None
    for k, size in enumerate(sizes):
        here = prefixes.filter(F.col("shingle") == size)
        rows = _rows(documents)
        if small:
            rows = rows.select("*", F.explode(_places(F.col("_words"), size, -1 if k == 0 else 0)).alias("_at"))
            rows = rows.withColumn("key", F.when(F.col("_at") >= 0, _key(F.col("_words"), F.col("_at"), size)))
            joined = rows.join(F.broadcast(here), "key", "left")
            around, base = F.col("_words"), F.lit(0)
        else:
            heads = rows.select("doc_id", "_text_hash", F.size("_words").alias("n_words"), *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("item_id", "string"))])
            if k == 0:
                out = heads
            tokens = rows.select("doc_id", "_text_hash", "_words", F.explode(_places(F.col("_words"), size)).alias("_at"))
            first = F.greatest(F.col("_at") - WINDOW, F.lit(0))
            tokens = tokens.select(
                "doc_id", "_text_hash", F.size("_words").alias("_n"), "_at", _key(F.col("_words"), F.col("_at"), size).alias("key"),
                first.alias("_base"), F.slice("_words", first + 1, 2 * WINDOW + SHINGLE).alias("_words"),
            )
            joined = tokens.join(here, "key")
            around, base = F.col("_words"), F.col("_base")
        start = F.col("_at") - F.col("at")
        n_words = F.size("_words") if small else F.col("_n")
        fits = (start >= 0) & (start + F.size("words") <= n_words)
        same = F.when(fits, F.slice(around, start - base + 1, F.size("words")) == F.col("words"))
        hit = F.coalesce(F.col("words").isNotNull() & same, F.lit(False))
        kept = joined.filter((hit | (F.col("_at") < 0)) if small else hit)
        part = kept.select(
            "doc_id", "_text_hash", n_words.alias("n_words"), F.when(F.col("_at") >= 0, start).alias("start"),
            F.when(F.col("_at") >= 0, start + F.size("words")).alias("end"), "item_id",
        )
        out = part if out is None else out.unionByName(part)
    return out


def find_items(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated`` per row of ``documents(doc_id, text)``.

    A word is hit if it stands in an occurrence of a window of an item; ``item_ids`` are strings in
    order. Null texts have no words. Rows are told apart by id and text, and rows that repeat give
    as many results; empty tables are fine on either side; other columns are not read. What one
    document has found is gathered in one row, bounded by its own length.
    """
    windows = item_windows(items, window)
    n_windows, sizes = windows.count(), _sizes(windows)
    if not n_windows:
        none = F.lit(0).cast("long")
        return _rows(documents).select("doc_id", F.col("_text_hash").alias("text_hash"), F.size("_words").cast("long").alias("n_words"), none.alias("n_hit"), none.alias("n_items"),
                                       F.array().cast("array<string>").alias("item_ids"), F.lit(False).alias("contaminated"))
    small = n_windows <= BROADCAST_WINDOWS
    prefixes = rarest_shingles(documents, windows, sizes, small)
    matches = _matches(documents, prefixes, sizes, small)
    per_row = matches.groupBy("doc_id", "_text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("item_id").isNull()).cast("int").alias("_copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("_spans"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach"))
    covered = F.aggregate("_spans", zero, lambda a, s: F.struct(
        (a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["reach"]), F.lit(0))).alias("hit"), F.greatest(a["reach"], s["end"]).alias("reach")))
    return per_row.select(
        "doc_id", F.col("_text_hash").alias("text_hash"), "n_words", covered["hit"].alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        (F.size("item_ids") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
