"""Shared by the operators of this subpackage: tables, the learning split, stable hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

HELD_OUT_REMAINDER = 2
WORD_CACHE = 1 << 19

_LETTER = re.compile(r"[^\W\d_]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from learning; one without an id always is."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(True))


def has_letter(text: str | None) -> bool:
    return text is not None and any(found[0].isalpha() for found in _LETTER.finditer(text))


@F.pandas_udf(BooleanType())
def letters(texts: pd.Series) -> pd.Series:
    """:func:`has_letter` as a column."""
    return texts.map(has_letter, na_action=None).astype(bool)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Hashing anew takes less time than looking a word up, and no memory."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(32))
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        return values


def tidy() -> None:
    """Gives memory that a task has freed back to the system, as workers outlive tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(task: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``task`` with :func:`tidy` at its end."""

    @functools.wraps(task)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from task(batches)
        finally:
            tidy()

    return run


#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
BATCH_BYTES = 1 << 22


def by_bytes(batches: Iterator[pd.DataFrame], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """The same rows in pieces of at most ``most`` characters of ``column``, one row at least."""
    for batch in batches:
        ends = np.cumsum(batch[column].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(dtype=np.int64))
        low = 0
        while low < len(batch):
            before = ends[low - 1] if low else 0
            high = max(int(np.searchsorted(ends, before + most, side="right")), low + 1)
            yield batch if low == 0 and high == len(batch) else batch.iloc[low:high].reset_index(drop=True)
            low = high


def hash_sample(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``rows(doc_id, ...)``, an even sample by the hash of the id.

    A first filter on the hash keeps about three times the limit, however large the table, before
    the exact cut; ties of the hash go by id.
    """
    n = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if n > 3 * limit:
        rows = rows.filter(place < int((1 << 30) * 3 * limit / n))
    return rows.orderBy(place, "doc_id", *[c for c in rows.columns if c != "doc_id"]).limit(limit)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``text, label`` of at most ``limit`` documents to learn from: not held out, with a text and a label 0 or 1.

    A document with several label rows counts once for each, documents that share an id once each.
    The bound holds for label rows before the join with the texts and again, by a hash of id and text,
    for the rows after it, so that neither repeated labels nor repeated ids can exceed it.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    picked = hash_sample(known, limit)
    rows = documents.filter(~held_out() & F.col("text").isNotNull()).select("doc_id", "text")
    rows = rows.join(F.broadcast(picked), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "label").limit(limit).select("text", "label")


def per_key(rows: DataFrame, key: str, work: Callable[..., list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """The rows that ``work`` makes of ``columns`` (arrays) of each key; a task holds one key's rows at a time.

    ``key`` is an integer column without nulls; keys are to be bounded by the caller.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, found = None, None, []
        for batch in batches:
            keys, values = batch[key].to_numpy(), [batch[c].to_numpy() for c in columns]
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if held is not None and now != keys[low]:
                    found += work(*(np.concatenate(v) for v in held))
                    held = None
                now, held = keys[low], held or [[] for _ in columns]
                for kept, column in zip(held, values):
                    kept.append(column[low:high])
            if found:
                yield pd.DataFrame(found, columns=names)
                found = []
        if held is not None:
            found = work(*(np.concatenate(v) for v in held))
            if found:
                yield pd.DataFrame(found, columns=names)

    return rows.repartition(F.col(key)).sortWithinPartitions(key).select(key, *columns).mapInPandas(run, schema)
