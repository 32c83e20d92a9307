"""Packing tokenized documents into sequences by exact-complement hashing and best fit.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the driver; the plan made
there is a list of patterns, each used some number of times: which lengths go together in a
sequence. Every pattern uses up at least one length, so a plan has at most ``capacity`` patterns.
Pieces are then numbered within their length, in parallel, and look up their place.

The longest length left opens a sequence. Its gap is filled exactly by one length, a pair or a
triple from the index of sums that are available; otherwise the longest length that fits goes in
(best fit) and the rest of the gap is tried again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import number_rows
from factloom.llm.common import tidied
from factloom.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Chunks remembered within a task, twice at most; forgotten at its end, as workers outlive tasks.
CHUNK_CACHE = 3 << 16

_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"
#: Chunks of Latin letters, digits and ASCII signs, and the token groups in them once they are in lower case.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-/:-@\[-`{-~]*")
_GROUPS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Steps of a tokenizers file under which ``_GROUPS`` are words of its model.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _byte_signs() -> dict[int, str]:
    """How byte-level models spell Latin letters that are not ASCII: a sign for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in set(own)]
    signs = {b: chr(b) for b in own} | {b: chr(0x100 + n) for n, b in enumerate(others)}
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)}


_BYTE_SIGNS = _byte_signs()


def _has_known_steps(tokenizer) -> bool:
    """Whether a file's steps are those known here, so that groups can go to its model one by one."""
    steps = json.loads(tokenizer.to_str())
    return (
        (steps["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        and (steps["pre_tokenizer"] or {}).get("pretokenizers") == _PRE_TOKENIZERS
        and steps["post_processor"] is None and steps["truncation"] is None and steps["padding"] is None
        and all("<|" in token["content"] for token in steps["added_tokens"])
    )


class _Ids(dict):
    """Ids (little-endian, 4 bytes each) of a chunk between blanks; the last ``CHUNK_CACHE`` and those used since are kept.

    Tokens never reach over white space, so a text's ids are those of its chunks in order. Where the
    tokenizer's steps are known, a plain chunk is split into its groups here and new groups go
    straight to the model: most of a new word's time is spent in the steps before it.
    """

    def __init__(self, tokenizer):
        self.encode, self.older = tokenizer.encode, {}
        self.model = tokenizer.model if _has_known_steps(tokenizer) else None

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def _of_model(self, group: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(group if group.isascii() else group.translate(_BYTE_SIGNS))]).tobytes()

    def _new(self, chunk: str) -> bytes:
        if self.model is not None:
            letters = chunk.rstrip(_SIGNS)
            if letters.isalpha() and (letters.isascii() or max(letters) <= "ÿ"):
                low = letters.lower()
                if len(low) < len(chunk):
                    return self[low] + self[chunk[len(low) :]]
                return self._of_model(chunk) if low == chunk else self[low]
            if "<|" not in chunk and _PLAIN.fullmatch(chunk):
                groups = _GROUPS.findall(chunk.lower())
                return self._of_model(chunk) if groups == [chunk] else b"".join(map(self.__getitem__, groups))
        return array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self._new(chunk)
        if len(self) >= CHUNK_CACHE:
            self.older = self.copy()
            self.clear()
        self[chunk] = found
        return found


_TOKENIZERS: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = _Ids(Tokenizer.from_file(path))
    return _TOKENIZERS[path]


def text_ids(text: str, path: str) -> bytes:
    """The ids of one text without the end id."""
    if not text:
        return b""
    return b"".join(map(_ids(path).__getitem__, text.replace("\n", " ").split(" ")))


def tokenize(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents cut into pieces of at most ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizers file that every executor has. Null text counts as empty.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pieces_of(batch)
        _ids(tokenizer).forget()

    def pieces_of(batch: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            ids = text_ids(text, tokenizer) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(value)
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in out[0]], dtype="Int64"),
            "piece": np.array(out[1], dtype=np.int32), "start": np.array(out[2], dtype=np.int64),
            "length": np.array(out[3], dtype=np.int64), "ids_crc32": np.array(out[4], dtype=np.int64),
        })

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInPandas(tidied(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Slot(NamedTuple):
    """``copies`` pieces of ``length`` in each of ``times`` sequences from ``sequence`` on; ``rank``: the first piece used."""

    length: int
    rank: int
    copies: int
    times: int
    sequence: int
    offset: int


class _Lengths:
    """How many pieces of each length are left, with an index of the sums of two lengths."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.have = self.left > 0
        self.have[0] = False
        self.pairs = np.zeros(2 * capacity + 1, dtype=np.int64)
        for length in np.flatnonzero(self.have):
            self.pairs[length : length + capacity + 1] += self.have
        self.pairs[0::2] -= self.have & (self.left < 2)

    def take(self, length: int, count: int) -> None:
        before, now = int(self.left[length]), int(self.left[length]) - count
        self.left[length] = now
        if now < 2 <= before:
            self.pairs[2 * length] -= 1
        if now == 0:
            others = self.have.copy()
            others[length] = False
            self.pairs[length : length + len(others)] -= 2 * others
            self.have[length] = False

    def longest(self, most: int) -> int:
        """The longest length left, of at most ``most``; 0 if there is none."""
        found = np.flatnonzero(self.have[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def _enough(self, used: Mapping[int, int], parts: tuple[int, ...]) -> bool:
        return all(self.left[p] - used.get(p, 0) >= parts.count(p) for p in parts)

    def exact(self, gap: int, used: Mapping[int, int]) -> tuple[int, ...]:
        """One, two or three lengths that sum to ``gap`` and are available beside ``used``; longest first."""
        if self.have[gap] and self._enough(used, (gap,)):
            return (gap,)
        if self.pairs[gap] > 0:
            first = np.flatnonzero(self.have[1:gap] & self.have[gap - 1 : 0 : -1]) + 1
            for a in first[first * 2 >= gap][::-1].tolist():
                if self._enough(used, (a, gap - a)):
                    return (a, gap - a)
        first = np.flatnonzero(self.have[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0)) + 1
        for a in first[first * 3 >= gap][::-1].tolist():
            rest = gap - a
            second = np.flatnonzero(self.have[1:rest] & self.have[rest - 1 : 0 : -1]) + 1
            for b in second[(second * 2 >= rest) & (second <= a)][::-1].tolist():
                if self._enough(used, (a, b, rest - b)):
                    return (a, b, rest - b)
        return ()


def pack_lengths(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """The plan for so many pieces of each length (1 to ``capacity``)."""
    lengths, slots = _Lengths(counts, capacity), []
    rank = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    while top := lengths.longest(capacity):
        used = {top: 1}
        gap = capacity - top
        while gap:
            parts = lengths.exact(gap, used)
            if not parts:
                fits = next((int(x) for x in np.flatnonzero(lengths.have[1 : gap + 1])[::-1] + 1 if lengths.left[x] > used.get(int(x), 0)), 0)
                if not fits:
                    break
                # While even three of the longest that fit leave a gap, no exact filling exists.
                many = max(1, gap // fits - 3)
                parts = (fits,) * min(many, int(lengths.left[fits]) - used.get(fits, 0))
            for part in parts:
                used[part] = used.get(part, 0) + 1
            gap -= sum(parts)
        times = min(int(lengths.left[p]) // c for p, c in used.items())
        offset = 0
        for length, copies in used.items():
            slots.append(Slot(length, int(rank[length]), copies, times, sequence, offset))
            rank[length] += copies * times
            lengths.take(length, copies * times)
            offset += copies * length
        sequence += times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to ``pieces(doc_id, piece, start, length, ids_crc32, ...)``.

    ``pieces`` is read twice and must not change in between (a written table). Pieces of one length
    are numbered by runs of their hash, so a frequent length stays spread over tasks. Repeated rows
    get places of their own; an empty table gives no rows.
    """
    slots = pack_lengths({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    slots.sort(key=lambda s: (s.length, s.rank))
    plan = np.array(slots, dtype=np.int64).reshape(-1, len(Slot._fields)).T
    spread = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * spread))
    numbered = number_rows(pieces, ["length"], [run], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, copies, times, sequence, offset = plan
        keys = length << 40 | first
        for batch in batches:
            rank = batch.pop("_rank").to_numpy() - 1
            at = np.searchsorted(keys, batch["length"].to_numpy() << 40 | rank, side="right") - 1
            inside = rank - first[at]
            batch["sequence_id"] = sequence[at] + inside // copies[at]
            batch["offset"] = offset[at] + inside % copies[at] * length[at]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    fields = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return numbered.mapInPandas(tidied(place), f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every row of ``documents(doc_id, text)``.

    Null and empty texts are one piece that holds the end id. Rows that repeat are packed once each;
    a null id is carried along; an empty table gives no rows; other columns are not read.
    """
    return pack(cut_lineage(tokenize(documents, tokenizer, capacity, end_id), "pieces"), capacity)
