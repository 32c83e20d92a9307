"""Repeated byte strings across documents, from merged Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else. The
suffixes of a large corpus are not sorted as a whole. Each string of ``LENGTH`` bytes is assigned
to its anchor, the short string in it with the smallest hash; consecutive strings with one anchor
form a span. Equal strings have the same anchor at the same place, so

* an anchor that occurs once has no repeated string around it;
* an anchor all of whose spans are equal has nothing else: they are removed whole;
* only anchors with different spans are looked at closely. Equal spans are one string with a count.
  Strings are cut into blocks of ``BLOCK`` bytes counted from the anchor. Shards of strings get
  their transforms, these are merged, and runs of suffixes that share enough blocks are the repeated
  intervals. The few bytes at either end that blocks do not reach are compared within an interval.

An anchor with more than ``MAX_STRINGS`` different spans would be too much for one task: its strings
of ``LENGTH`` bytes are counted by hash over the whole cluster instead, which gives the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bwt import merge, transform
from factloom.llm.common import by_bytes, mix, tidied, tidy
from factloom.session import cut_lineage

LENGTH = 200
ANCHOR, BLOCK = 48, 8
#: Strings of one anchor that meet in one task.
MAX_STRINGS = 50_000
#: Bytes of a shard, and bytes of shards that are merged together; anchors are never split over merges.
SHARD_BYTES, MERGE_BYTES = 1 << 18, 1 << 21
#: Anchors and keys of documents are broadcast up to this many rows (16 bytes each), and shuffled beyond;
#: what belongs to a document, a list of any length, always travels by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of documents hashed together.
CHUNK_BYTES = 1 << 19

_PLACES = LENGTH - ANCHOR + 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = np.uint64(0xD1342543DE82EF95)
_POSITION_BITS = np.uint64(24)


def _powers(exponent: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), exponent, 1 << 64))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from each place on, by doubling: 1, 2, 4, ... 32, then 32 + 16."""
    with np.errstate(over="ignore"):
        h, width, sixteen = _TABLE[data], 1, None
        while width < 32:
            h = h[:-width] * _powers(width) + h[width:]
            width *= 2
            if width == 16:
                sixteen = h
        h = h[: len(h) - 16] * _powers(16) + sixteen[32:]
        return mix(h)


def _anchor_of_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per start of a string of ``LENGTH`` bytes: the place of its anchor; and the hashes by place."""
    hashes = _anchor_hashes(data)
    mask = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    # The smallest hash, the leftmost of equal ones: the place stands in the low bits.
    least = hashes & ~mask | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= _PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _PLACES - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & mask).astype(np.int64), hashes


def spans_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``text, anchor place, first start, last start, anchor hash, span hash`` of every span of whole texts."""
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_BYTES):
            size += len(texts[stop])
            stop += 1
        for part in _spans(texts[at:stop]):
            parts.append((part[0] + at, *part[1:]))
        at = stop
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    return tuple(np.concatenate(column) for column in zip(*parts))


def _spans(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    whole = b"".join(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    # A text beyond the chunk size is read in pieces that overlap by what a string needs.
    for low in range(0, max(len(whole) - LENGTH + 1, 0), 4 * CHUNK_BYTES):
        data = np.frombuffer(whole, dtype=np.uint8)[low : low + 4 * CHUNK_BYTES + LENGTH - 1]
        anchor, hashes = _anchor_of_starts(data)
        starts = np.arange(len(anchor)) + low
        owner = np.searchsorted(begins, starts, side="right") - 1
        valid = np.flatnonzero(starts + LENGTH <= begins[owner] + lengths[owner])
        if not len(valid):
            continue
        fresh = np.ones(len(valid), dtype=bool)
        fresh[1:] = (anchor[valid[1:]] != anchor[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
        first = valid[fresh]
        last = valid[np.append(np.flatnonzero(fresh)[1:] - 1, len(valid) - 1)]
        texts_of = owner[first]
        view = memoryview(whole)
        digest = xxhash.xxh3_64_intdigest
        offset = anchor[first] - first
        span = np.fromiter((digest(view[a:b], o) for a, b, o in zip((first + low).tolist(), (last + low + LENGTH).tolist(), offset.tolist())), dtype=np.uint64, count=len(first))
        shift = low - begins[texts_of]
        yield texts_of, anchor[first] + shift, first + shift, last + shift, hashes[anchor[first]], span


def _spans_table(documents: DataFrame) -> DataFrame:
    """``anchor, span, doc_id, text_hash, at`` of all documents; ``at`` packs the anchor's place and the starts around it."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_bytes(batches, most=4 * CHUNK_BYTES):
            owner, place, first, last, anchor, span = spans_of([(t or "").encode("utf-8", "replace") for t in batch["text"].tolist()])
            ids = batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            yield pd.DataFrame({
                "anchor": anchor.view(np.int64), "span": span.view(np.int64), "doc_id": pd.array(ids[owner], dtype="Int64"),
                "text_hash": batch["text_hash"].to_numpy()[owner], "at": place << 16 | (place - first) << 8 | (last - first),
            })

    return _keyed(documents).mapInPandas(tidied(find), "anchor long, span long, doc_id long, text_hash long, at long")


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows told apart by id and text: equal rows have equal results."""
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def _first_start(at: str | Column = "at") -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.shiftright(at, 16) - F.shiftright(at, 8).bitwiseAND(F.lit(255))


def _size_checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _named(rows: DataFrame, *more: str) -> DataFrame:
    """The keys of rows under names that no table of documents has."""
    return rows.select(F.col("doc_id").alias("_repeats_fid"), F.col("text_hash").alias("_repeats_fhash"), *[F.col(c).alias(f"_repeats_{c}") for c in more])


def _same(doc_id: str, text_hash: str) -> Column:
    return F.col(doc_id).eqNullSafe(F.col("_repeats_fid")) & (F.col(text_hash) == F.col("_repeats_fhash"))


def repeated_starts(strings: list[bytes], offsets: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Per string the starts of repeated pieces of ``LENGTH`` bytes, as flat pairs (first, last).

    ``offsets`` are the places of the anchors, which line up the blocks; a string with a count above
    1 is repeated throughout. Equal pieces must belong to one anchor.
    """
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(bytes(BLOCK) + b"".join(strings) + bytes(BLOCK), dtype=np.uint8)
    skip = offsets % BLOCK
    n_blocks = (lengths - skip) // BLOCK
    depth = (LENGTH - BLOCK + 1) // BLOCK

    # Blocks as symbols.
    first = np.cumsum(n_blocks) - n_blocks
    index = np.arange(int(n_blocks.sum())) - np.repeat(first, n_blocks)
    place = np.repeat(begins + skip, n_blocks) + BLOCK * index
    packed = _packed(data, place + BLOCK)
    _, symbols = np.unique(packed, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1

    # Shards of whole strings, their transforms, and the merge.
    shards, owners = [], []
    at = 0
    while at < len(strings):
        stop = max(int(np.searchsorted(begins, begins[at] + SHARD_BYTES)), at + 1)
        end = first[stop] if stop < len(strings) else len(symbols)
        shards.append(transform(symbols[first[at] : end], n_blocks[at:stop]))
        owners.append(shards[-1].string + at)
        at = stop
    merged = merge(shards, depth)
    rows = (np.cumsum([len(s.symbols) for s in shards]) - [len(s.symbols) for s in shards])[merged.shard] + merged.row
    string = np.concatenate(owners)[rows]
    block = np.concatenate([s.start for s in shards])[rows]

    # Repeated intervals: runs of suffixes that share at least ``depth`` blocks.
    joined = merged.shared >= depth
    run = np.cumsum(~joined)
    inside = joined.copy()
    inside[:-1] |= joined[1:]
    string, block, run = string[inside], block[inside], run[inside]
    start = skip[string] + BLOCK * block
    marks = np.zeros(int(lengths.sum()) + 1, dtype=bool)
    core = depth * BLOCK
    head = _packed(data, begins[string] + start)
    tail = _packed(data, begins[string] + start + core + BLOCK)
    spare = LENGTH - core
    for d in range(BLOCK):
        # Pieces that start d bytes before the blocks: d bytes ahead and spare - d behind are compared.
        ok = np.flatnonzero((start >= d) & (start - d + LENGTH <= lengths[string]))
        if not len(ok) or d > spare:
            continue
        ahead = head[ok] & ((np.uint64(1) << np.uint64(8 * d)) - np.uint64(1))
        behind = tail[ok] >> np.uint64(8 * d)
        key = (ahead << np.uint64(64 - 8 * d) if d else np.zeros(len(ok), dtype=np.uint64)) | behind
        order = np.lexsort((key, run[ok]))
        fresh = np.ones(len(ok), dtype=bool)
        fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (run[ok][order[1:]] != run[ok][order[:-1]])
        group = np.cumsum(fresh) - 1
        found = np.bincount(group, counts[string[ok[order]]]) > 1
        hit = ok[order[found[group]]]
        marks[begins[string[hit]] + start[hit] - d] = True
    out = []
    for i, (begin, size) in enumerate(zip(begins.tolist(), lengths.tolist())):
        if counts[i] > 1:
            out.append([0, size - LENGTH])
            continue
        line = marks[begin : begin + size - LENGTH + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], line, [False]]).astype(np.int8)))
        edges[1::2] -= 1
        out.append(edges.tolist())
    return out


def _packed(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ``BLOCK`` bytes from each place on as one number, the first byte highest; zeros stand for places past the end."""
    out = np.zeros(len(place), dtype=np.uint64)
    for k in range(BLOCK):
        out = out << np.uint64(8) | data[np.minimum(place + k, len(data) - 1)].astype(np.uint64)
    return out


def _merged_starts(rows: DataFrame) -> DataFrame:
    """``anchor, span, starts`` from ``rows(anchor, span, n, offset, bytes)``: each task merges whole anchors."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            anchors = batch["anchor"].to_numpy()
            cuts = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(batch))
            lengths = np.cumsum(batch["bytes"].map(len).to_numpy())
            low = 0
            if held and len(anchors) and held[-1]["anchor"].iloc[-1] != anchors[0] and size >= MERGE_BYTES:
                yield done(held)
                held, size = [], 0
            for cut in cuts.tolist():
                here = int(lengths[cut - 1] - (lengths[low - 1] if low else 0))
                if size + here >= MERGE_BYTES and cut < len(batch):
                    yield done([*held, batch.iloc[low:cut]])
                    held, size, low = [], 0, cut
            if low < len(batch):
                held.append(batch.iloc[low:])
                size += int(lengths[-1] - (lengths[low - 1] if low else 0))
        if held:
            yield done(held)

    def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
        table = pd.concat(parts)
        starts = repeated_starts(table["bytes"].tolist(), table["offset"].to_numpy(), table["n"].to_numpy())
        return pd.DataFrame({"anchor": table["anchor"].to_numpy(), "span": table["span"].to_numpy(), "starts": starts})

    dealt = rows.repartition(F.col("anchor")).sortWithinPartitions("anchor", "span")
    return dealt.mapInPandas(tidied(work), "anchor long, span long, starts array<int>")


def _counted_starts(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many strings: pieces are counted by hash over the cluster."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, span, n, text in zip(batch["anchor"], batch["span"], batch["n"], batch["bytes"]):
                digests = [xxhash.xxh3_128_digest(text[i : i + LENGTH]) for i in range(len(text) - LENGTH + 1)]
                yield pd.DataFrame({"anchor": anchor, "span": span, "n": n, "start": np.arange(len(digests), dtype=np.int32), "piece": digests})

    found = rows.mapInPandas(tidied(pieces), "anchor long, span long, n long, start int, piece binary")
    repeated = found.groupBy("anchor", "piece").agg(F.sum("n").alias("_n")).filter("_n > 1").select("anchor", "piece")
    kept = found.join(repeated, ["anchor", "piece"], "left_semi")
    pairs = F.flatten(F.transform(F.array_sort(F.collect_set("start")), lambda s: F.array(s, s)))
    return kept.groupBy("anchor", "span").agg(pairs.alias("starts"))


def find_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, starts`` of documents with repeated strings: ranges of starts, first and last included."""
    spans = _spans_table(documents)
    states = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), F.min("span").alias("_lo"), F.max("span").alias("_hi")).filter("_n > 1")
    states = cut_lineage(states.select("anchor", (F.col("_lo") != F.col("_hi")).alias("mixed")), "anchors")
    found = cut_lineage(spans.join(_size_checked(states), "anchor"), "spans")

    mixed = found.filter("mixed")
    strings = mixed.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "at")).alias("_where"))
    strings = cut_lineage(strings.select("anchor", "span", "n", "_where.*"), "strings")
    per_row = strings.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "span", "n", "at")).alias("_spans"))
    cut = _cut_strings(documents, per_row)

    crowded = cut_lineage(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MAX_STRINGS).select("anchor"), "crowded")
    if crowded.isEmpty():
        starts = _merged_starts(cut)
    else:
        cut = cut_lineage(cut, "cut")
        usual, many = cut.join(crowded, "anchor", "left_anti"), cut.join(crowded, "anchor", "left_semi")
        starts = _merged_starts(usual).unionByName(_counted_starts(many))
    starts = starts.filter(F.size("starts") > 0)

    low = _first_start()
    begin = mixed.join(starts, ["anchor", "span"]).select("doc_id", "text_hash", F.transform("starts", lambda s: s + low).alias("starts"))
    plain = found.filter("NOT mixed").select("doc_id", "text_hash", F.array(low, low + F.col("at").bitwiseAND(F.lit(255))).alias("starts"))
    # One list per document, no longer than the document itself; equal rows find the same ranges.
    return begin.unionByName(plain).groupBy("doc_id", "text_hash").agg(F.collect_set("starts").alias("_s")).select("doc_id", "text_hash", F.flatten("_s").alias("starts"))


def _cut_strings(documents: DataFrame, per_row: DataFrame) -> DataFrame:
    """``anchor, span, n, offset, bytes`` cut from the texts that ``per_row(doc_id, text_hash, _spans)`` names."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch["text"].tolist(), batch["_spans"]):
                data = text.encode("utf-8", "replace")
                for s in spans:
                    place, back, more = s["at"] >> 16, s["at"] >> 8 & 255, s["at"] & 255
                    out.append((s["anchor"], s["span"], s["n"], back, data[place - back : place - back + more + LENGTH]))
            yield pd.DataFrame(out, columns=["anchor", "span", "n", "offset", "bytes"])

    per_row = cut_lineage(per_row, "wanted")
    rows = _keyed(documents).join(_size_checked(_named(per_row)), _same("doc_id", "text_hash"), "left_semi")
    # Equal rows name the same text: one of them is enough.
    wanted = _named(per_row, "_spans").hint("merge")
    joined = rows.join(wanted, _same("doc_id", "text_hash")).select("text", F.col("_repeats__spans").alias("_spans"))
    found = joined.mapInPandas(tidied(cut), "anchor long, span long, n long, offset long, bytes binary")
    return found.dropDuplicates(["anchor", "span"]) if _has_equal_rows(documents) else found


def _has_equal_rows(documents: DataFrame) -> bool:
    counts = _keyed(documents).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter("n > 1").isEmpty()


def cut_repeats(documents: DataFrame) -> DataFrame:
    """Adds ``n_bytes, n_removed, n_spans, kept`` to ``documents(doc_id, text, ...)``; rows and other columns stay.

    ``kept`` holds the remaining bytes of the UTF-8 text, which may begin or end inside a character.
    Null and empty texts have no bytes. Rows that repeat are places of their own, so each repeats
    the other; an empty table gives no rows. Columns of these four names are replaced.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    columns = [c for c in documents.columns if c not in added]
    rows = documents.select(*columns).withColumns({"_repeats_id": F.col("doc_id").cast("long"), "_repeats_hash": F.xxhash64("text")})
    found = cut_lineage(find_repeats(documents), "repeats")

    same = _same("_repeats_id", "_repeats_hash")

    def with_starts(left: DataFrame, how: str) -> DataFrame:
        return left.join(_named(found, "starts").hint("merge"), same, how).select(*columns, "_repeats_starts")

    keys = _named(found)
    if keys.count() <= BROADCAST_ROWS:
        # Documents without a repeat stay where they are.
        keys = F.broadcast(keys)
        plain = rows.join(keys, same, "left_anti").select(*columns, F.lit(None).cast("array<bigint>").alias("_repeats_starts"))
        joined = with_starts(rows.join(keys, same, "left_semi"), "inner").unionByName(plain)
    else:
        joined = with_starts(rows, "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        try:
            for texts, starts in batches:
                for part in by_bytes([pd.DataFrame({"text": texts, "starts": starts})], most=4 * CHUNK_BYTES):
                    yield pd.DataFrame([without(t, s) for t, s in zip(part["text"], part["starts"])], columns=list(added))
        finally:
            tidy()

    return joined.withColumn("_repeats_cut", cut("text", "_repeats_starts")).select(*columns, *[F.col(f"_repeats_cut.{c}").alias(c) for c in added])


def without(text: str | None, starts) -> tuple[int, int, int, bytes]:
    """Size, removed bytes, removed runs and what is left, given ranges of repeated starts."""
    data = (text or "").encode("utf-8", "replace")
    if starts is None or not len(starts):
        return len(data), 0, 0, data
    ranges = np.asarray(starts, dtype=np.int64).reshape(-1, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1] + LENGTH)
    fresh = np.append(True, ranges[1:, 0] > reach[:-1])
    low = ranges[fresh, 0]
    high = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]
    parts, at = [], 0
    for a, b in zip(low.tolist(), high.tolist()):
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return len(data), int((high - low).sum()), len(low), b"".join(parts)
