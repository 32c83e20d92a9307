"""Repair of the turn structure of conversations by Hirschberg's divide and conquer.

A conversation may open with a system row; after it user and assistant alternate, and the assistant
has the last word: the initials of its roles match ``(s?(ua)+)?``. Rows are kept, get another role,
are deleted, or empty rows are inserted, at the least cost; of several cheapest ways the one whose
letters come first in ASCII order counts. Reading row by row there are four states: nothing yet,
after a system row, after a user row, after an assistant row.

Within a segment of rows the way is found in linear space: the costs of the four states run forward
from the start and backward from the end until they meet in the middle, the crossing is the state
of least total cost (of several the one with the least letters before it), and both halves are
solved in the same way. A boundary lies right behind a row's own letter, inserts belong to what
follows. So no beginning of a way is the start of another one, and the order of two beginnings
decides the order of the ways; it is carried as four ranks instead of texts.

Conversations are laid out by a range sort of all rows, so a segment is what one partition holds of
a conversation, however long it is. The few conversations that reach over a partition's border are
crossed in the same manner: each segment gives its four by four costs and ranks, the borders are
settled from these, and then every segment is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut_lineage

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: White space of the fault rules, and what ends a sentence.
_BLANK = r"\A[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Rows that a task gives back at a time.
_BATCH = 10_000
_FAR = 1 << 60

#: What an insert leads to: the role that is due.
_DUE = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts after the last row; a lone system row needs both roles.
_CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_CLASSES = "sua-"
Way = tuple[int, str]


def _ways(initial: str, fault: str) -> dict[tuple[int, int], Way]:
    """Cheapest ``(cost, letters)`` of one row from state to state: up to two inserts, then the row's letter."""
    best: dict[tuple[int, int], Way] = {}
    for start in range(4):
        state = start
        for inserts in range(3):
            cost, letters = INSERT * inserts, "I" * inserts
            found = [(state, cost + DELETE, letters + "D")]
            if fault not in ("blank", "duplicate"):
                more = UNFINISHED if fault == "truncated" else 0
                kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
                if kept == _DUE[state] or kept == SYSTEM and state == NOTHING:
                    found.append((kept, cost + more, letters + "K"))
                found.append((_DUE[state], cost + RENAME + more, letters + "R"))
            for end, price, text in found:
                best[start, end] = min(best.get((start, end), (_FAR, "")), (price, text))
            state = _DUE[state]
    return best


#: By role initial (``-`` for any other) and fault, ways into each state.
WAYS = {
    (initial, fault): [[(start, *way) for (start, to), way in _ways(initial, fault).items() if to == end] for end in range(4)]
    for initial in _CLASSES for fault in ("", "blank", "duplicate", "truncated")
}
Rows = list[tuple[str, str]]
Vector = tuple[list[int], list[int]]


def forward(rows: Rows, low: int, high: int, start: int) -> Vector:
    """Costs of ``rows[low:high]`` from a state into each state, and the ranks of their least letters."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for k in range(low, high):
        found = []
        for ways in WAYS[rows[k]]:
            found.append(min(((cost[s] + price, rank[s], text) for s, price, text in ways if cost[s] < _FAR), default=(_FAR, 9, "")))
        order = sorted(x[1:] for x in found)
        cost, rank = [x[0] for x in found], [order.index(x[1:]) for x in found]
    return cost, rank


def backward(rows: Rows, low: int, high: int, end: int | None) -> list[int]:
    """Costs of ``rows[low:high]`` from each state into ``end``, or (None) to the end of the conversation."""
    cost = [INSERT * len(_CLOSING[s]) if end is None else 0 if s == end else _FAR for s in range(4)]
    for k in range(high - 1, low - 1, -1):
        before = [_FAR] * 4
        for to, ways in enumerate(WAYS[rows[k]]):
            for s, price, _ in ways:
                before[s] = min(before[s], price + cost[to])
        cost = before
    return cost


def letters_of(rows: Rows, start: int = NOTHING, end: int | None = None) -> str:
    """The cheapest letters, least in ASCII order, that lead from ``start`` over all rows into ``end``.

    Without an ``end`` the conversation ends here. Linear in space: halves still to solve and their
    letters.
    """
    out, open_ = [], [(0, len(rows), start, end)]
    while open_:
        low, high, at, to = open_.pop()
        if low == high:
            out.append(_CLOSING[at] if to is None else "")
        elif high - low == 1 and to is not None:
            out.append(min((price, text) for s, price, text in WAYS[rows[low]][to] if s == at)[1])
        else:
            middle = (low + high + 1) // 2
            cost, rank = forward(rows, low, middle, at)
            after = backward(rows, middle, high, to)
            crossing = min(range(4), key=lambda s: (cost[s] + after[s], rank[s]))
            open_ += [(middle, high, crossing, to), (low, middle, at, crossing)]
    return "".join(out)


def settle(segments: list[list[Vector]]) -> list[int]:
    """States at the end of each segment but the last, from the segments' costs and ranks per start.

    The borders of a conversation are few (one for each partition it reaches into).
    """
    after = [[0 if s == 0 else INSERT * len(_CLOSING[s]) for s in range(4)]]
    for vectors in reversed(segments):
        after.append([min(min(c + a, _FAR) for c, a in zip(vectors[s][0], after[-1])) for s in range(4)])
    after.reverse()
    states, at = [], NOTHING
    for vectors, rest in zip(segments[:-1], after[1:]):
        cost, rank = vectors[at]
        at = min(range(4), key=lambda s: (min(cost[s] + rest[s], _FAR), rank[s]))
        states.append(at)
    return states


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``: the rows with planted faults, drawn by the checksum of ``conv_id:turn``.

    Of twenty draws 0 drops the row, 1 empties its text, 2 takes its ``. ! ?`` out, 3 repeats it, and
    4 makes it a user's. Nulls stand as one space, in the checksum too; a null conversation and a
    null turn stay what they are.
    """
    blank = F.lit(" ")
    parts = F.concat(*[F.coalesce(F.col(c).cast("string"), blank) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (F.crc32(parts) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_k")).drop("_k")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def lay_out(rows: DataFrame) -> DataFrame:
    """``conv_id, part, pos, turn, role, text, fault, initial`` of rows in order, written once.

    ``pos`` gives the order of the whole table, ``part`` the partition; ties of a turn go by role and
    text. Rows that are alike in all of these are dealt out by number, so a row repeated without end
    does not fill one partition.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    keys = ["conv_id", "turn", "role", "text"]
    ordered = rows.select(*keys, spread.alias("_x")).repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys], "_x")
    ordered = ordered.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    laid = ordered.select(*keys, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), digest.alias("_same"))
    laid = cut_lineage(laid, "turns")
    # Only texts that come up more than once can be duplicates; their first places are counts' worth of rows.
    first = laid.groupBy("conv_id", "_same").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("_same").alias("_digest"), "_first")
    found = laid.join(first, _same("conv_id", "_conv") & (F.col("_same") == F.col("_digest")), "left")
    fault = (
        F.when(F.col("text").rlike(_BLANK), "blank").when(F.col("pos") > F.col("_first"), "duplicate")
        .when(~F.col("text").rlike(_ENDED), "truncated").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    return found.select("conv_id", "part", "pos", "turn", "role", "text", fault.alias("fault"), initial.alias("initial"))


def _segments(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """``conv, part`` and lists of ``columns``, a segment (at most a partition) at a time, of a sorted stream."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch["conv"].tolist(), batch["part"].tolist()))
        values = [batch[c].tolist() for c in columns]
        low = 0
        while low < len(keys):
            high = low + 1
            while high < len(keys) and keys[high] == keys[low]:
                high += 1
            if keys[low] != key:
                if key is not None:
                    yield (*key, *held)
                key, held = keys[low], [[] for _ in columns]
            for kept, column in zip(held, values):
                kept.extend(column[low:high])
            low = high
    if key is not None:
        yield (*key, *held)


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= _BATCH:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Segments in order; ids travel as text, which keeps nulls and all digits."""
    ordered = rows.repartition(F.col("conv_id"), F.col("part")).sortWithinPartitions("conv_id", "part", "pos")
    return ordered.select(F.col("conv_id").cast("string").alias("conv"), "part", *columns)


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv").cast("long").alias("conv_id"), *[c for c in rows.columns if c != "conv"])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found() -> Iterator[tuple]:
        for conv, part, *columns in _segments(batches, "initial", "fault"):
            rows = list(zip(*columns))
            vectors = [forward(rows, 0, len(rows), s) for s in range(4)]
            yield conv, part, [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]]

    return _frames(found(), ["conv", "part", "costs", "ranks"])


def _borders(conversation: pd.DataFrame) -> pd.DataFrame:
    conversation = conversation.sort_values("part")
    segments = [[(c[4 * s : 4 * s + 4].tolist(), r[4 * s : 4 * s + 4].tolist()) for s in range(4)] for c, r in zip(conversation["costs"], conversation["ranks"])]
    states = settle(segments)
    return pd.DataFrame({"conv": conversation["conv"], "part": conversation["part"], "start": [NOTHING, *states], "end": [*states, -1]})


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found() -> Iterator[tuple]:
        for conv, _, initials, kinds, places, roles, texts, starts, ends in _segments(batches, "initial", "fault", "pos", "role", "text", "start", "end"):
            rows, state, k = list(zip(initials, kinds)), starts[0], 0
            for step, letter in enumerate(letters_of(rows, state, None if ends[0] < 0 else ends[0])):
                cost = {"D": DELETE, "R": RENAME, "I": INSERT, "K": 0}[letter]
                role = text = None
                pos = places[min(k, len(rows) - 1)]
                if letter != "D":
                    state = SYSTEM if letter == "K" and initials[k] == "s" else _DUE[state]
                    role = roles[k] if letter == "K" else "user" if state == USER else "assistant"
                    text = "" if letter == "I" else texts[k]
                if letter in "KR" and kinds[k] == "truncated":
                    cost += UNFINISHED
                k += letter != "I"
                yield conv, pos, step, letter, role, text, cost

    return _frames(found(), ["conv", "pos", "step", "op", "role", "text", "cost"])


def edits(laid: DataFrame) -> DataFrame:
    """``conv_id, pos, step, op, role, text, cost`` of rows laid out by :func:`lay_out`.

    One row for each letter, in the order of ``pos, step``; deleted rows have no role or text.
    """
    parts = laid.groupBy("conv_id").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).filter("_lo < _hi")
    wide = cut_lineage(parts.select(F.col("conv_id").alias("_conv")), "wide")
    across = _dealt(laid.join(wide, _same("conv_id", "_conv"), "left_semi").select("conv_id", "part", "pos", "initial", "fault"), "initial", "fault")
    summaries = across.mapInPandas(_summaries, "conv string, part int, costs array<long>, ranks array<long>")
    borders = summaries.groupBy("conv").applyInPandas(_borders, "conv string, part int, start int, end int")
    # At most two rows for each border between partitions.
    borders = F.broadcast(_with_id(cut_lineage(borders, "borders")).withColumnsRenamed({"conv_id": "_conv", "part": "_part"}))
    known = laid.join(borders, _same("conv_id", "_conv") & (F.col("part") == F.col("_part")), "left").drop("_conv", "_part")
    known = known.withColumns({"start": F.coalesce("start", F.lit(NOTHING)), "end": F.coalesce("end", F.lit(-1))})
    solved = _dealt(known, "initial", "fault", "pos", "role", "text", "start", "end").mapInPandas(
        _solve, "conv string, pos long, step int, op string, role string, text string, cost long"
    )
    return _with_id(solved)


def faults(laid: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal`` of rows laid out: counts with map-side combine.

    Neighbours are compared inside a segment; over the borders the last row of one and the first of
    the next, whose number the partitions bound.
    """
    legal = ("su", "ua", "au")
    before = F.lag("initial").over(Window.partitionBy("conv_id", "part").orderBy("pos"))
    pairs = laid.select("conv_id", "part", "pos", "initial", F.concat(before, "initial").alias("_pair"))
    segments = pairs.groupBy("conv_id", "part").agg(
        F.min_by("initial", "pos").alias("_first"), F.max_by("initial", "pos").alias("_last"), F.count_if(~F.col("_pair").isin(*legal)).alias("_bad"),
    )
    across = F.concat(F.lag("_last").over(Window.partitionBy("conv_id").orderBy("part")), "_first")
    segments = segments.withColumn("_over", F.coalesce((~across.isin(*legal)).cast("long"), F.lit(0)))
    illegal = segments.groupBy("conv_id").agg(F.sum(F.col("_bad") + F.col("_over")).alias("illegal")).withColumnRenamed("conv_id", "_conv")
    turns = laid.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")])
    counted = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")],
    )
    return counted.join(illegal, _same("conv_id", "_conv")).drop("_conv")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found() -> Iterator[tuple]:
        now, audit, cost, digest, begun = None, [], 0, None, False
        for batch in batches:
            for conv, op, role, text, price in zip(*(batch[c].tolist() for c in ("conv", "op", "role", "text", "cost"))):
                if digest is None or conv != now:
                    if digest is not None:
                        yield now, "".join(audit), cost, digest.hexdigest()
                    now, audit, cost, digest, begun = conv, [], 0, hashlib.sha256(), False
                audit.append(op)
                cost += price
                if op != "D":
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
        if digest is not None:
            yield now, "".join(audit), cost, digest.hexdigest()

    return _frames(found(), ["conv", "audit", "cost", "repaired_sha256"])


def digests(found: DataFrame) -> DataFrame:
    """``conv_id, audit, cost, repaired_sha256`` of :func:`edits`.

    One hash over a conversation's repaired text has to see it in order: it streams through a task,
    which holds the running hash and a letter for each row.
    """
    ordered = found.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "pos", "step")
    ordered = ordered.select(F.col("conv_id").cast("string").alias("conv"), "op", "role", "text", "cost")
    return _with_id(ordered.mapInPandas(_digests, "conv string, audit string, cost long, repaired_sha256 string"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows laid out (with their faults) and the edits that repair ``conversations(conv_id, turn, role, text)``.

    Rows are taken by turn, nulls first, ties by role and text; rows without a ``conv_id`` are one
    conversation. Null roles and texts stand as one space: such a text is blank and goes, such a role
    matches nothing. Repeated rows count as they stand: the later ones are duplicates and go. Texts
    of any length stay whole. An empty table gives two empty ones; other columns are not read.
    """
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    laid = cut_lineage(lay_out(rows), "laid")
    return laid, cut_lineage(edits(laid), "edits")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` of ``conversations`` about the repair of ``rows``: faults, cost, letters, hash.

    A conversation without rows gets zeros, no letters, and the hash of nothing.
    """
    laid, found = repair(rows)
    out = conversations.select(F.col("conv_id").cast("long")).distinct()
    for k, part in enumerate((faults(laid), digests(found))):
        out = out.join(part.withColumnRenamed("conv_id", f"_c{k}"), _same("conv_id", f"_c{k}"), "left").drop(f"_c{k}")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
