"""Repair of conversations against an exhaustive search and a plain search over whole texts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from factloom.llm import conversations as C

WANTED = re.compile(r"(s?(ua)+)?")
CLASSES = list(C.WAYS)
SCHEMA = "conv_id long, turn long, role string, text string, part int, pos string, fault int, initial string, _k string, cost string, start string"


def exhaustive(rows):
    """Every way with up to two inserts in each gap."""
    fillings = ["", "u", "a", "ua", "au"]
    best = (C._FAR, "")
    choices = []
    for initial, fault in rows:
        more = 3 if fault == "truncated" else 0
        some = [("D", "", 4)]
        if fault not in ("blank", "duplicate"):
            some += [("K", initial, more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        choices.append(some)
    for picked in itertools.product(*choices):
        for gaps in itertools.product(fillings, repeat=len(rows) + 1):
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * len(gaps[0])
            for (letter, role, price), gap in zip(picked, gaps[1:]):
                roles, audit, cost = roles + role + gap, audit + letter + "I" * len(gap), cost + price + 3 * len(gap)
            if (cost, audit) < best and WANTED.fullmatch(roles):
                best = (cost, audit)
    return best


def plain(rows):
    """The least (cost, letters) of each state row by row, letters in full."""
    now = {C.NOTHING: (0, "")}
    for row in rows:
        after = {}
        for end, ways in enumerate(C.WAYS[row]):
            found = [(now[s][0] + price, now[s][1] + text) for s, price, text in ways if s in now]
            if found:
                after[end] = min(found)
        now = after
    return min((cost + 3 * len(C._CLOSING[s]), text + C._CLOSING[s]) for s, (cost, text) in now.items())


def cost_of(rows, letters):
    k = total = 0
    for letter in letters:
        total += {"K": 0, "R": 3, "D": 4, "I": 3}[letter]
        if letter != "I":
            total += 3 * (letter != "D" and rows[k][1] == "truncated")
            k += 1
    assert k == len(rows)
    return total


def test_ways_against_every_way():
    draw = random.Random(3)
    for n in (1, 2, 3):
        for _ in range(40 if n < 3 else 12):
            rows = [draw.choice(CLASSES) for _ in range(n)]
            assert plain(rows) == exhaustive(rows)


def test_halves_meet_in_the_cheapest_and_least_way():
    draw = random.Random(4)
    for n in [0, *range(1, 60), 400]:
        rows = [draw.choice(CLASSES) for _ in range(n)]
        found = C.letters_of(rows)
        assert (cost_of(rows, found), found) == (plain(rows) if n else (0, ""))


def test_segments_settle_like_the_whole():
    draw = random.Random(5)
    for _ in range(60):
        rows = [draw.choice(CLASSES) for _ in range(draw.randint(2, 40))]
        cuts = sorted(draw.sample(range(1, len(rows)), min(len(rows) - 1, draw.randint(1, 5))))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        states = C.settle([[C.forward(p, 0, len(p), s) for s in range(4)] for p in pieces])
        found = "".join(C.letters_of(p, a, b) for p, a, b in zip(pieces, [C.NOTHING, *states], [*states, None]))
        assert found == plain(rows)[1]


def brute(table):
    """The report of a list of ``(conv_id, turn, role, text)``."""
    shown = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in table:
        rows = by.setdefault(conv, [])
        d = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", shown(text)) if d == 2 else shown(text)
        rows += [(turn, "user" if d == 4 else shown(role), text)] * {0: 0, 3: 2}.get(d, 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        seen, classes, faults = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            end = text.rstrip(" \t\n\r\x0b\x0c")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            classes.append((role[0] if role[:1] in ("s", "u", "a") else "-", fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(classes, classes[1:]))
        cost, audit = plain(classes) if rows else (0, "")
        repaired, k, state = [], 0, ""
        for letter in audit:
            if letter == "K":
                role = rows[k][1]
            elif letter != "D":
                role = "assistant" if state == "u" else "user"
            if letter != "D":
                repaired.append(f"{role}:{'' if letter == 'I' else rows[k][2]}")
                state = role[0]
            k += letter != "I"
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def odd_conversations(seed=1):
    """Nulls in all columns, unknown roles, blank and repeated rows, gaps, tied turns, one very long conversation."""
    draw = random.Random(seed)
    texts = ["yes.", "no", "", " \t\n", "why?", "well ", "so!\n", "a.b", "\u0085", None, "é.", "x" * 50_000 + ". "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "unknown"]
    out = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 9)):
            if draw.random() < 0.9:
                out.append((conv, None if draw.random() < 0.05 else turn * draw.choice([1, 1, 1, 2]), draw.choice(roles), draw.choice(texts)))
    out += [(77, t, draw.choice(roles), draw.choice(texts[:9])) for t in range(600)]
    out += [(78, 5, "user", "same.")] * 300
    out += [(79, None, None, None)] * 3
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_report(spark, partitions):
    rows = odd_conversations()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame([(*r, 1, "p", 2, "i", "k", "c", "s") for r in rows], SCHEMA).repartition(3)
        found = C.report(table, C.damage(table)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = brute(rows)
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == expected[r.conv_id], r.conv_id


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert C.report(table, C.damage(table)).collect() == []


def test_repair_gives_the_rows(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "user", "there."), (1, 2, "assistant", "hm"), (2, 0, "tool", "x.")], "conv_id long, turn long, role string, text string")
    _, edits = C.repair(table)
    found = [(r.conv_id, r.op, r.role, r.text) for r in edits.orderBy("pos", "step").collect()]
    assert found == [(1, "K", "user", "hi."), (1, "I", "assistant", ""), (1, "K", "user", "there."), (1, "K", "assistant", "hm"), (2, "D", None, None)]
