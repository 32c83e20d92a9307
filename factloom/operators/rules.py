"""Rule packs: regular expressions over numbered lines, applied in one narrow pass.

A pack is a list of slots, a slot a list of rules. Within a slot the first rule that matches a line
wins; slots are independent, so one line can give a fact per slot. All rules of a pack become one
array expression per line that is exploded once: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import evidence, line_hash, path_confidence

Groups = Callable[[int], Column]

# Columns of a raw fact. ``ext_ord`` and ``pos`` order facts like a sequential scan would.
RAW_FACT = (
    "repo", "type", "file", "line", "name", "target", "caller", "callee", "method", "route_path",
    "kind", "confidence", "evidence", "line_hash", "extra", "ext_ord", "pos",
)
_HIT_FIELDS = ("name", "target", "caller", "callee", "method", "route_path", "kind")
_POS_PER_RULE = 1_000_000


@dataclass(frozen=True)
class Rule:
    """One pattern. Field values are functions of the match groups.

    ``each`` takes every match of the line instead of the first one; ``many`` splits one match into
    several facts and is the array of their names; ``when`` is a further condition on the line.
    ``confidence`` "path" leaves it to the path of the file.
    """

    type: str
    pattern: str
    fields: dict[str, Callable[[Groups], Column]] = field(default_factory=dict)
    extra: dict[str, Callable[[Groups], Column]] = field(default_factory=dict)
    groups: int = 1
    each: bool = False
    many: Callable[[Groups], Column] | None = None
    many_fields: tuple[str, ...] = ("name",)
    when: Callable[[Groups, Column], Column] | None = None
    type_of: Callable[[Groups], Column] | None = None
    confidence: str | Callable[[Groups], Column] = "high"


@dataclass(frozen=True)
class Pack:
    name: str
    order: int
    slots: tuple[tuple[Rule, ...], ...]
    skip: str | None = None
    # Literals of which a line must hold one to be looked at; a byte search is far cheaper than a pattern.
    needs: tuple[str, ...] = ()


def group(number: int) -> Callable[[Groups], Column]:
    return lambda g: g(number)


def _hit(rule: Rule, g: Groups, pos: Column, named: Column | None = None) -> Column:
    values = {name: make(g) for name, make in rule.fields.items()}
    if named is not None:
        values.update({name: named for name in rule.many_fields})
    pairs = [x for key, make in rule.extra.items() for x in (F.lit(key), make(g).cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map()
    if callable(rule.confidence):
        confidence = rule.confidence(g)
    else:
        confidence = F.lit(None if rule.confidence == "path" else rule.confidence)
    kind = rule.type_of(g) if rule.type_of else F.lit(rule.type)
    return F.struct(
        kind.alias("type"),
        *[values.get(n, F.lit(None)).cast("string").alias(n) for n in _HIT_FIELDS],
        confidence.cast("string").alias("confidence"),
        extra.cast("map<string,string>").alias("extra"),
        pos.cast("int").alias("pos"),
    )


def _rule_hits(rule: Rule, line: Column, index: int) -> tuple[Column, Column]:
    """(does the rule match, array of hits)."""
    base = F.lit(index * _POS_PER_RULE)
    if rule.each:
        zipped = F.arrays_zip(
            *[
                F.regexp_extract_all(line, F.lit(rule.pattern), F.lit(i)).alias(f"g{i}")
                for i in range(1, rule.groups + 1)
            ]
        )

        def one(match: Column, i: Column) -> Column:
            def g(n: int) -> Column:
                return match[f"g{n}"]

            if rule.many is None:
                return F.array(_hit(rule, g, base + i))
            return F.transform(rule.many(g), lambda item, j: _hit(rule, g, base + i * 1000 + j, item))

        if rule.when is not None:
            zipped = F.filter(zipped, lambda m: rule.when(lambda n: m[f"g{n}"], line))
        hits = F.flatten(F.transform(zipped, one))
        return line.rlike(rule.pattern), hits

    def g(n: int) -> Column:
        return F.regexp_extract(line, rule.pattern, n)

    matched = line.rlike(rule.pattern)
    if rule.when is not None:
        matched = matched & rule.when(g, line)
    if rule.many is None:
        return matched, F.array(_hit(rule, g, base))
    return matched, F.transform(rule.many(g), lambda item, j: _hit(rule, g, base + j, item))


def any_of(text: Column, literals: Sequence[str]) -> Column:
    hit = F.contains(text, F.lit(literals[0]))
    for literal in literals[1:]:
        hit = hit | F.contains(text, F.lit(literal))
    return hit


def pack_wants(pack: Pack, line: Column) -> Column:
    """Does any pattern of the pack match the line."""
    found = line.rlike("|".join(f"(?:{rule.pattern})" for slot in pack.slots for rule in slot))
    if pack.skip:
        found = ~line.rlike(pack.skip) & found
    return any_of(line, pack.needs) & found if pack.needs else found


def line_hits(pack: Pack, line: Column) -> Column:
    """Array of all facts one line gives under a pack."""
    index, parts = 0, []
    for slot in pack.slots:
        chain = None
        for rule in slot:
            matched, hits = _rule_hits(rule, line, index)
            chain = F.when(matched, hits) if chain is None else chain.when(matched, hits)
            index += 1
        parts.append(chain)
    empty = F.array().cast(
        "array<struct<type:string,"
        + ",".join(f"{n}:string" for n in _HIT_FIELDS)
        + ",confidence:string,extra:map<string,string>,pos:int>>"
    )
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def extract_lines(lines: DataFrame, pack: Pack, text: str = "line", keep: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Apply a pack to ``lines(repo, file, ln, line)`` and return raw facts.

    ``text`` names the column to match; the evidence is always the line itself. ``keep`` passes
    further columns of ``lines`` through. ``where`` leaves out lines.
    """
    line = F.col(text)
    tests = [where] if where is not None else []
    if pack.needs:
        tests.append(any_of(line, pack.needs))
    if pack.skip:
        tests.append(~line.rlike(pack.skip))
    found, rows = line_hits(pack, line), lines
    # A filter on a computed text would be pushed below it and compute it again for every test.
    for test in reversed(tests):
        rows, found = (rows.filter(test), found) if text == "line" else (rows, F.when(test, found))
    hits = rows.select("repo", "file", "ln", "line", *keep, F.explode(found).alias("h"))
    return hits.select(
        "repo",
        F.col("h.type").alias("type"),
        "file",
        F.col("ln").cast("long").alias("line"),
        *[F.col(f"h.{n}").alias(n) for n in _HIT_FIELDS[:-1]],
        F.col("h.kind").alias("kind"),
        F.coalesce("h.confidence", path_confidence(F.col("file"))).alias("confidence"),
        evidence(F.col("line")).alias("evidence"),
        line_hash(F.col("line")).alias("line_hash"),
        F.col("h.extra").alias("extra"),
        F.lit(pack.order).alias("ext_ord"),
        F.col("h.pos").alias("pos"),
        *keep,
    )


def raw_facts(df: DataFrame, order: int, **values: Column) -> DataFrame:
    """Bring a hand-made selection into the raw fact layout; missing columns become null."""
    types = {"line": "long", "ext_ord": "int", "pos": "int", "extra": "map<string,string>"}
    have = dict(values)
    have.setdefault("ext_ord", F.lit(order))
    have.setdefault("pos", F.lit(0))
    have.setdefault("extra", F.create_map())
    columns = []
    for name in RAW_FACT:
        value = have.get(name)
        if value is None:
            value = F.col(name) if name in df.columns else F.lit(None)
        columns.append(value.cast(types.get(name, "string")).alias(name))
    return df.select(*columns)


def merge(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
