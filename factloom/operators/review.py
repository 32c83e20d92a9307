"""Reviewing a change: claims against two snapshots, uncovered changes, dependents, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.matching import word_join
from factloom.functions.runs import top_per
from factloom.functions.text import is_test_file, strip
from factloom.operators.derive import dependency_support
from factloom.operators.graph import dependency_edges, impact
from factloom.operators.rules import merge
from factloom.session import cut_lineage

EVIDENCE_CAP = 5

# Claim types with the fields they need; other types are not mapped.
CLAIM_FIELDS = {
    "import_removed": ("target",),
    "import_added": ("target",),
    "fact_removed": ("entity",),
    "route_exists": ("route_path",),
    "no_remaining_references": ("entity",),
    "file_changed": ("file",),
    "test_fixed": ("file",),
}
# Reasons given with a verdict.
REASONS = {
    "unparsed": "%s failed to fully parse",
    "never": "fact not present in the before-graph; cannot show it was removed",
    "still": "still present after the change",
    "gone": "present before, absent after",
    "new": "absent before, present after",
    "existed": "import already existed before the change",
    "absent": "import not present after the change",
    "route": "route found in graph",
    "no_route": "route not found; extractor may not cover this route style",
    "no_entity": "entity never appeared in the before-graph; cannot show references were removed",
    "refs": "%d reference(s) remain",
    "mentions": "no structural references remain, but %d textual mention(s) exist in non-doc files (possible string or dynamic reference)",
    "clean": "no structural or textual references remain outside docs",
    "in_diff": "file appears in the diff",
    "not_in_diff": "file not in the diff",
    "no_tests": "test execution is not enabled",
    "unmapped": "claim cannot be expressed as a structural check (behavior and intent are not verified)",
}
# Fixed value: documents left out of text searches.
SEARCH_DOCS = r"(?i)\.(?:md|txt|rst)\z"
CODE_FILE = r"\.(?:[cm]?[jt]sx?)\z"


def validate_claims(claims: DataFrame) -> DataFrame:
    """Known claim types with all their fields, trimmed, other fields dropped; the rest is 'unmapped'."""
    optional = {"import_removed": ("file",), "import_added": ("file",), "fact_removed": ("fact_type", "file")}
    fields = ("target", "entity", "file", "route_path", "fact_type")
    have = {f: F.nullif(strip(F.col(f)), F.lit("")) for f in fields}
    kind = F.col("type")
    valid = F.lit(False)
    for name, needed in CLAIM_FIELDS.items():
        complete = kind == name
        for f in needed:
            complete = complete & have[f].isNotNull()
        valid = valid | complete
    out = claims.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    for f in fields:
        takers = [n for n, need in CLAIM_FIELDS.items() if f in need or f in optional.get(n, ())]
        out = out.withColumn(f, F.when(F.col("_valid") & kind.isin(*takers), have[f]))
    return out.withColumn("type", F.when(F.col("_valid"), kind).otherwise("unmapped")).drop("_valid")


_PLACES = "array<struct<file:string,line:bigint>>"


def _verdict(rows: DataFrame, *steps: tuple[Column, str, Column, str | None]) -> DataFrame:
    """Apply (condition, verdict, reason, which count is the evidence) steps in order."""
    none, nothing = F.lit(None), F.lit(0)
    out = {"verdict": None, "reason": None, "evidence": None, "n_evidence": None}
    for condition, value, text, side in steps:
        places, count = (F.col(f"{side}_places"), F.col(side)) if side else (none, nothing)
        for name, made in zip(out, (F.lit(value), text, places, count)):
            out[name] = F.when(condition, made) if out[name] is None else out[name].when(condition, made)
    evidence = F.coalesce(out["evidence"].cast(_PLACES), F.array().cast(_PLACES))
    return rows.select("claim_id", out["verdict"].alias("verdict"), out["reason"].alias("reason"), evidence.alias("evidence"), out["n_evidence"].cast("long").alias("n_evidence"))


def _tally(claims: DataFrame, hits: DataFrame, keys: list[str], sides: tuple[str, ...] = ("was", "now")) -> DataFrame:
    """Claims with ``was, now`` (how often their key occurs before and after) and the first places of each.

    ``hits(*keys, side, file, line)`` are counted and ranked per key, both with a partial step before
    the shuffle, so a claim meets one row and a task passes on few however often a fact repeats.
    """
    counted = hits.groupBy(*keys).agg(*[F.count_if(F.col("side") == s).alias(s) for s in sides])
    first = top_per(hits.select(*keys, "side", F.col("file").alias("_f"), F.col("line").cast("long").alias("_l")), [*keys, "side"], [F.col("_f"), F.col("_l")], EVIDENCE_CAP, "_rank")
    place = F.struct("_rank", F.struct(F.col("_f").alias("file"), F.col("_l").alias("line")).alias("place"))
    listed = first.groupBy(*keys).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, place))), lambda x: x["place"]).alias(f"{s}_places") for s in sides
    ])
    found = claims.join(counted, keys, "left").join(listed, keys, "left")
    return found.withColumns({s: F.coalesce(s, F.lit(0)) for s in sides})


def _both(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("side", F.lit("was")).unionByName(after.withColumn("side", F.lit("now")))


def _with_presence(claims: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Presence of ``(repo, entity[, fact_type][, file])`` for removal and import claims, in one pass.

    Facts that no claim names leave first; the others count under those of their keys (with or
    without type and file) that a claim asks for; a key of a kind that no claim has is not made.
    """
    keys = ["repo", "entity", "_type", "_file"]
    keyed = claims.withColumns({"_type": F.coalesce("fact_type", F.lit("")), "_file": F.coalesce("file", F.lit(""))})
    asked = keyed.select(*keys).distinct()
    facts = _both(*[f.select("repo", "entity", "type", "file", "line") for f in (before, after)])
    named = facts.join(asked.select("repo", "entity").distinct(), ["repo", "entity"], "left_semi")
    # With or without type and file: the shapes in use, four rows at most.
    any_type, any_file = F.col("_type") == "", F.col("_file") == ""
    shapes = asked.select(any_type.alias("_any_type"), any_file.alias("_any_file")).distinct()
    hits = named.crossJoin(F.broadcast(shapes)).select(
        "repo", "entity", F.when(F.col("_any_type"), "").otherwise(F.col("type")).alias("_type"),
        F.when(F.col("_any_file"), "").otherwise(F.col("file")).alias("_file"), "side", "file", "line",
    )
    return _tally(keyed, hits.join(asked, keys, "left_semi"), keys)


def reference_keys(facts: DataFrame) -> DataFrame:
    """Every name a fact refers to: entity, callee, target, and each path tail of the target."""
    steps = F.split("target", "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/")
    )
    names = F.array_distinct(
        F.filter(F.concat(F.array("entity", "callee", "target"), F.coalesce(tails, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    )
    return facts.select("repo", F.explode(names).alias("entity"), "file", "line")


def text_search(lines: DataFrame, needles: DataFrame) -> DataFrame:
    """Whole-word literal hits of ``needles([repo,] needle)`` outside documents: ``(needle, repo, file, ln)``.

    Needles with a repo are searched in that repository only.
    """
    searched = lines.filter(~F.col("file").rlike(SEARCH_DOCS)).select("repo", "file", "ln", "line")
    on = ["repo"] if "repo" in needles.columns else []
    wanted = needles.filter(strip(F.col("needle")) != "").select(*on, "needle").distinct()
    return word_join(searched, wanted, on=on).select("needle", "repo", "file", "ln")


def evaluate_claims(
    claims: DataFrame,
    before: DataFrame,
    after: DataFrame,
    changed: DataFrame,
    lines: DataFrame,
    unparsed: DataFrame | None = None,
) -> DataFrame:
    """Verdict of each claim: ``(claim_id, verdict, reason, evidence, n_evidence)``.

    ``evidence`` holds the first ``EVIDENCE_CAP`` places ``(file, line)`` that the verdict rests on, in
    their order, ``n_evidence`` how many there are.

    ``claims(claim_id, repo, type, target, entity, file, route_path, fact_type)``; ``changed(repo,
    file)``; ``lines`` of the after-snapshot for the textual check. Every claim type is one equi-join
    against counted keys; the text search only sees entities that passed all structural checks.
    """
    checked = validate_claims(claims)
    if unparsed is None:
        checked = checked.withColumn("_unparsed", F.lit(False))
    else:
        bad = unparsed.select("repo", "file").distinct().withColumn("_unparsed", F.lit(True))
        checked = checked.join(bad, ["repo", "file"], "left").withColumn("_unparsed", F.coalesce("_unparsed", F.lit(False)))
    kind = F.col("type")
    text = {k: F.lit(v) for k, v in REASONS.items()}
    unparsed_step = (F.col("_unparsed"), "unverifiable", F.format_string(REASONS["unparsed"], "file"), None)
    was, now = F.col("was"), F.col("now")

    imports_as_facts = checked.filter(kind.isin("fact_removed", "import_removed", "import_added")).withColumn(
        "entity", F.when(kind == "fact_removed", F.col("entity")).otherwise(F.col("target"))
    ).withColumn("fact_type", F.when(kind == "fact_removed", F.col("fact_type")).otherwise("import"))
    adds = kind == "import_added"
    presence = _verdict(
        _with_presence(imports_as_facts, before, after),
        unparsed_step,
        (adds & (now > 0) & (was == 0), "supported", text["new"], "now"),
        (adds & (was > 0), "contradicted", text["existed"], "was"),
        (adds, "contradicted", text["absent"], None),
        (was == 0, "unverifiable", text["never"], None),
        (now > 0, "contradicted", text["still"], "now"),
        (F.lit(True), "supported", text["gone"], "was"),
    )

    asked_routes = checked.filter(kind == "route_exists")
    routes = after.filter(F.col("route_path").isNotNull()).select("repo", "route_path", "file", "line", F.lit("now").alias("side"))
    route = _verdict(
        _tally(asked_routes, routes.join(asked_routes.select("repo", "route_path").distinct(), ["repo", "route_path"], "left_semi"), ["repo", "route_path"]),
        (now > 0, "supported", text["route"], "now"),
        (F.lit(True), "unverifiable", text["no_route"], None),
    )

    wanted = checked.filter(kind == "no_remaining_references")
    entities = wanted.select("repo", "entity").distinct()
    mentioned = _both(reference_keys(before), reference_keys(after)).join(entities, ["repo", "entity"], "left_semi")
    # The text search asks for it before the verdicts do: written once.
    structural = cut_lineage(_tally(wanted, mentioned, ["repo", "entity"]), "references")
    open_entities = structural.filter((was > 0) & (now == 0)).select("repo", F.col("entity").alias("needle")).distinct()
    mentions = text_search(lines, open_entities).select("repo", F.col("needle").alias("entity"), F.lit("mentions").alias("side"), "file", F.col("ln").alias("line"))
    references = _verdict(
        _tally(structural, mentions, ["repo", "entity"], ("mentions",)),
        (was == 0, "unverifiable", text["no_entity"], None),
        (now > 0, "contradicted", F.format_string(REASONS["refs"], "now"), "now"),
        (F.col("mentions") > 0, "unverifiable", F.format_string(REASONS["mentions"], "mentions"), "mentions"),
        (F.lit(True), "supported", text["clean"], None),
    )

    diff = changed.select("repo", "file").distinct().withColumn("_changed", F.lit(True))
    file_changed = _verdict(
        checked.filter(kind == "file_changed").join(diff, ["repo", "file"], "left"),
        (F.coalesce("_changed", F.lit(False)), "supported", text["in_diff"], None),
        (F.lit(True), "contradicted", text["not_in_diff"], None),
    )
    rest = _verdict(
        checked.filter(kind.isin("test_fixed", "unmapped")),
        (kind == "test_fixed", "unverifiable", text["no_tests"], None),
        (F.lit(True), "unverifiable", text["unmapped"], None),
    )
    return merge([presence, route, references, file_changed, rest])


def claim_evidence(claims: DataFrame, facts: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """Up to ``cap`` facts per removal or import claim, in file and line order."""
    kind = F.col("type")
    asked = claims.filter(kind.isin("fact_removed", "import_removed", "import_added")).select(
        "claim_id", "repo", F.coalesce("entity", "target").alias("entity"),
        F.when(kind == "fact_removed", F.col("fact_type")).otherwise("import").alias("want_type"), F.col("file").alias("want_file"),
    )
    hits = asked.join(facts.select("repo", "entity", F.col("type").alias("fact_type"), "file", "line", "id"), ["repo", "entity"]).filter(
        (F.col("want_type").isNull() | (F.col("want_type") == F.col("fact_type")))
        & (F.col("want_file").isNull() | (F.col("want_file") == F.col("file")))
    )
    return top_per(hits, ["claim_id"], [F.col("file"), F.col("line"), F.col("id")], cap, "rank").select(
        "claim_id", "rank", "file", "line", F.col("id").alias("fact_id")
    )


def unclaimed(changes: DataFrame, claims: DataFrame) -> DataFrame:
    """Changes whose entity and file no claim of the repo names."""
    names = claims.select("repo", F.explode(F.array("entity", "target")).alias("entity")).filter(F.col("entity").isNotNull()).distinct()
    files = claims.select("repo", "file").filter(F.col("file").isNotNull()).distinct()
    return changes.join(names, ["repo", "entity"], "left_anti").join(files, ["repo", "file"], "left_anti")


def unreviewed_dependents(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Unchanged files that depend on changed ones: ``(repo, file, target, is_test)``.

    Removed files are looked up in the before-snapshot, all others in the after-snapshot.
    """

    def dependents(facts: DataFrame, targets: DataFrame) -> DataFrame:
        edges = dependency_edges(dependency_support(facts))
        return impact(edges, targets.select("repo", F.col("file").alias("target"))).select("repo", "file", "target")

    gone = F.col("change") == "removed"
    rows = dependents(after, changed.filter(~gone)).unionByName(dependents(before, changed.filter(gone))).distinct()
    return rows.join(changed.select("repo", "file").distinct(), ["repo", "file"], "left_anti").withColumn(
        "is_test", is_test_file(F.col("file"))
    )


def dynamic_refs(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """``require(x)`` / ``import(x)`` with a computed argument in changed code files."""
    literal = r"\A\s*(?:'[^']*'|\"[^\"]*\"|`[^`$]*`)\s*\z"
    call = r"(?<!\w)(?:require|import)\s*\(\s*([^)]*)\)"
    code = lines.filter(F.col("file").rlike(CODE_FILE) & F.col("line").rlike(call)).join(
        changed.select("repo", "file").distinct(), ["repo", "file"], "left_semi"
    )
    args = F.filter(F.regexp_extract_all("line", F.lit(call), F.lit(1)), lambda a: (strip(a) != "") & ~a.rlike(literal))
    return code.select("repo", "file", F.col("ln").alias("line"), F.explode(args).alias("argument"))


def overall(verdicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Level and reasons per repo.

    ``verdicts(repo, verdict)``; ``gaps(repo, unclaimed, dependents, coverage_gaps)`` has a row per
    repo under review.
    """
    counted = verdicts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "contradicted").alias("bad"),
        F.count_if(F.col("verdict") == "unverifiable").alias("open"),
    )
    rows = gaps.join(counted, "repo", "full_outer")
    n, bad, open_ = (F.coalesce(c, F.lit(0)) for c in ("n", "bad", "open"))
    free, deps, cover = (F.coalesce(c, F.lit(0)) for c in ("unclaimed", "dependents", "coverage_gaps"))
    # Wording of the reasons.
    reasons = F.filter(
        F.array(
            F.when(n == 0, "no claims were checked"),
            F.when(open_ > 0, F.format_string("%d claim(s) cannot be verified structurally", open_)),
            F.when(free > 0, F.format_string("%d change(s) no claim covers", free)),
            F.when(deps > 0, F.format_string("%d dependent source file(s) not reviewed", deps)),
            F.when(cover > 0, "coverage gaps"),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.select(
        "repo",
        F.when(bad > 0, "REJECT").when(F.size(reasons) > 0, "REVIEW").otherwise("ACCEPT").alias("level"),
        F.when(bad > 0, F.array(F.format_string("%d claim(s) contradicted by the code", bad)))
        .when(F.size(reasons) > 0, reasons)
        .otherwise(F.array(F.lit("all claims supported; no uncovered changes or gaps"))).alias("reasons"),
    )


def change_rollup(changes: DataFrame) -> DataFrame:
    """``side, file, type, n, level``: uncovered changes per side, file and type, with subtotals.

    ``level`` tells the rows apart: ``type``, or ``file`` and ``side`` for the subtotals over types and
    over files, whose columns are null.
    """
    sets = changes.groupingSets([["side", "file", "type"], ["side", "file"], ["side"]], "side", "file", "type")
    # A bit of the grouping id is set for each column left out.
    level = F.element_at(F.create_map(F.lit(0), F.lit("type"), F.lit(1), F.lit("file"), F.lit(3), F.lit("side")), F.grouping_id("side", "file", "type").cast("int"))
    return sets.agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


def rollup_report(changes: DataFrame, cap: int = 10) -> tuple[DataFrame, DataFrame]:
    """(files with most uncovered changes per side, how many files were left out per side)."""
    per_file = changes.groupBy("side", "file").agg(F.count(F.lit(1)).alias("n"))
    shown = top_per(per_file, ["side"], [F.col("file")], cap, "rank")
    left_out = per_file.groupBy("side").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("more"))
    return shown, left_out
