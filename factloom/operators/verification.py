"""Are recorded facts still true? Drift, deltas between snapshots, provenance of conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import RUN_WIDTH, number_rows
from factloom.functions.text import evidence, line_hash, packed_id, unpacked_id
from factloom.session import cut_lineage

STATUSES = ("confirmed", "stale", "file_missing", "line_gone", "unverifiable")
DRIFTED = ("stale", "file_missing", "line_gone")


def verify_facts(facts: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """Compare each fact with the line now at its place: adds ``status`` and ``current_evidence``.

    Two equi-joins: on the file (does it exist) and on (file, line number). Whole lines are compared by
    their hash; a fact without one (a document that is no line, an older table) is compared by its
    snippet. What travels are keys and prints of both in eight bytes; snippets do if a reader asks for them.
    """
    keep = [c for c in ("id", "repo", "type", "file", "line", "evidence") if c in facts.columns]
    stored = F.col("line_hash") if "line_hash" in facts.columns else F.lit(None).cast("string")
    if "id" in keep:
        facts = facts.withColumn("id", packed_id(F.col("id")))
    facts = facts.withColumns({
        "_was": _print(stored), "_was_shown": F.when(stored.isNull(), _print(F.col("evidence"))), "_bare": F.col("evidence").isNull(),
    })
    current = lines.select(
        "repo", "file", F.col("ln").cast("long").alias("line"), evidence(F.col("line")).alias("current_evidence"),
        _print(line_hash(F.col("line"))).alias("_now"), _print(evidence(F.col("line"))).alias("_now_shown"),
    )
    # (repo, file, line) is the key that splits long files over tasks; the existence check decides
    # for facts whose line is not found only, and the outcome for the others is all that goes there.
    at_line = facts.select(*keep, "_was", "_was_shown", "_bare").join(current, ["repo", "file", "line"], "left")
    found = (
        F.when(F.col("file").isNull() | F.col("line").isNull() | F.col("_bare"), "unverifiable")
        .when(F.coalesce(F.col("_now") == F.col("_was"), F.col("_now_shown") == F.col("_was_shown")), "confirmed")
        .when(F.col("_now_shown").isNotNull(), "stale")
    )
    at_line = at_line.select(*keep, "current_evidence", found.alias("_found"))
    present = files.select("repo", "file").distinct().withColumn("_present", F.lit(True))
    joined = at_line.join(present, ["repo", "file"], "left")
    status = F.coalesce("_found", F.when(F.col("_present").isNull(), "file_missing").otherwise("line_gone"))
    shown = [unpacked_id(F.col(c)).alias(c) if c == "id" else c for c in keep]
    return joined.select(*shown, "current_evidence", status.alias("status"))


def _print(text: Column) -> Column:
    """Eight bytes that stand for a text; null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def drift_summary(verified: DataFrame) -> DataFrame:
    """One row: counts of every status (zero where absent) and the total."""
    return verified.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("total")
    )


def drifted_facts(verified: DataFrame) -> DataFrame:
    return verified.filter(F.col("status").isin(*DRIFTED))


def fact_key(facts: DataFrame) -> Column:
    """What a fact says and in which file, never its id or line."""
    named = F.coalesce(*[F.col(c) for c in ("name", "target", "callee", "route_path", "evidence") if c in facts.columns], F.lit(""))
    ident = F.when(F.col("entity").isNull() | (F.col("entity") == F.col("id")), named).otherwise(F.col("entity"))
    return F.concat_ws("|", F.coalesce("type", F.lit("")), F.coalesce("file", F.lit("")), ident, F.coalesce("caller", F.lit("")))


def number_occurrences(facts: DataFrame) -> DataFrame:
    """Add ``fact_key`` and ``occurrence``, 0-based by line within (repo, key)."""
    numbered = _number(facts.withColumn("fact_key", fact_key(facts)), "_n")
    return numbered.withColumn("occurrence", F.col("_n") - 1).drop("_n")


def _number(keyed: DataFrame, out: str) -> DataFrame:
    """Number facts of one key by line; a key with very many lines is cut into runs of lines."""
    order = [F.col(c) for c in ("line", "ext_ord", "pos", "id")]
    return number_rows(keyed, ["repo", "fact_key"], [F.floor(F.coalesce("line", F.lit(0)) / RUN_WIDTH)], order, out)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts added and removed between two snapshots: ``side`` is 'added' or 'removed'.

    One union and one aggregate per key count both sides; only keys whose counts differ are written and
    joined back, and the surplus are the last occurrences.
    """

    def keyed(facts: DataFrame) -> DataFrame:
        return facts.withColumn("fact_key", fact_key(facts))

    b, a = keyed(before), keyed(after)
    counts = (
        b.select("repo", "fact_key", F.lit(1).alias("b"), F.lit(0).alias("a"))
        .unionByName(a.select("repo", "fact_key", F.lit(0).alias("b"), F.lit(1).alias("a")))
        .groupBy("repo", "fact_key")
        .agg(F.sum("b").alias("nb"), F.sum("a").alias("na"))
        .filter(F.col("nb") != F.col("na"))
    )
    uneven = cut_lineage(counts, "uneven", compression="zstd")
    # Keys of both sides are few in most changes; a table of their own is known to be small and moves no facts.
    shared = cut_lineage(uneven.filter((F.col("nb") > 0) & (F.col("na") > 0)), "shared", compression="zstd")

    def surplus(facts: DataFrame, mine: str, other: str, side: str) -> DataFrame:
        # Keys that vanish or appear as a whole need no numbering.
        whole = facts.join(uneven.filter(F.col(other) == 0).select("repo", "fact_key"), ["repo", "fact_key"], "left_semi")
        more = shared.filter(F.col(mine) > F.col(other)).select("repo", "fact_key", other)
        part = _number(facts.join(more, ["repo", "fact_key"]), "_n").filter(F.col("_n") > F.col(other))
        return whole.unionByName(part.drop("_n", other)).withColumn("side", F.lit(side))

    return surplus(a, "na", "nb", "added").unionByName(surplus(b, "nb", "na", "removed"), allowMissingColumns=True)


def evidence_slice(verified: DataFrame, wanted: DataFrame) -> DataFrame:
    """Verified facts of ``wanted(repo, file)`` with their provenance."""
    return verified.join(wanted.select("repo", "file").distinct(), ["repo", "file"], "left_semi").withColumn(
        "provenance", F.when(F.col("status") == "confirmed", "verified").otherwise("observed")
    )


def claim_provenance(support: DataFrame, verified: DataFrame, wanted: DataFrame) -> DataFrame:
    """Derived nodes that touch ``wanted(repo, file)``; verified only if all their facts are confirmed."""
    marked = wanted.select("repo", F.col("file").alias("fact_file")).distinct().withColumn("_wanted", F.lit(True))
    status = verified.select(packed_id(F.col("id")).alias("_fact"), F.col("file").alias("fact_file"), "status")
    rows = support.select(packed_id(F.col("derived_id")).alias("_node"), "repo", "type", "file", packed_id(F.col("fact_id")).alias("_fact"))
    rows = rows.join(status, "_fact").drop("_fact").join(marked, ["repo", "fact_file"], "left")
    nodes = rows.groupBy("_node", "repo", "type", "file").agg(
        F.count(F.lit(1)).alias("n_support"),
        F.count_if(F.col("status") == "confirmed").alias("n_confirmed"),
        F.bool_or(F.coalesce("_wanted", F.lit(False))).alias("_touches"),
    )
    own = wanted.select("repo", "file").distinct().withColumn("_own", F.lit(True))
    touched = nodes.join(own, ["repo", "file"], "left").filter(F.col("_touches") | F.col("_own"))
    return touched.select(
        unpacked_id(F.col("_node")).alias("derived_id"), "repo", "type", "file", "n_support", "n_confirmed",
        F.when(F.col("n_confirmed") == F.col("n_support"), "verified").otherwise("inferred").alias("provenance"),
    )


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or different between two ``files`` tables: ``(repo, file, change)``."""

    def prints(files: DataFrame, name: str) -> DataFrame:
        return files.select("repo", "file", F.sha2("content", 256).alias(name))

    return _compare(prints(before, "b"), prints(after, "a"))


def changed_files_by_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same from ``lines`` tables: a file's print is the sum of its line hashes.

    Sums combine map-side, so one huge file is summed by all tasks that hold a part of it.
    """

    def prints(lines: DataFrame, name: str) -> DataFrame:
        one = F.xxhash64("ln", "line").cast("decimal(20,0)")
        two = F.xxhash64("line", "ln").cast("decimal(20,0)")
        return lines.groupBy("repo", "file").agg(
            F.struct(F.count(F.lit(1)), F.sum(one), F.sum(two)).alias(name)
        )

    return _compare(prints(before, "b"), prints(after, "a"))


def _compare(b: DataFrame, a: DataFrame) -> DataFrame:
    both = b.join(a, ["repo", "file"], "full_outer")
    change = (
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select("repo", "file", "change")
