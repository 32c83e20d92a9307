"""What to know before changing a file, and the brief for a task over several files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import number_rows, running_sum, top_per
from factloom.functions.text import clip, is_test_file
from factloom.operators.derive import dependency_support
from factloom.operators.graph import dependency_edges, impact
from factloom.operators.memory import FAILED
from factloom.operators.review import dynamic_refs
from factloom.operators.rules import merge
from factloom.session import cut_lineage

BRIEF_RULES, BRIEF_FAILURES, BRIEF_CHARS = 10, 5, 6000
# Notes a dossier may carry.
NOTE_NO_FACTS = "no facts were extracted for this file (unsupported type, empty, or not scanned)"
NOTE_UNPARSED = "this file failed to fully parse; facts above may be incomplete"
NOTE_DYNAMIC = "dynamic import/require at %s; those references are not tracked"
NOTE_STATIC = "dependents come from static imports only; runtime, string-built and cross-package usage is not visible"


def dossier(
    asked: DataFrame,
    files: DataFrame,
    facts: DataFrame,
    findings: DataFrame | None = None,
    warnings: DataFrame | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """One row per asked ``(repo, file)``: counts, imports, dependents, findings, notes; error if unknown.

    Every part is an aggregate on (repo, file) joined to the asked files.
    """
    key = ["repo", "file"]
    want = asked.select(*key).distinct()
    exists = files.select(*key).distinct().withColumn("_exists", F.lit(True))
    own = facts.join(want, key, "left_semi")
    by_type = (
        own.groupBy(*key, "type").agg(F.count(F.lit(1)).alias("n")).groupBy(*key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"), F.sum("n").alias("n_facts"))
    )
    imports = own.filter(F.col("type") == "import").groupBy(*key).agg(F.count_distinct("target").alias("n_imports"))
    edges = dependency_edges(dependency_support(facts))
    hits = impact(edges, want.select("repo", F.col("file").alias("target"))).select("repo", "target", "file").distinct()
    dependents = hits.groupBy("repo", F.col("target").alias("file")).agg(
        F.count_if(~is_test_file(F.col("file"))).alias("n_source_dependents"), F.count_if(is_test_file(F.col("file"))).alias("n_test_dependents")
    )
    out = want.join(exists, key, "left").join(by_type, key, "left").join(imports, key, "left").join(dependents, key, "left")
    if findings is not None:
        out = out.join(findings.groupBy(*key).agg(F.count(F.lit(1)).alias("n_findings")), key, "left")
    else:
        out = out.withColumn("n_findings", F.lit(None).cast("long"))
    failed = F.lit(False)
    if warnings is not None:
        out = out.join(warnings.select(*key).distinct().withColumn("_failed", F.lit(True)), key, "left")
        failed = F.coalesce("_failed", F.lit(False))
    places = F.lit(None).cast("string")
    if lines is not None:
        refs = dynamic_refs(lines, want).groupBy(*key).agg(
            F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda n: n.cast("string")), ", ").alias("_refs")
        )
        out = out.join(refs, key, "left")
        places = F.col("_refs")
    zero = {n: F.coalesce(n, F.lit(0)).alias(n) for n in ("n_facts", "n_imports", "n_source_dependents", "n_test_dependents", "n_findings")}
    notes = F.filter(
        F.array(
            F.when(F.coalesce("n_facts", F.lit(0)) == 0, NOTE_NO_FACTS),
            F.when(failed, NOTE_UNPARSED),
            F.when(places.isNotNull(), F.format_string(NOTE_DYNAMIC, places)),
            F.lit(NOTE_STATIC),
        ),
        lambda n: n.isNotNull(),
    )
    known = F.coalesce("_exists", F.lit(False)) | (F.coalesce("n_facts", F.lit(0)) > 0)
    return out.select(
        *key, *zero.values(), "by_type", notes.alias("notes"),
        F.when(~known, F.concat(F.lit("file not found in project: "), F.col("file"))).alias("error"),
    )


def dossier_imports(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct import targets of each asked file."""
    key = ["repo", "file"]
    return facts.filter(F.col("type") == "import").join(asked.select(*key).distinct(), key, "left_semi").select(*key, "target").distinct()


def dossier_dependents(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Dependents of each asked file, tests marked."""
    edges = dependency_edges(dependency_support(facts))
    hits = impact(edges, asked.select("repo", F.col("file").alias("target"))).select("repo", "target", "file").distinct()
    return hits.withColumn("is_test", is_test_file(F.col("file")))


def brief_rules(rules: DataFrame, cap: int = BRIEF_RULES) -> tuple[DataFrame, DataFrame]:
    """(approved rules shown per repo, counts of approved rules beyond the cap and of unapproved ones)."""
    approved = F.col("status") == "approved"
    shown = top_per(rules.filter(approved), ["repo"], [F.col("ts"), F.col("id")], cap, "rank").withColumn("rule", clip(F.col("rule"), 160))
    counts = rules.groupBy("repo").agg(
        F.greatest(F.count_if(approved) - cap, F.lit(0)).alias("more"), F.count_if(~approved).alias("not_approved")
    )
    return shown, counts


def brief_failures(experience: DataFrame, attempts: DataFrame, cap: int = BRIEF_FAILURES) -> tuple[DataFrame, DataFrame]:
    """(the last failed approaches per repo: failed experience, then approved attempts; how many are left out)."""
    from_log = experience.filter(F.col("outcome").rlike(FAILED)).select("repo", F.lit(0).alias("src"), "ts", "task", "strategy", "outcome")
    from_attempts = attempts.filter(F.col("status") == "approved").select(
        "repo", F.lit(1).alias("src"), "ts", "task", "strategy", F.lit("failed").alias("outcome")
    )
    rows = from_log.unionByName(from_attempts)
    newest = [F.col("src").desc(), F.col("ts").desc(), F.col("task").desc(), F.col("strategy").desc()]
    last = top_per(rows, ["repo"], newest, cap, "age")
    more = rows.groupBy("repo").agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("more"))
    return last.select("repo", "age", clip(F.col("strategy"), 100).alias("strategy"), clip(F.col("task"), 100).alias("task"), clip(F.col("outcome"), 40).alias("outcome")), more


def brief(
    asked: DataFrame, files: DataFrame, facts: DataFrame, rules: DataFrame, experience: DataFrame, attempts: DataFrame,
    findings: DataFrame | None = None, warnings: DataFrame | None = None, lines: DataFrame | None = None, max_chars: int = BRIEF_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(lines of each repo's brief, what was left out of it) for work on the files ``asked(repo, file)``.

    ``repo, pos, section, text`` lists the files with their counts, then the approved rules, then what
    failed before, as long as the running length stays within ``max_chars``. The second table has a row
    per repo: ``more_rules, not_approved, more_failures``, and ``chars_left_out`` of lines that did not fit.
    """
    about = dossier(asked, files, facts, findings, warnings, lines)
    counts = F.concat_ws(", ", F.format_string("%d facts", "n_facts"), F.format_string("%d dependent sources", "n_source_dependents"), F.format_string("%d tests", "n_test_dependents"), F.format_string("%d findings", "n_findings"))
    shown_rules, rule_counts = brief_rules(rules)
    failed, more_failures = brief_failures(experience, attempts)
    items = merge([
        about.select("repo", F.lit(0).alias("part"), F.lit("files").alias("section"), F.col("file").alias("key"), F.concat("file", F.lit(": "), F.coalesce("error", counts)).alias("text")),
        shown_rules.select("repo", F.lit(1).alias("part"), F.lit("rules").alias("section"), F.format_string("%06d", "rank").alias("key"), F.col("rule").alias("text")),
        # The oldest of the last failures comes first.
        failed.select("repo", F.lit(2).alias("part"), F.lit("failures").alias("section"), F.format_string("%06d", F.lit(999999) - F.col("age")).alias("key"),
                      F.concat_ws(" | ", "strategy", "task", "outcome").alias("text")),
    ])
    numbered = number_rows(items, ["repo"], [F.col("part"), F.substring("key", 1, 24)], [F.col("key"), F.col("text")], "pos")
    summed = cut_lineage(running_sum(numbered, ["repo"], "pos", F.length("text") + 1, "_end"), "brief")
    fits = F.col("_end") <= max_chars
    left = summed.filter(~fits).groupBy("repo").agg(F.sum(F.length("text") + 1).alias("chars_left_out"))
    repos = asked.select("repo").distinct()
    out = repos.join(rule_counts, "repo", "left").join(more_failures.withColumnRenamed("more", "more_failures"), "repo", "left").join(left, "repo", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("more", "more_rules"), ("not_approved",) * 2, ("more_failures",) * 2, ("chars_left_out",) * 2)]
    return summed.filter(fits).join(repos, "repo", "left_semi").select("repo", "pos", "section", "text"), out.select("repo", *zero)
