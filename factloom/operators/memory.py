"""Rules, experience and attempts: append-only tables with status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import first_per
from factloom.functions.text import content_id, squeeze, strip
from factloom.operators.ledger import parse_entries

# Starting confidences and allowed outcomes.
CONFIDENCE_WITH_EVIDENCE, CONFIDENCE_WITHOUT = 0.5, 0.3
OUTCOMES = ("success", "failure")
FAILED = r"(?i)fail|wrong|revert|reject|broke|regress|abandon"


def propose_rules(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rules, rejected rows) of ``proposals(repo, rule, category, evidence_note, ts)``."""
    empty = F.coalesce(strip(F.col("rule")), F.lit("")) == ""
    rules = proposals.filter(~empty).select(
        content_id("mem", F.col("repo"), F.col("rule"), F.col("ts")).alias("id"), "repo", "rule",
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("convention")).alias("category"),
        F.when(F.coalesce("evidence_note", F.lit("")) != "", CONFIDENCE_WITH_EVIDENCE).otherwise(CONFIDENCE_WITHOUT).alias("confidence"),
        "evidence_note", F.lit("proposed").alias("status"), "ts",
    )
    return rules, proposals.filter(empty).withColumn("error", F.lit("a rule needs a non-empty text"))


def set_status(table: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the newest status of each id, events for unknown ids).

    ``events(id, status, ts)``; the newest event wins, found by an aggregate with map-side combine.
    """
    newest = events.groupBy("id").agg(F.max_by("status", "ts").alias("_status"))
    current = table.join(newest, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    unknown = events.join(table.select("id"), "id", "left_anti").withColumn("error", F.lit("no entry with this id"))
    return current.select(*table.columns), unknown


def list_rules(rules: DataFrame, status: str | None = None) -> DataFrame:
    return rules if status is None else rules.filter(F.col("status") == status)


def log_experience(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log rows, rejected rows) of ``runs(repo, task, strategy, outcome, evidence_source, ts)``."""
    good = (F.coalesce("task", F.lit("")) != "") & F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))
    rows = runs.filter(good).select(
        content_id("exp", F.col("repo"), F.col("task"), F.col("strategy"), F.col("outcome"), F.col("ts")).alias("id"),
        "repo", "task", "strategy", "outcome", "evidence_source", "ts",
    )
    return rows, runs.filter(~good).withColumn("error", F.lit("task or outcome is not valid"))


def list_experience(log: DataFrame, outcome: str | None = None) -> DataFrame:
    return log if outcome is None else log.filter(F.col("outcome") == outcome)


def propose_attempts(attempts: DataFrame, proposals: DataFrame) -> DataFrame:
    """New attempts of ``proposals(task, strategy, source, evidence, ts)`` that are not in ``attempts``.

    The id hashes all of what was tried, so proposing twice adds nothing; texts are stored whole and
    cut only where they are shown.
    """
    task, strategy = squeeze(F.coalesce("task", F.lit(""))), squeeze(F.coalesce("strategy", F.lit("")))
    rows = proposals.select(
        F.substring(F.sha2(F.concat(task, F.lit("\n"), strategy), 256), 1, 32).alias("id"), "ts", task.alias("task"),
        strategy.alias("strategy"), F.lit("failed").alias("outcome"), F.lit("proposed").alias("status"),
        F.coalesce("source", F.lit("manual")).alias("source"), "evidence",
    ).filter((F.col("task") != "") & (F.col("strategy") != ""))
    return first_per(rows, ["id"], ["ts", "source", "evidence", "task", "strategy"]).join(attempts.select("id"), "id", "left_anti")


def approved_failures(attempts: DataFrame) -> DataFrame:
    return attempts.filter(F.col("status") == "approved")


def suggest_from_ledger(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts to propose from rejected reviews: what was claimed and contradicted."""
    rows = parse_entries(ledger).filter(F.col("entry.overall") == "REJECT")
    bad = F.transform(F.filter("entry.results", lambda r: r["verdict"] == "contradicted"), lambda r: r["claim"])
    # Wording of the suggestion.
    proposals = rows.withColumn("bad", bad).filter(F.size("bad") > 0).select(
        F.concat(F.lit("agent change reviewed against "), F.col("entry.base")).alias("task"),
        F.concat(F.lit("claimed: "), F.array_join("bad", "; "), F.lit(" (contradicted by the code)")).alias("strategy"),
        F.lit("ledger").alias("source"), F.concat(F.lit("ledger:"), F.substring("entry.hash", 1, 12)).alias("evidence"),
        F.col("entry.ts").cast("timestamp").alias("ts"),
    )
    return propose_attempts(attempts, proposals)
