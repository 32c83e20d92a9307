"""Fitting an answer into a token budget: the longest affordable prefix of each section, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import running_sum
from factloom.session import cut_lineage

# Sections in the order they are served, and the default budget.
SECTIONS = ("hypotheses", "memory", "unknowns", "insights", "statements", "facts")
MAX_TOKENS = 8000


def fit_section(items: DataFrame, remaining: DataFrame) -> DataFrame:
    """Items whose running cost stays within the remaining budget.

    ``items(objective_id, pos, cost)``, ``remaining(objective_id, left)``. Costs are never negative,
    so stopping at the first overflow equals keeping every row with running cost <= left.
    """
    summed = running_sum(items, ["objective_id"], "pos", F.col("cost"), "running")
    return summed.join(remaining.select("objective_id", "left"), "objective_id").filter(F.col("running") <= F.col("left")).drop("left")


def fit_budget(
    base: DataFrame, items: DataFrame, max_tokens: int = MAX_TOKENS, sections: Sequence[str] = SECTIONS
) -> tuple[DataFrame, DataFrame]:
    """(kept items, report per question and section).

    ``base(objective_id, used)`` is the cost before any section; ``items(objective_id, section, pos,
    cost)`` with 1-based ``pos``. The budget left is one row per question; it is written after each
    section, so the plan grows with the number of sections and does not double with each.
    """
    items = cut_lineage(items, "items", "section")
    state = base.select("objective_id", F.col("used").cast("long").alias("used"))
    kept_parts, reports = [], []
    for section in sections:
        own = items.filter(F.col("section") == section)
        remaining = state.withColumn("left", F.greatest(F.lit(0), F.lit(max_tokens) - F.col("used")))
        kept = fit_section(own, remaining)
        sizes = own.groupBy("objective_id").agg(F.count(F.lit(1)).alias("_all"))
        taken = kept.groupBy("objective_id").agg(F.count(F.lit(1)).alias("_kept"), F.sum("cost").alias("_tokens"))
        joined = (
            state.join(sizes, "objective_id", "left")
            .join(taken, "objective_id", "left")
            .select(
                "objective_id", "used", F.coalesce("_all", F.lit(0)).alias("_all"), F.coalesce("_kept", F.lit(0)).alias("kept"),
                F.coalesce("_tokens", F.lit(0)).alias("tokens"),
            )
        )
        joined = cut_lineage(joined, "budget")
        reports.append(
            joined.select(
                "objective_id", F.lit(section).alias("section"), "tokens", "kept", (F.col("_all") - F.col("kept")).alias("dropped")
            )
        )
        state = joined.select("objective_id", (F.col("used") + F.col("tokens")).alias("used"))
        kept_parts.append(kept)
    total = state.select(
        "objective_id", F.lit("total").alias("section"), F.col("used").alias("tokens"), F.lit(None).cast("long").alias("kept"),
        F.lit(None).cast("long").alias("dropped"),
    )
    kept_all, report = kept_parts[0], reports[0]
    for part in kept_parts[1:]:
        kept_all = kept_all.unionByName(part)
    for part in reports[1:]:
        report = report.unionByName(part)
    return kept_all, report.unionByName(total)
