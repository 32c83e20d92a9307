"""Review: two snapshots and claims -> verdicts, uncovered changes, dependents, level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import review as rv
from factloom.operators.verification import changed_files, delta
from factloom.plans.scan import Scan
from factloom.sources.corpus import to_lines


@dataclass(frozen=True)
class Review:
    changed: DataFrame
    verdicts: DataFrame
    changes: DataFrame
    unclaimed: DataFrame
    dependents: DataFrame
    dynamic: DataFrame
    overall: DataFrame


def review_change(before: Scan, after: Scan, claims: DataFrame) -> Review:
    """Check ``claims(claim_id, repo, type, target, entity, file, route_path, fact_type)`` of a change."""
    changed = changed_files(before.files, after.files)
    lines = to_lines(after.files.filter(F.col("content").isNotNull()))
    unparsed = after.warnings.filter(F.col("file") != "(project-level)").select("repo", "file")
    verdicts = rv.evaluate_claims(claims, before.facts, after.facts, changed, lines, unparsed)
    changes = delta(before.facts, after.facts)
    free = rv.unclaimed(changes, claims)
    dependents = rv.unreviewed_dependents(changed, before.facts, after.facts)
    dynamic = rv.dynamic_refs(lines, changed)

    def per_repo(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("repo").agg(F.count(F.lit(1)).alias(name))

    sources = dependents.filter(~F.col("is_test")).select("repo", "file").distinct()
    gaps = (
        after.files.select("repo").distinct()
        .join(per_repo(free, "unclaimed"), "repo", "left")
        .join(per_repo(sources, "dependents"), "repo", "left")
        .join(per_repo(dynamic.select("repo").unionByName(after.warnings.select("repo")), "coverage_gaps"), "repo", "left")
    )
    tied = verdicts.join(claims.select("claim_id", "repo"), "claim_id")
    return Review(changed, verdicts, changes, free, dependents, dynamic, rv.overall(tied, gaps))
