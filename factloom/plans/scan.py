"""Scan: files -> facts, findings, derived nodes, warnings, meta."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.derive import derive_all
from factloom.operators.facts import normalize_facts
from factloom.operators.findings import dedup_findings
from factloom.operators.rules import RAW_FACT
from factloom.registry import Registry, split_errors
from factloom.session import cut_lineage
from factloom.sources.corpus import coverage_stats, detect_stack, filter_ignored


@dataclass(frozen=True)
class Scan:
    files: DataFrame
    facts: DataFrame
    findings: DataFrame
    nodes: DataFrame
    support: DataFrame
    warnings: DataFrame
    meta: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        """What :func:`factloom.sources.snapshots.write_snapshot` takes."""
        return {
            "facts": self.facts, "derived": self.nodes, "support": self.support, "findings": self.findings,
            "warnings": self.warnings, "meta": self.meta,
        }


def scan(files: DataFrame, ignore: Sequence[str] = (), registry: Registry | None = None, incomplete: bool = False) -> Scan:
    """Scan ``files(repo, file, content)``.

    The files are read once and cut into what each extractor looks at; facts are written once, since
    derived nodes, coverage and all later questions read them. ``Scan.files`` stays a view of the source.
    Repos without a supported file get no derived nodes and the status ``no_supported_files``.
    """
    registry = registry or Registry()
    kept = registry.bucketed(filter_ignored(files, ignore))
    parts = registry.split(kept)
    raw, found, warnings = registry.run(kept, parts=parts)
    raw = cut_lineage(raw.select(*RAW_FACT), "facts")
    raw, failed = split_errors(raw)
    warnings = warnings.unionByName(failed)
    facts = normalize_facts(raw)
    stack = detect_stack(parts.paths(), parts.project())
    meta = coverage_stats(parts.paths(), warnings)
    if incomplete:
        meta = meta.withColumn("status", F.lit("timeout"))
    meta = meta.join(stack, "repo", "left")
    supported = meta.filter(F.col("status") != "no_supported_files").select("repo")
    nodes, support = derive_all(facts, stack.join(supported, "repo", "left_semi"), incomplete)
    return Scan(kept, facts, dedup_findings(found), nodes, support, warnings, meta)
