"""Derived knowledge: dependencies, routes, components, summaries, each tied to its facts.

The tables are long: ``support(derived_id, ..., fact_id, target)`` has a row per supporting fact and
comes from a narrow projection, since the id of a derived node is a hash of what it is about. Nodes
are hash aggregates over it. No array ever holds all facts of a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import content_id
from factloom.operators.rules import merge

FACT_ORDER = ("ext_ord", "file", "line", "pos")

# The wording of derived descriptions.
STACK_TEXT = (
    "%sDetected stack: %s. %d React component(s), %d Express route(s), %d Next.js page route(s), "
    "%d Next.js API route(s) across the scanned source tree."
)
NO_STACK_TEXT = (
    "%sNo first-class framework (React/Next.js/Express) confirmed from package.json. "
    "%d component-like function(s) detected heuristically."
)
PARTIAL_TEXT = " (Based on a partial, time-limited scan -- see scan_incomplete_notice.)"
INCOMPLETE_TEXT = "The scan of this repository was cut short: facts of files that were not reached are missing from all that follows."
API_TEXT = "%d API endpoint(s) discovered across Express and Next.js route conventions."
COMPONENT_TEXT = "%d React component(s) identified by declaration pattern + JSX-return heuristic."


def node_id(kind: Column, file: Column) -> Column:
    """The id of the derived node of a kind that is about a file, or about the repo where that is null."""
    return content_id("derived", F.col("repo"), kind, file)


def _support(facts: DataFrame, kind: Column | str, target: Column, per_file: bool) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    file = F.col("file") if per_file else F.lit(None).cast("string")
    return facts.select(
        node_id(kind, file).alias("derived_id"),
        "repo", kind.alias("type"), file.alias("file"), F.col("id").alias("fact_id"), target.alias("target"),
        F.struct(*FACT_ORDER).alias("ord"),
    )


def dependency_support(facts: DataFrame) -> DataFrame:
    """Support rows of file_dependency, shell_dependency and doc_reference nodes (one pass)."""
    target = F.col("target")
    local_import = (F.col("type") == "import") & target.startswith(".")
    local_link = (F.col("type") == "doc_link") & ~target.rlike(r"\Ahttps?://") & ~target.startswith("#")
    kind = (
        F.when(local_import, "file_dependency")
        .when(F.col("type") == "shell_source", "shell_dependency")
        .when(local_link, "doc_reference")
    )
    chosen = facts.filter(local_import | (F.col("type") == "shell_source") | local_link)
    return _support(chosen, kind, target, per_file=True)


def derive_support(facts: DataFrame) -> DataFrame:
    """All support rows of a corpus."""
    kind = F.col("type")
    shown = kind.isin("react_component", "express_route", "next_page_route", "next_api_route")
    return merge([
        _support(facts.filter(shown), "architecture_summary", F.lit(None).cast("string"), per_file=False),
        dependency_support(facts),
        _support(facts.filter(kind.isin("express_route", "next_api_route")), "api_surface", F.col("route_path"), per_file=False),
        _support(facts.filter(kind == "react_component"), "component_index", F.col("name"), per_file=False),
    ])


def derived_targets(support: DataFrame) -> DataFrame:
    """Distinct targets per node, in order of first appearance (``first``)."""
    return support.groupBy("derived_id", "repo", "type", "file", "target").agg(
        F.min("ord").alias("first"), F.count(F.lit(1)).alias("n_support")
    )


def file_nodes(support: DataFrame) -> DataFrame:
    """One node per file and kind with counts of distinct targets and supporting facts."""
    per_target = derived_targets(support)
    return per_target.groupBy("derived_id", "repo", "type", "file").agg(
        F.count(F.lit(1)).alias("n_targets"), F.sum("n_support").alias("n_support")
    ).withColumn("confidence", F.lit("high")).withColumn("description", F.lit(None).cast("string"))


def nested_targets(support: DataFrame) -> DataFrame:
    """File nodes with their targets and fact ids as arrays, for readers who want documents.

    Arrays are as long as a file has references; keep to the long tables for joins.
    """
    targets = derived_targets(support).groupBy("derived_id", "repo", "type", "file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "target"))), lambda s: s["target"]).alias("targets")
    )
    facts = support.groupBy("derived_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact_id"))), lambda s: s["fact_id"]).alias("based_on")
    )
    return targets.join(facts, "derived_id")


def architecture_summary(facts: DataFrame, stack: DataFrame, incomplete: bool = False) -> DataFrame:
    """One summary per repo: frameworks by manifest or facts, counts, confidence."""
    kinds = {"components": "react_component", "express": "express_route", "pages": "next_page_route", "apis": "next_api_route"}
    flags = ("has_next", "has_express", "has_react")
    # One aggregate over both tables in place of an outer join, which a constant repo would turn into all pairs.
    both = facts.select("repo", "type").unionByName(stack.select("repo", "project", *flags), allowMissingColumns=True)
    rows = both.groupBy("repo").agg(
        F.max("project").alias("project"), *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()],
        *[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags],
    )
    has_next = F.col("has_next") | (F.col("pages") > 0) | (F.col("apis") > 0)
    has_express = F.col("has_express") | (F.col("express") > 0)
    has_react = (F.col("has_react") | (F.col("components") > 0)) & ~has_next
    frameworks = F.concat_ws(", ", F.when(has_next, "Next.js"), F.when(has_express, "Express"), F.when(has_react, "React"))
    prefix = F.when(F.col("project") != "", F.concat(F.lit('"'), F.col("project"), F.lit('" — '))).otherwise("")
    known = F.format_string(
        STACK_TEXT,
        F.coalesce(prefix, F.lit("")), frameworks, "components", "express", "pages", "apis",
    )
    unknown = F.format_string(
        NO_STACK_TEXT,
        F.coalesce(prefix, F.lit("")), "components",
    )
    tail = F.lit(PARTIAL_TEXT if incomplete else "")
    confidence = F.lit("low") if incomplete else F.when(frameworks != "", "high").otherwise("medium")
    return rows.select(
        content_id("derived", F.col("repo"), F.lit("architecture_summary"), F.lit(None)).alias("derived_id"),
        "repo", F.lit("architecture_summary").alias("type"), F.lit(None).cast("string").alias("file"),
        F.concat(F.when(frameworks != "", known).otherwise(unknown), tail).alias("description"),
        F.lit(0).cast("long").alias("n_targets"),
        (F.col("components") + F.col("express") + F.col("pages") + F.col("apis")).alias("n_support"),
        confidence.alias("confidence"), frameworks.alias("frameworks"), *kinds,
    )


def api_surface(facts: DataFrame) -> DataFrame:
    """Express and Next.js API routes in one list; the latter answer any method."""
    return facts.filter(F.col("type").isin("express_route", "next_api_route")).select(
        "repo", F.when(F.col("type") == "express_route", F.col("method")).otherwise("ANY").alias("method"),
        F.col("route_path").alias("path"), "file", F.col("id").alias("fact_id"), F.struct(*FACT_ORDER).alias("ord"),
    )


def component_index(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("type") == "react_component").select(
        "repo", "name", "file", "line", "kind", F.col("id").alias("fact_id"), F.struct(*FACT_ORDER).alias("ord")
    )


def _repo_node(support: DataFrame, kind: str, text: str, confidence: str) -> DataFrame:
    rows = support.filter(F.col("type") == kind)
    return rows.groupBy("derived_id", "repo", "type").agg(F.count(F.lit(1)).alias("n_support")).select(
        "derived_id", "repo", "type", F.lit(None).cast("string").alias("file"),
        F.format_string(text, "n_support").alias("description"), F.lit(0).cast("long").alias("n_targets"), "n_support",
        F.lit(confidence).alias("confidence"),
    )


NODE = ("derived_id", "repo", "type", "file", "description", "n_targets", "n_support", "confidence")


def incomplete_notice(repos: DataFrame) -> DataFrame:
    """A notice row for each repo whose scan was cut short."""
    return repos.select("repo").distinct().select(
        content_id("derived", F.col("repo"), F.lit("scan_incomplete_notice"), F.lit(None)).alias("derived_id"), "repo",
        F.lit("scan_incomplete_notice").alias("type"), F.lit(None).cast("string").alias("file"),
        F.lit(INCOMPLETE_TEXT).alias("description"),
        F.lit(0).cast("long").alias("n_targets"), F.lit(0).cast("long").alias("n_support"), F.lit("high").alias("confidence"),
    )


def derive_all(facts: DataFrame, stack: DataFrame, incomplete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, support) of a corpus."""
    support = derive_support(facts)
    per_file = file_nodes(support.filter(F.col("file").isNotNull())).select(*NODE)
    nodes = merge([
        architecture_summary(facts, stack, incomplete).select(*NODE),
        per_file,
        _repo_node(support, "api_surface", API_TEXT, "high"),
        _repo_node(support, "component_index", COMPONENT_TEXT, "medium"),
    ])
    if incomplete:
        nodes = nodes.unionByName(incomplete_notice(stack))
    return nodes, support
