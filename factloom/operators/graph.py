"""Questions to the evidence tables: search, explain, dependencies, impact. Each serves many
queries at once, given as a DataFrame."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.matching import contains_join
from factloom.functions.runs import first_per, top_per
from factloom.functions.text import is_test_file, packed_id, resolve_target, strip_extension, unpacked_id
from factloom.operators.derive import FACT_ORDER, node_id
from factloom.session import cut_lineage

SEARCH_CAP = 50
EXCERPT_RADIUS = 3


def overview(nodes: DataFrame, meta: DataFrame) -> DataFrame:
    """Summary and scan figures of each repo."""
    summary = nodes.filter(F.col("type") == "architecture_summary").select("repo", "derived_id", "description", "confidence")
    return meta.join(summary, "repo", "left")


def list_components(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("type") == "react_component").select("repo", "name", "file", "line", "kind")


def list_routes(facts: DataFrame) -> DataFrame:
    """API routes (with method) and page routes in one list."""
    kind = F.col("type")
    return facts.filter(kind.isin("express_route", "next_api_route", "next_page_route")).select(
        "repo", F.when(kind == "next_page_route", "page").otherwise("api").alias("surface"),
        F.when(kind == "express_route", F.col("method")).when(kind == "next_api_route", "ANY").alias("method"),
        F.col("route_path").alias("path"), "file",
    )


def _haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws("\u0001", *columns))


def search(facts: DataFrame, queries: DataFrame, cap: int = SEARCH_CAP) -> tuple[DataFrame, DataFrame]:
    """Case-insensitive substring search for ``queries(query_id, query)``.

    Returns (first ``cap`` hits per query in scan order, total hits per query).
    """
    texts = facts.select(
        *[F.col(c) for c in ("id", "repo", "type", *FACT_ORDER)],
        _haystack("name", "file", "route_path", "target", "callee", "caller").alias("haystack"),
    )
    terms = queries.select("query_id", F.lower("query").alias("term"))
    hits = contains_join(texts, terms, short_terms=True).drop("haystack", "term")
    totals = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    shown = top_per(hits, ["query_id"], [F.col(c) for c in (*FACT_ORDER, "id")], cap, "rank")
    return shown, queries.select("query_id").distinct().join(totals, "query_id", "left").withColumn(
        "total", F.coalesce("total", F.lit(0))
    )


def explain(ids: DataFrame, facts: DataFrame, support: DataFrame) -> DataFrame:
    """Evidence of each id of ``ids(id)``: the fact itself, the facts of a derived node, or not found."""
    # A null id is asked for like any other and never found; with a key that is never null both readers share its shuffle.
    unknown = F.struct(F.lit("\0").alias("head"), F.lit(None).cast("binary").alias("tail"))
    wanted = ids.select(F.coalesce(packed_id(F.col("id")), unknown).alias("_key")).distinct()
    shown = [F.col(c) for c in ("type", "file", "line", "evidence")]
    keyed = facts.filter(F.col("id").isNotNull()).select(packed_id(F.col("id")).alias("_fact"), *shown, F.struct(*FACT_ORDER).alias("ord"))
    refs = support.filter(F.col("derived_id").isNotNull() & F.col("fact_id").isNotNull()).select(
        packed_id(F.col("derived_id")).alias("_key"), packed_id(F.col("fact_id")).alias("_fact"), "ord"
    )
    chain = wanted.join(refs, "_key").join(keyed.drop("ord"), "_fact")
    derived = chain.select("_key", F.lit("derived").alias("kind"), "_fact", *shown, "ord")
    explained = chain.select("_key").distinct().withColumn("_derived", F.lit(True))
    # An id without a fact of its own stays as not found, unless it is a node of some fact.
    direct = wanted.join(keyed, F.col("_key") == F.col("_fact"), "left").join(explained, "_key", "left")
    direct = direct.filter(F.col("_fact").isNotNull() | F.col("_derived").isNull())
    kind = F.when(F.col("_fact").isNotNull(), "fact").otherwise("not_found").alias("kind")
    found = direct.select("_key", kind, "_fact", *shown, "ord").unionByName(derived)
    asked = F.when(F.col("_key") != unknown, unpacked_id(F.col("_key")))
    return found.select(asked.alias("id"), "kind", unpacked_id(F.col("_fact")).alias("fact_id"), *shown, "ord")


def file_dependencies(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Recorded relative imports of each asked ``(repo, file)``; a null target where there are none."""
    own = targets.filter(F.col("type") == "file_dependency").select("repo", "file", "target", "first")
    return files.select("repo", "file").distinct().join(own, ["repo", "file"], "left")


# --- impact --------------------------------------------------------------------------------------

def dependency_edges(support: DataFrame) -> DataFrame:
    """One row per (node, resolved target): who refers to what, compared without extensions.

    Where several spellings of one target occur in a node, the first is kept. A node's id follows from
    its kind and file, so it is made after the shuffle, and only if it is read.
    """
    via = F.col("type")
    rows = support.filter(via.isin("file_dependency", "shell_dependency", "doc_reference")).select(
        "repo", "file", via.alias("via"), "target", "ord",
        strip_extension(resolve_target(F.col("file"), F.col("target"), via)).alias("target_key"),
    )
    edges = rows.groupBy("repo", "file", "via", "target_key").agg(F.min_by("target", "ord").alias("raw_target"))
    return edges.select("repo", node_id(F.col("via"), F.col("file")).alias("derived_id"), "file", "via", "target_key", "raw_target")


def impact(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Dependents of each ``targets(repo, target)``: ``(repo, target, file, via, raw_target, derived_id)``."""
    asked = targets.select("repo", "target").distinct().withColumn("target_key", strip_extension(F.col("target")))
    return asked.join(edges, ["repo", "target_key"]).select("repo", "target", "file", "via", "raw_target", "derived_id")


def impact_counts(edges: DataFrame) -> DataFrame:
    """How many files depend on each target, for all targets at once; no join needed."""
    return edges.groupBy("repo", "target_key").agg(
        F.count_distinct("file").alias("n_dependents"), F.count_if(is_test_file(F.col("file"))).alias("n_tests")
    )


def transitive_impact(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Dependents over any number of hops with their smallest depth: ``(repo, target, file, depth, cut)``.

    Each round joins the newest pairs only and drops pairs known before; the lineage is cut after
    every round, and the loop ends once a round brings nothing new. With ``max_depth`` it ends there,
    and ``cut`` says of each target whether dependents further away were left out.
    """
    links = cut_lineage(edges.select("repo", F.col("target_key").alias("at"), "file").distinct(), "links")
    frontier = targets.select("repo", "target").distinct().withColumn("at", strip_extension(F.col("target")))
    known = more = None
    for depth in count(1):
        reached = (
            frontier.select("repo", "target", "at").join(links, ["repo", "at"]).select("repo", "target", "file").distinct()
        )
        if known is not None:
            reached = reached.join(known, ["repo", "target", "file"], "left_anti")
        if max_depth is not None and depth > max_depth:
            more = reached.select("repo", "target").distinct().withColumn("cut", F.lit(True))
            break
        reached = cut_lineage(reached.withColumn("depth", F.lit(depth)))
        if reached.isEmpty():
            break
        known = reached if known is None else known.unionByName(reached)
        frontier = reached.withColumn("at", strip_extension(F.col("file")))
    if known is None:
        known = reached
    if more is None:
        return known.withColumn("cut", F.lit(False))
    return known.join(more, ["repo", "target"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def source_excerpt(facts: DataFrame, lines: DataFrame, radius: int = EXCERPT_RADIUS) -> DataFrame:
    """The lines around each fact (of line ``at``), the hit marked: a range join as an equi-join.

    Each fact asks for its ``2 * radius + 1`` line numbers, so the join key is (repo, file, line
    number) and a long file spreads over tasks.
    """
    asked = facts.filter(F.col("line").isNotNull()).select(
        "repo", "file", F.col("id").alias("fact_id"), F.col("line").alias("at"),
        F.explode(F.sequence(F.col("line") - radius, F.col("line") + radius)).alias("ln"),
    ).filter(F.col("ln") >= 1)
    return asked.join(lines.select("repo", "file", F.col("ln").cast("long").alias("ln"), "line"), ["repo", "file", "ln"]).select(
        "repo", "file", "fact_id", "at", "ln", (F.col("ln") == F.col("at")).alias("hit"), "line"
    )


def first_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """First fact of each key in scan order."""
    return first_per(facts, keys, [*FACT_ORDER, "id"])
