"""Answer: questions -> ranked, cited, budgeted insights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import estimate_tokens
from factloom.operators import investigate as inv
from factloom.operators import synthesis as syn
from factloom.operators.budget import MAX_TOKENS, fit_budget
from factloom.session import cut_lineage


@dataclass(frozen=True)
class Answer:
    intents: DataFrame
    keywords: DataFrame
    retrieved: DataFrame
    unknowns: DataFrame
    hypotheses: DataFrame
    triage: DataFrame
    insights: DataFrame
    totals: DataFrame
    citations: DataFrame
    budget: DataFrame
    deep_retrieved: DataFrame
    deep_hypotheses: DataFrame
    deep_facts: DataFrame


def answer(objectives: DataFrame, facts: DataFrame, verified: DataFrame | None = None, rules: DataFrame | None = None,
           max_tokens: int = MAX_TOKENS) -> Answer:
    """Run the whole investigation for ``objectives(objective_id, repo, text)``.

    Questions that triage calls deep get a second round of retrieval; its hypotheses take the place
    of the first ones in the budget, and the facts they rest on are its section ``facts``.
    """
    t = inv.answer_tables(objectives, facts, verified, store=True)
    insights, totals = syn.top_insights(t["hypotheses"], t["intents"])
    insights = cut_lineage(syn.insight_reasons(insights, t["retrieved"], facts), "insights")
    refs = syn.insight_references(insights, t["hypotheses"], t["retrieved"], t["intents"])
    citations = syn.attach_citations(refs, facts)
    second = inv.deepen(t, facts, verified)
    first = t["hypotheses"].join(second["deep"], "objective_id", "left_anti")
    ranked = inv.rank_hypotheses(first.unionByName(second["hypotheses"])).join(t["intents"].select("objective_id", "task_type"), "objective_id")
    items = section_items("hypotheses", ranked, F.to_json(F.struct("file", "task_type", "status", "confidence")), F.col("rank"))
    items = items.unionByName(section_items("unknowns", t["unknowns"], F.col("keyword"), F.col("pos") + 1))
    items = items.unionByName(
        section_items("insights", insights, F.to_json(F.struct("rank", "area", "insight", "why_it_matters", "confidence")), F.col("rank"))
    )
    cited = second["facts"].join(facts.select(F.col("id").alias("fact_id"), "file", "line", "evidence"), "fact_id")
    items = items.unionByName(section_items("facts", cited, F.to_json(F.struct("file", "line", "evidence")), F.col("rank")))
    if rules is not None:
        hits = inv.relevant_memory(t["keywords"], rules).join(rules.select(F.col("id").alias("rule_id"), "rule"), "rule_id")
        # Rules are served in id order; their number per question is small, their order only matters for the cut.
        items = items.unionByName(
            section_items("memory", inv.number_rows(hits, ["objective_id"], [F.substring("rule_id", 1, 8)], [F.col("rule_id")], "pos"), F.col("rule"), F.col("pos"))
        )
    counts = t["retrieved"].groupBy("objective_id").agg(F.count(F.lit(1)).alias("n"))
    words = t["keywords"].groupBy("objective_id").agg(F.to_json(F.array_sort(F.collect_set("keyword"))).alias("words"))
    base = (
        t["intents"].select("objective_id", "text").join(words, "objective_id", "left").join(counts, "objective_id", "left")
        .select(
            "objective_id",
            (estimate_tokens(F.col("text")) + estimate_tokens(F.coalesce("words", F.lit("[]"))) + estimate_tokens(F.coalesce("n", F.lit(0)).cast("string"))).alias("used"),
        )
    )
    _, report = fit_budget(base, items, max_tokens)
    return Answer(t["intents"], t["keywords"], t["retrieved"], t["unknowns"], t["hypotheses"], t["triage"], insights, totals, citations, report, second["retrieved"], second["hypotheses"], second["facts"])


def section_items(section: str, rows: DataFrame, text, pos) -> DataFrame:
    """Budget items of one section: cost = tokens of its text."""
    return rows.select("objective_id", F.lit(section).alias("section"), pos.cast("long").alias("pos"), estimate_tokens(text).alias("cost"))
