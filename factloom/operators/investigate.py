"""Answering questions: keyword retrieval, hypotheses per file, confidence, ranking, triage.

All operators serve many questions at once. Questions carry the repo they ask about. Substring tests
between keywords and facts go through :func:`factloom.functions.matching.contains_join`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.matching import contains_join
from factloom.functions.runs import number_rows, top_per
from factloom.functions.text import DOC_FILE, SECONDARY_DIR, is_low_confidence, packed_id
from factloom.operators.derive import FACT_ORDER
from factloom.operators.meeting import meet_files
from factloom.session import cut_lineage

# Fixed values of retrieval and scoring.
BROAD_RATIO, BROAD_COUNT = 0.5, 20
OVERVIEW_MIN_CODE = 20
BASE_CONFIDENCE, CONFIDENCE_GAIN, HALF_SUPPORT, CONFIDENCE_CAP = 0.3, 0.6, 5, 0.95
CONFIRMED_FROM, SUCCESS_FROM = 0.8, 0.5
SECONDARY_KEYWORD = r"(?i)\A(tests?|specs?|fixtures?|mocks?|examples?|samples?|demos?|benchmarks?)"
#: So many facts of a word form, at most, meet its questions in one task.
FORM_HITS = 1024
#: Gives the retrieved rows that lie in ``files(objective_id, file)``.
Retrieval = Callable[[DataFrame], DataFrame]
_FACT = ("id", "repo", "type", "file", "name", *[c for c in FACT_ORDER if c != "file"])


def _joined(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns]))


def keyword_frequency(keywords: DataFrame, facts: DataFrame) -> DataFrame:
    """``(repo, keyword, n)``: how many facts of the repo mention a keyword in file, name, target or type."""
    texts = facts.select("repo", _joined("file", "name", "target", "type").alias("haystack"))
    # Equal texts are counted once and weighted, before any of them is cut into pieces.
    texts = texts.groupBy("repo", "haystack").agg(F.count(F.lit(1)).alias("weight"))
    terms = keywords.select("repo", F.col("keyword").alias("term")).distinct()
    hits = contains_join(texts, terms, on=["repo"])
    return hits.groupBy("repo", F.col("term").alias("keyword")).agg(F.sum("weight").alias("n"))


def rated_keywords(keywords: DataFrame, facts: DataFrame, ratio: float | None = BROAD_RATIO, least: int = BROAD_COUNT) -> DataFrame:
    """``objective_id, repo, pos, keyword, n, kept``: which keywords tell facts apart.

    Not kept are those that match ``ratio`` of all facts and at least ``least``; the rarest stays if
    none is left. Questions with a single keyword, and repos without facts, keep all; so does a
    ratio of None.
    """
    frequency = keyword_frequency(keywords, facts)
    totals = facts.groupBy("repo").agg(F.count(F.lit(1)).alias("n_facts"))
    sizes = keywords.groupBy("objective_id").agg(F.count(F.lit(1)).alias("n_keywords"))
    rows = (
        keywords.join(frequency, ["repo", "keyword"], "left")
        .join(totals, "repo", "left")
        .join(sizes, "objective_id")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    broad = (
        (F.col("n_keywords") > 1)
        & (F.coalesce("n_facts", F.lit(0)) > 0)
        & (F.col("n") / F.col("n_facts") >= F.lit(ratio))
        & (F.col("n") >= least)
    )
    rows = rows.withColumn("broad", F.coalesce(broad, F.lit(False)))
    rarest = rows.groupBy("objective_id").agg(
        F.bool_and("broad").alias("all_broad"), F.min_by("keyword", F.struct("n", "pos")).alias("rarest")
    )
    kept = ~F.col("broad") | (F.col("all_broad") & (F.col("keyword") == F.col("rarest")))
    return rows.join(rarest, "objective_id").select("objective_id", "repo", "pos", "keyword", "n", F.coalesce(kept, F.lit(True)).alias("kept"))


def discriminating_keywords(keywords: DataFrame, facts: DataFrame, ratio: float | None = BROAD_RATIO, least: int = BROAD_COUNT) -> DataFrame:
    """The keywords that :func:`rated_keywords` keeps; it also lists the others with their counts."""
    return rated_keywords(keywords, facts, ratio, least).filter("kept").drop("kept")


def variants(keyword: Column) -> Column:
    """A keyword with its simple word forms: -ing to -e, -er and the stem; plural to singular."""
    stem = F.regexp_extract(keyword, r"\A(.{4,})ing\z", 1)
    forms = F.array(
        keyword,
        F.when(stem != "", F.concat(stem, F.lit("e"))),
        F.when(stem != "", F.concat(stem, F.lit("er"))),
        F.when(F.length(stem) >= 5, stem),
        F.when((F.length(keyword) > 4) & keyword.endswith("s"), F.expr("substring(keyword, 1, length(keyword) - 1)")),
    )
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull()))


def expand_keywords(keywords: DataFrame) -> DataFrame:
    return keywords.select("objective_id", "repo", "keyword", F.explode(variants(F.col("keyword"))).alias("variant"))


def _mentions(keywords: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(which fact mentions which word form, with the fact's tier; which question asks which form).

    A word form of a repo is a number in both, ``form``.
    """
    texts = facts.select(
        "repo", "id", _tier().alias("tier"), _joined("file", "name", "target", "type", "callee", "caller").alias("haystack")
    )
    asked = expand_keywords(keywords).select("objective_id", "repo", "variant").distinct()
    terms = cut_lineage(asked.select("repo", F.col("variant").alias("term")).distinct().withColumn("form", F.monotonically_increasing_id()), "forms")
    hits = contains_join(texts, terms, on=["repo"]).select("id", "tier", "form")
    return hits, asked.join(terms.withColumnRenamed("term", "variant"), ["repo", "variant"]).select("objective_id", "form")


def _found(hits: DataFrame, asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of ``hits(id, form)`` whose id shares a form with a question of ``asked(objective_id, form)``, once per question.

    Of the forms that a fact and a question share, the first brings them together, so that pairs
    need no shuffle to become distinct. A form that many facts mention is dealt over several tasks.
    """
    hits = cut_lineage(hits.filter("id IS NOT NULL").distinct(), "hits")
    said = hits.groupBy("id").agg(F.collect_list("form").alias("_said"))
    rows = facts.select(*_FACT, "confidence").join(said, "id")
    return _meet(rows, hits, asked, "id").select("objective_id", *_FACT, "confidence")


def _meet(rows: DataFrame, hits: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``rows(key, _said, ...)`` beside each question that asks one of the forms in ``_said``, once per question."""
    parts = hits.groupBy("form").agg(F.ceil(F.count(F.lit(1)) / FORM_HITS).cast("int").alias("_parts"))
    rows = rows.withColumn("form", F.explode("_said")).join(parts, "form")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")
    asks = asked.join(parts, "form").groupBy("objective_id").agg(F.collect_set(F.struct("form", "_parts")).alias("_f"))
    asks = asks.select("objective_id", F.col("_f.form").alias("_asks"), F.explode("_f").alias("_f"))
    asks = asks.select("objective_id", "_asks", F.col("_f.form").alias("form"), F.explode(F.sequence(F.lit(0), F.col("_f._parts") - 1)).alias("_part"))
    # Both sides are few rows beside the pairs they make: a fixed number of partitions keeps the pairs in as many tasks.
    spread = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, asks = rows.repartition(spread, "form", "_part"), asks.repartition(spread, "form", "_part")
    return rows.join(asks, ["form", "_part"]).filter(F.array_min(F.array_intersect("_said", "_asks")) == F.col("form"))


def retrieve_raw(keywords: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that mention any form of any keyword, once per question."""
    hits, asked = _mentions(keywords, facts)
    return _found(hits.select("id", "form"), asked, facts).select("id", "objective_id", *_FACT[1:], "confidence")


def _told(hits: DataFrame, asked: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with the list of their forms, questions with theirs), written once, of :func:`_found`'s arguments."""
    said = hits.filter("id IS NOT NULL").distinct().groupBy("id").agg(F.collect_list("form").alias("_forms"))
    asks = asked.groupBy("objective_id").agg(F.collect_set("form").alias("_forms"))
    return cut_lineage(facts.select(*_FACT, "confidence").join(said, "id"), "said"), cut_lineage(asks, "asks")


def _tiered(keywords: DataFrame, hits: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hits`` and ``asked`` where a form in a tier is a form of its own, and a question asks for its tiers only."""
    asked = asked.join(_asked_tiers(keywords, hits, asked), "objective_id")
    tiered = (F.col("form") * 4 + F.col("tier")).alias("form")
    return hits.select("id", tiered), asked.select("objective_id", tiered)


def facts_of_files(files: DataFrame, said: DataFrame, asks: DataFrame, overview: DataFrame) -> DataFrame:
    """The rows of a retrieval that lie in ``files(objective_id, file)``, found again for these files only.

    ``said`` and ``asks`` are facts and questions with their forms, ``overview`` the rows that no form found.
    """
    wanted = files.select("objective_id", "file").distinct()
    met = wanted.join(asks.withColumnRenamed("_forms", "_asked"), "objective_id").join(said, "file").filter(F.arrays_overlap("_asked", "_forms"))
    columns = ["id", "objective_id", *_FACT[1:], "confidence"]
    return met.select(*columns).unionByName(overview.join(wanted, ["objective_id", "file"], "left_semi").select(*columns))


def _is_low(file: str = "file") -> Column:
    return (F.col("confidence") == "low") | is_low_confidence(F.col(file))


def _tier() -> Column:
    """1 = code, 2 = other primary sources, 3 = tests, examples and the like."""
    primary = ~_is_low() & ~F.col("file").rlike(SECONDARY_DIR)
    code = primary & ~F.col("file").rlike(DOC_FILE) & ~F.col("type").startswith("doc_")
    return F.when(code, 1).when(primary, 2).otherwise(3)


def _written_mentions(keywords: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`_mentions`, the facts written once for the steps that read them."""
    hits, asked = _mentions(keywords, facts)
    return cut_lineage(hits.distinct(), "hits"), asked


def _asked_tiers(keywords: DataFrame, hits: DataFrame, asked: DataFrame) -> DataFrame:
    """``objective_id, tier``: the best tier of a question's word forms; all three if it asks about tests or examples."""
    secondary = keywords.groupBy("objective_id").agg(F.bool_or(F.col("keyword").rlike(SECONDARY_KEYWORD)).alias("_all"))
    per_form = hits.groupBy("form").agg(F.min("tier").alias("form_tier"))
    best = asked.join(per_form, "form").groupBy("objective_id").agg(F.min("form_tier").alias("best"))
    tiers = F.when(F.col("_all"), F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array("best"))
    return best.join(secondary, "objective_id").select("objective_id", F.explode(tiers).alias("tier"))


def retrieve_tiered(keywords: DataFrame, facts: DataFrame, mentions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Code before other primary sources before everything; questions about tests or examples get all.

    The best tier of a question follows from the best tier of its word forms, so it is known before
    any (question, fact) pair exists, and pairs of other tiers are never shuffled.
    """
    found = _found(*_tiered(keywords, *(mentions or _written_mentions(keywords, facts))), facts)
    return found.select("id", "objective_id", *_FACT[1:], "confidence")


def retrieve_overview(intents: DataFrame, facts: DataFrame) -> DataFrame:
    """For broad questions: code facts that are no calls, documents or tests; config only if code is scarce."""
    base = facts.filter((F.col("type") != "function_call") & ~F.col("type").startswith("doc_") & ~_is_low())
    is_config = F.col("type") == "config_key"
    enough = base.groupBy("repo").agg((F.count_if(~is_config) >= OVERVIEW_MIN_CODE).alias("_enough"))
    kept = base.join(enough, "repo").filter(~(is_config & F.col("_enough"))).select(*_FACT, "confidence")
    return intents.select("objective_id", "repo").join(kept, "repo")


def _overview(intents: DataFrame, keywords: DataFrame, facts: DataFrame) -> DataFrame:
    """What overview questions without a usable keyword get."""
    with_words = keywords.select("objective_id").distinct()
    broad = intents.filter(F.col("task_type") == "architecture-overview").join(with_words, "objective_id", "left_anti")
    return retrieve_overview(broad, facts)


def retrieve(intents: DataFrame, keywords: DataFrame, facts: DataFrame, mentions: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Tiered retrieval, or the overview for overview questions without a usable keyword."""
    return retrieve_tiered(keywords, facts, mentions).unionByName(_overview(intents, keywords, facts))


def unknown_terms(
    keywords: DataFrame, retrieved: DataFrame, facts: DataFrame | None = None, mentions: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Keywords that no retrieved file or name mentions.

    Where :func:`retrieve` took ``retrieved`` from ``facts`` by the same keywords, give ``facts``: a fact whose
    file or name mentions a keyword is then retrieved by the questions that ask for its tier, and no
    pair of question and fact is read. Otherwise each fact is searched once, however many questions
    retrieved it.
    """
    terms = keywords.select("repo", F.col("keyword").alias("term")).distinct()
    haystack = F.lower(F.concat_ws("\u0001", "file", "name")).alias("haystack")
    if facts is None:
        texts = retrieved.select("repo", "id", haystack).distinct()
        hits = contains_join(texts, terms, on=["repo"]).select("repo", "id", F.col("term").alias("keyword"))
        asked = keywords.select("objective_id", "repo", "keyword").join(hits, ["repo", "keyword"])
        known = asked.join(retrieved.select("objective_id", "id"), ["objective_id", "id"], "left_semi")
    else:
        texts = facts.filter("id IS NOT NULL").select("repo", _tier().alias("tier"), haystack).distinct()
        hits = contains_join(texts, terms, on=["repo"]).select("repo", "tier", F.col("term").alias("keyword")).distinct()
        tiers = _asked_tiers(keywords, *(mentions or _written_mentions(keywords, facts)))
        known = keywords.select("objective_id", "repo", "keyword").join(tiers, "objective_id").join(hits, ["repo", "tier", "keyword"])
    return keywords.join(known.select("objective_id", "keyword").distinct(), ["objective_id", "keyword"], "left_anti").select(
        "objective_id", "repo", "pos", "keyword"
    )


def widen_retrieval(keywords: DataFrame, unknowns: DataFrame, retrieved: DataFrame, facts: DataFrame, overview: DataFrame | None = None) -> DataFrame:
    """Everything retrieved before plus untiered retrieval over keywords and unknown terms.

    ``overview`` are the rows of ``retrieved`` that no keyword found. Where :func:`retrieve` took the others
    from ``facts`` by the same keywords, untiered retrieval finds them again, and no pair is shuffled.
    """
    words = _all_words(keywords, unknowns)
    if overview is None:
        return retrieved.unionByName(retrieve_raw(words, facts).select(*retrieved.columns)).dropDuplicates(["objective_id", "id"])
    once, hits, asked, beyond = _widened(words, facts, overview)
    return _found(hits, asked, once).unionByName(beyond).select(*retrieved.columns)


def _all_words(keywords: DataFrame, unknowns: DataFrame) -> DataFrame:
    return keywords.select("objective_id", "repo", "keyword").unionByName(unknowns.select("objective_id", "repo", "keyword")).distinct()


def _widened(words: DataFrame, facts: DataFrame, overview: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What untiered retrieval by ``words`` meets: facts without repeats, their forms, the questions' forms, and overview rows that no form finds."""
    once = facts.select(*_FACT, "confidence", "target", "callee", "caller").dropDuplicates(["id"])
    hits, asked = _mentions(words, once)
    beyond = overview.join(words.select("objective_id").distinct(), "objective_id", "left_anti").dropDuplicates(["objective_id", "id"])
    return once, hits.select("id", "form"), asked, beyond


def relevant_memory(keywords: DataFrame, rules: DataFrame) -> DataFrame:
    """Approved rules that mention a keyword of the question."""
    texts = rules.filter(F.col("status") == "approved").select("repo", F.col("id").alias("rule_id"), F.lower("rule").alias("haystack"))
    asked = keywords.select("objective_id", "repo", F.col("keyword").alias("term")).distinct()
    terms = cut_lineage(asked.select("repo", "term").distinct().withColumn("form", F.monotonically_increasing_id()), "forms")
    # A rule is searched once for each keyword, however many questions share it.
    hits = cut_lineage(contains_join(texts, terms, on=["repo"]).select("repo", "rule_id", "form").distinct(), "hits")
    said = hits.groupBy("repo", "rule_id").agg(F.collect_list("form").alias("_said"))
    return _meet(said, hits, asked.join(terms, ["repo", "term"]).select("objective_id", "form"), "rule_id").select("objective_id", "repo", "rule_id")


# --- hypotheses ----------------------------------------------------------------------------------

def form_hypotheses(retrieved: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """One hypothesis per question and file: facts, how many drifted, first place in scan order.

    ``verified(id, status)`` comes from a drift check; without it all facts count as confirmed.
    """
    return _with_drift(retrieved, verified).groupBy("objective_id", "repo", "file").agg(
        F.count(F.lit(1)).alias("n_facts"), F.sum("_drifted").alias("n_drifted"), F.min(F.struct(*FACT_ORDER)).alias("first_seq")
    )


def _with_drift(rows: DataFrame, verified: DataFrame | None) -> DataFrame:
    if verified is None:
        return rows.withColumn("_drifted", F.lit(0))
    drift = verified.filter(F.col("status").isin("stale", "file_missing", "line_gone")).select(packed_id(F.col("id")).alias("_fact")).distinct()
    rows = rows.withColumn("_fact", packed_id(F.col("id"))).join(drift.withColumn("_drifted", F.lit(1)), "_fact", "left")
    return rows.withColumn("_drifted", F.coalesce("_drifted", F.lit(0)))


def meet_hypotheses(said: DataFrame, asks: DataFrame, overview: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """:func:`form_hypotheses` of a retrieval by word forms, without its pairs of questions and facts.

    The arguments are those of :func:`facts_of_files`; only the rows of ``overview`` are pairs.
    """
    if verified is not None:
        said = cut_lineage(_with_drift(said, verified).select(*said.columns, "_drifted"), "said")
    else:
        said = said.withColumn("_drifted", F.lit(0))
    return meet_files(said, asks).unionByName(form_hypotheses(overview, verified))


def score_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Confidence and status: one drifted fact eliminates, confirmed facts raise with diminishing gain."""
    n = F.col("n_facts")
    support = F.least(F.lit(CONFIDENCE_CAP), BASE_CONFIDENCE + CONFIDENCE_GAIN * (n / (n + HALF_SUPPORT)))
    confidence = F.when(F.col("n_drifted") > 0, F.lit(0.0)).otherwise(support)
    return hypotheses.withColumn("confidence", confidence).withColumn(
        "status",
        F.when(F.col("n_drifted") > 0, "eliminated").when(F.col("confidence") >= CONFIRMED_FROM, "confirmed").otherwise("supported"),
    )


def hypothesis_order() -> Column:
    """Sort key of hypotheses within a question: best first, ties in scan order."""
    return F.struct((-F.col("confidence")).alias("minus"), F.col("first_seq").alias("seq"))


def rank_hypotheses(scored: DataFrame) -> DataFrame:
    """Rank of every hypothesis in its question. Files with equal support are cut by path."""
    runs = [-F.col("confidence"), F.col("first_seq.ext_ord"), F.substring("file", 1, 20)]
    return number_rows(scored, ["objective_id"], runs, [F.col("first_seq")], "rank")


def top_hypotheses(scored: DataFrame, k: int) -> DataFrame:
    return top_per(scored, ["objective_id"], [-F.col("confidence"), F.col("first_seq")], k, "rank")


@dataclass(frozen=True)
class TriagePolicy:
    """When a quick answer is not good enough."""

    min_confidence: float = 0.6
    max_gap: float = 0.15
    deep_tasks: tuple[str, ...] = field(default=("bug-investigation",))
    deep_floor: float = 0.85


def triage(intents: DataFrame, scored: DataFrame, unknowns: DataFrame, policy: TriagePolicy = TriagePolicy()) -> DataFrame:
    """Deep or shallow per question with the signals behind it and the reasons as codes.

    Codes: ``no_hypotheses``, ``ambiguous``, ``unknown_terms``, ``causal_task``, ``low_confidence``.
    """
    best = top_hypotheses(scored, 2).groupBy("objective_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("top_confidence"),
        F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second_confidence"),
    )
    counts = scored.groupBy("objective_id").agg(F.count(F.lit(1)).alias("n_hypotheses"), F.sum("n_facts").alias("n_facts"))
    open_terms = unknowns.groupBy("objective_id").agg(F.count(F.lit(1)).alias("n_unknown"))
    rows = intents.select("objective_id", "task_type").join(best, "objective_id", "left").join(counts, "objective_id", "left").join(
        open_terms, "objective_id", "left"
    )
    for name in ("n_hypotheses", "n_facts", "n_unknown"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    top = F.coalesce("top_confidence", F.lit(0.0))
    gap = F.when(F.col("n_hypotheses") > 1, top - F.coalesce("second_confidence", F.lit(0.0)))
    none = F.col("n_hypotheses") == 0
    reasons = F.when(none, F.array(F.lit("no_hypotheses"))).otherwise(
        F.filter(
            F.array(
                F.when(gap < policy.max_gap, "ambiguous"),
                F.when(F.col("n_unknown") > 0, "unknown_terms"),
                F.when(F.col("task_type").isin(*policy.deep_tasks) & (top < policy.deep_floor), "causal_task"),
                F.when(top < policy.min_confidence, "low_confidence"),
            ),
            lambda r: r.isNotNull(),
        )
    )
    return rows.select(
        "objective_id", "task_type", "n_hypotheses", "n_facts", "n_unknown", top.alias("confidence"), gap.alias("confidence_gap"),
        F.when(F.size(reasons) > 0, "deep").otherwise("shallow").alias("mode"), none.alias("uncertain"), reasons.alias("reasons"),
    )


def outcome_of_run(scored: DataFrame, intents: DataFrame) -> DataFrame:
    """success where the best hypothesis reaches 0.5."""
    best = scored.groupBy("objective_id").agg(F.max("confidence").alias("best"))
    return intents.select("objective_id").join(best, "objective_id", "left").select(
        "objective_id", F.when(F.col("best") >= SUCCESS_FROM, "success").otherwise("failure").alias("outcome")
    )


# --- facts for a problem -------------------------------------------------------------------------

# Words of a problem statement that are no search terms.
PROBLEM_STOP_WORDS = (
    "the", "and", "for", "not", "but", "with", "this", "that", "when", "why", "how", "what", "from", "into",
    "are", "was", "has", "have", "does", "doesnt", "fails", "failing", "error", "bug", "issue", "problem",
    "broken", "works", "working",
)
PICK_CAP = 40


def problem_keywords(problems: DataFrame) -> DataFrame:
    """``(problem_id, repo, keyword)`` of ``problems(problem_id, repo, text)``."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z_][a-z0-9_./-]{2,})"), F.lit(1)))
    stop = F.array(*[F.lit(w) for w in PROBLEM_STOP_WORDS])
    return problems.select("problem_id", "repo", F.explode(F.array_except(found, stop)).alias("keyword"))


def pick_facts(facts: DataFrame, problems: DataFrame, cap: int = PICK_CAP) -> DataFrame:
    """The ``cap`` facts per problem that mention most of its keywords; documents are left out."""
    blank = [F.coalesce(c, F.lit("")) for c in ("file", "entity", "callee", "target", "route_path")]
    texts = facts.filter(~F.col("type").startswith("doc")).select(
        "id", "repo", *FACT_ORDER, F.lower(F.concat_ws(" ", *blank)).alias("haystack")
    )
    words = problem_keywords(problems)
    terms = words.select("repo", F.col("keyword").alias("term")).distinct()
    hits = contains_join(texts, terms, on=["repo"]).drop("haystack").withColumnRenamed("term", "keyword")
    scored = hits.join(words, ["repo", "keyword"]).groupBy("problem_id", "id").agg(
        F.count(F.lit(1)).alias("score"), F.first("repo").alias("repo"), F.first(F.struct(*FACT_ORDER)).alias("seq")
    )
    return top_per(scored, ["problem_id"], [-F.col("score"), F.col("seq"), F.col("id")], cap, "rank").select(
        "problem_id", "repo", F.col("id").alias("fact_id"), "score", "rank"
    )


def first_citations(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Distinct fact ids per key in order of first mention, at most ``cap``: ``rows(keys, ord, fact_id)``."""
    firsts = rows.groupBy(*keys, "fact_id").agg(F.min("ord").alias("ord"))
    return top_per(firsts, keys, [F.col("ord"), F.col("fact_id")], cap, "rank")


EXPLAIN_CAP, DEEP_CAP = 40, 60


def collect_evidence(insight_refs: DataFrame, cap: int = EXPLAIN_CAP) -> DataFrame:
    """Facts cited by the insights of a question, in insight order."""
    rows = insight_refs.select("objective_id", F.struct(F.col("rank").alias("a"), F.col("ref").alias("b")).alias("ord"), "fact_id")
    return first_citations(rows, ["objective_id"], cap)


def collect_deep_facts(ranked: DataFrame, retrieved: DataFrame | Retrieval, cap: int = DEEP_CAP) -> DataFrame:
    """Facts of the hypotheses of a question, in hypothesis order.

    The first ``cap`` hypotheses hold at least ``cap`` facts, so later ones cannot contribute.
    """
    best = ranked.filter(F.col("rank") <= cap).select("objective_id", "file", "rank")
    if callable(retrieved):
        best = cut_lineage(best, "best")
        retrieved = retrieved(best)
    rows = retrieved.join(best, ["objective_id", "file"]).select(
        "objective_id", F.struct(F.col("rank").alias("a"), F.struct(*FACT_ORDER).alias("b")).alias("ord"), F.col("id").alias("fact_id")
    )
    return first_citations(rows, ["objective_id"], cap)


def answer_tables(
    objectives: DataFrame, facts: DataFrame, verified: DataFrame | None = None, store: bool | tuple[str, ...] = False
) -> dict[str, DataFrame]:
    """All intermediate tables of an investigation, by name.

    Keywords are written once, as every step reads them. ``store`` does the same with retrieved facts
    and hypotheses, or with those of the two that it names; take it where several of the tables are
    used, since each of them would otherwise repeat the retrieval.
    """
    from factloom.operators.intent import keywords as split_keywords
    from factloom.operators.intent import parse_intent

    intents = parse_intent(objectives)
    words = cut_lineage(discriminating_keywords(split_keywords(intents), facts), "keywords")
    mentions = _written_mentions(words, facts)
    found = retrieve(intents, words, facts, mentions)
    stored = store if isinstance(store, tuple) else ("retrieved", "hypotheses") if store else ()
    overview = _overview(intents, words, facts)
    if "retrieved" in stored:
        found = cut_lineage(found, "retrieved")
    unknown = unknown_terms(words, found, facts, mentions)
    told = _told(*_tiered(words, *mentions), facts)
    scored = score_hypotheses(meet_hypotheses(*told, overview, verified))
    if "hypotheses" in stored:
        scored = cut_lineage(scored, "hypotheses", compression="zstd")
    return {
        "intents": intents, "keywords": words, "retrieved": found, "overview": overview, "unknowns": unknown, "hypotheses": scored,
        "triage": triage(intents, scored, unknown), "retrieved_of": lambda files: facts_of_files(files, *told, overview),
    }


def deepen(tables: dict[str, DataFrame], facts: DataFrame, verified: DataFrame | None = None) -> dict[str, DataFrame]:
    """A second, wider round for the questions that triage calls deep, and only for those.

    ``tables`` are those of :func:`answer_tables`. Gives ``deep`` (the questions), ``retrieved`` (not written)
    and ``hypotheses`` of the wider round, and ``facts``, what these hypotheses rest on in their order.
    """
    deep = cut_lineage(tables["triage"].filter(F.col("mode") == "deep").select("objective_id"), "deep")
    of = {name: tables[name].join(deep, "objective_id", "left_semi") for name in ("keywords", "unknowns", "retrieved", "overview")}
    found = widen_retrieval(of["keywords"], of["unknowns"], of["retrieved"], facts, of["overview"])
    once, hits, asked, beyond = _widened(_all_words(of["keywords"], of["unknowns"]), facts, of["overview"])
    told = _told(hits, asked, once)
    scored = cut_lineage(score_hypotheses(meet_hypotheses(*told, beyond, verified)), "hypotheses", compression="zstd")
    lookup = lambda files: facts_of_files(files, *told, beyond)
    return {"deep": deep, "retrieved": found, "hypotheses": scored, "facts": collect_deep_facts(top_hypotheses(scored, DEEP_CAP), lookup)}
