"""Reading a question: what kind it is, what it names, how the answer should look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that instruct rather than name something.
INSTRUCTION_WORDS = (
    "analyze", "analysis", "explain", "identify", "give", "cite", "list", "show", "describe", "summarize",
    "insight", "insights", "evidence", "confidence", "architectural", "architecture", "dependency",
    "dependencies", "hotspot", "hotspots", "component", "components", "relate", "relates", "relationship",
    "exactly", "major", "important", "using", "graph", "matters", "top", "overview", "takeaway", "takeaways",
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "fail", "fails", "failing", "failed", "failure", "failures", "broken", "crash", "crashes", "bug", "bugs",
    "wrong", "working",
)
# Filler words.
STOP_WORDS = (
    "how", "does", "do", "did", "work", "works", "working", "what", "why", "where", "which", "who", "when",
    "is", "are", "can", "could", "should", "explain", "tell", "show", "me", "about", "the", "this", "that",
    "with", "for", "and", "a", "an", "in", "on", "of", "to", "it", "its", "each", "not", "will", "has", "have",
    "was", "were", "from", "into", "there", "but", "any", "all", "our", "you", "your", "would", "doesn", "isn",
    "don", "won", "cant",
)
# Task types, first match wins; generic requests come last.
TASK_PATTERNS = (
    ("architecture-overview", r"(?i)architect\w*|major component|how.*relate"),
    ("dependency-trace", r"(?i)depend(s|ency|encies)? on|what uses|impact of"),
    ("hotspot-analysis", r"(?i)hotspot|risk(iest)?|complexity"),
    ("bug-investigation", r"(?i)why does|fails?|broken|error"),
    ("architecture-overview", r"(?i)(?<!\w)(insights?|overview|takeaways?)(?!\w)"),
)
DEFAULT_TASK = "entity-lookup"
# Number words and what they may count.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
_COUNT = (
    r"(?i)(?<!\w)(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:[a-z-]+\s+){0,2}?"
    r"(?:insights?|findings?|hypothes[ei]s|areas?|components?|modules?|issues?|risks?|takeaways?|points?)(?!\w)"
)


# How a question states limits on its answer, and what its names may be made of.
EXACT_COUNT = r"(?i)exactly (\d+)"
MAX_WORDS = r"(?i)(?:under|max(?:imum)?)\s+(\d+)\s+words?"
MAX_EVIDENCE = r"(?i)max(?:imum)?\s+(\d+)\s+evidence"
NO_ENUMERATION = r"(?i)no file enumeration"
NOT_IN_NAMES, NAME_EDGES = r"[^a-z0-9_./-]+", r"\A[._-]+|[._-]+\z"


def task_type(text: Column) -> Column:
    chain = None
    for name, pattern in TASK_PATTERNS:
        chain = F.when(text.rlike(pattern), name) if chain is None else chain.when(text.rlike(pattern), name)
    return chain.otherwise(DEFAULT_TASK)


def entities(text: Column) -> Column:
    """Distinct names in the question, in order."""
    plain = F.regexp_replace(F.lower(text), NOT_IN_NAMES, " ")
    words = F.transform(F.split(plain, " "), lambda w: F.regexp_replace(w, NAME_EDGES, ""))
    kept = F.filter(words, lambda w: F.length(w) > 2)
    unwanted = F.array(*[F.lit(w) for w in (*INSTRUCTION_WORDS, *STOP_WORDS)])
    return F.array_except(kept, unwanted)


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def constraints(text: Column) -> dict[str, Column]:
    exact = F.nullif(_number(text, EXACT_COUNT), F.lit(0))
    word = F.lower(F.regexp_extract(text, _COUNT, 1))
    named = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), word).cast("int")
    counted = F.when(word.rlike(r"\A\d+\z"), word.try_cast("int")).otherwise(named)
    return {
        "exact_count": F.coalesce(exact, F.when(counted > 0, counted)),
        "max_words": _number(text, MAX_WORDS),
        "max_evidence": _number(text, MAX_EVIDENCE),
        "no_file_enumeration": text.rlike(NO_ENUMERATION),
    }


def parse_intent(objectives: DataFrame) -> DataFrame:
    """Add task type, entities and output constraints to ``objectives(objective_id, repo, text)``."""
    text = F.col("text")
    return objectives.select(
        "*", task_type(text).alias("task_type"), entities(text).alias("entities"),
        *[c.alias(n) for n, c in constraints(text).items()],
    )


def keywords(intents: DataFrame) -> DataFrame:
    """``(objective_id, repo, pos, keyword)``, one row per entity."""
    return intents.select("objective_id", "repo", F.posexplode("entities").alias("pos", "keyword"))
