"""Holding written statements to the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.runs import top_per
from factloom.functions.text import is_test_file, squeeze, strip
from factloom.operators.graph import impact

# Names under which a reply may carry its citations, in order of preference.
CITE_FIELDS = ("cites", "cite", "citations", "citation", "evidence", "ids")


def parse_statements(replies: DataFrame) -> DataFrame:
    """``replies(reply_id, text)`` -> ``(reply_id, pos, text, cites, quote)``.

    Text around the outermost braces and code fences is ignored; a reply without a statements list
    gives one row with ``error``.
    """
    bare = F.regexp_replace("text", r"(?i)```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    doc = replies.select("reply_id", F.try_parse_json(body).alias("doc"))
    listed = doc.withColumn("items", F.try_variant_get("doc", "$.statements", "array<variant>"))
    broken = listed.filter(F.col("items").isNull()).select("reply_id", F.lit("no statements list").alias("error"))
    items = listed.filter(F.col("items").isNotNull()).select("reply_id", F.posexplode("items").alias("pos", "s"))
    cites = F.coalesce(
        *[
            F.coalesce(
                F.try_variant_get("s", f"$.{name}", "array<string>"),
                F.when(F.try_variant_get("s", f"$.{name}", "string").isNotNull(), F.array(F.try_variant_get("s", f"$.{name}", "string"))),
            )
            for name in CITE_FIELDS
        ],
        F.array().cast("array<string>"),
    )
    good = items.select(
        "reply_id", "pos", F.try_variant_get("s", "$.text", "string").alias("text"), cites.alias("cites"),
        F.try_variant_get("s", "$.quote", "string").alias("quote"), F.lit(None).cast("string").alias("error"),
    )
    return good.unionByName(broken, allowMissingColumns=True)


def clean_cites(cites: Column) -> Column:
    """Split on blanks, commas and semicolons; strip brackets and quotes."""
    pieces = F.flatten(F.transform(F.coalesce(cites, F.array().cast("array<string>")), lambda c: F.split(c, r"[\s,;]+")))
    bare = F.transform(pieces, lambda c: F.regexp_replace(c, r"\A[\[\]\"'`]+|[\[\]\"'`]+\z", ""))
    return F.filter(bare, lambda c: c != "")


def ground_statements(statements: DataFrame, evidence: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``kept`` and ``reason`` (null if kept) to ``statements(statement_id, text, cites, quote)``.

    ``evidence(fact_id, evidence[, text])`` is what was retrieved, ``text`` the whole line of which the
    evidence is a snippet: quotes are looked for in it where it is there. ``on`` names columns that
    tie a statement to its own evidence. Checks in order: empty text, no citation, unknown citation, quote not found.
    """
    rows = statements.select(
        "statement_id", *on, strip(F.coalesce("text", F.lit(""))).alias("text"), clean_cites(F.col("cites")).alias("cites"),
        squeeze(F.coalesce("quote", F.lit(""))).alias("quote"),
    )
    cited = rows.select("statement_id", *on, "quote", F.posexplode("cites").alias("pos", "fact_id"))
    whole = F.coalesce(*[F.col(c) for c in ("text", "evidence") if c in evidence.columns], F.lit(""))
    known = evidence.select("fact_id", *on, squeeze(whole).alias("snippet")).withColumn("_known", F.lit(True))
    checked = cited.join(known, ["fact_id", *on], "left").groupBy("statement_id", *on).agg(
        F.array_sort(F.collect_list(F.when(F.col("_known").isNull(), F.struct("pos", "fact_id")))).alias("_unknown"),
        F.bool_or(F.coalesce(F.contains(F.col("snippet"), F.col("quote")), F.lit(False))).alias("_found"),
    )
    joined = rows.join(checked, ["statement_id", *on], "left")
    unknown = F.array_join(F.transform("_unknown", lambda u: u["fact_id"]), ", ")
    # The reasons.
    reason = (
        F.when(F.col("text") == "", "empty statement")
        .when(F.size("cites") == 0, "no citation")
        .when(F.size("_unknown") > 0, F.concat(F.lit("cites unknown evidence: "), unknown))
        .when((F.col("quote") != "") & ~F.col("_found"), "quote not found in cited evidence")
    )
    return joined.select("statement_id", *on, "text", "cites", reason.isNull().alias("kept"), reason.alias("reason"))


def _first(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None, out: str) -> DataFrame:
    if limit is not None:
        return top_per(rows, keys, order, limit, out)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ground_explanations(
    explanations: DataFrame, picked: DataFrame, edges: DataFrame, facts: DataFrame,
    read_up_to: int | None = None, keep: int | None = None, tests: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kept explanations, their valid evidence, related tests, counts per problem).

    ``explanations(problem_id, pos, explanation, fact_ids)`` have a 0-based ``pos``; one is kept with
    at least one fact of ``picked(problem_id, fact_id)``. The limits on what is read and kept per
    problem and on tests per explanation are off unless given; ``counts(problem_id, n_given, n_kept,
    n_dropped)`` says what is left out.
    """
    read = explanations if read_up_to is None else explanations.filter(F.col("pos") < read_up_to)
    read = read.withColumn("explanation", squeeze(F.coalesce("explanation", F.lit(""))))
    cited = read.filter(F.col("explanation") != "").select("problem_id", "pos", F.posexplode("fact_ids").alias("ord", "fact_id"))
    valid = cited.join(picked.select("problem_id", "fact_id").distinct(), ["problem_id", "fact_id"])
    supported = read.join(valid.select("problem_id", "pos").distinct(), ["problem_id", "pos"], "left_semi")
    kept = _first(supported, ["problem_id"], [F.col("pos")], keep, "rank").select("problem_id", "pos", "rank", "explanation")
    places = facts.select(F.col("id").alias("fact_id"), "repo", "file", "line")
    evidence = valid.join(kept.select("problem_id", "pos", "rank"), ["problem_id", "pos"]).join(places, "fact_id").select(
        "problem_id", "rank", "ord", "fact_id", "repo", "file", "line"
    )
    asked = evidence.groupBy("problem_id", "rank", "repo", F.col("file").alias("target")).agg(F.min("ord").alias("ord"))
    near = asked.join(
        impact(edges, asked.select("repo", "target")).filter(is_test_file(F.col("file"))).select("repo", "target", "file"), ["repo", "target"]
    ).groupBy("problem_id", "rank", "file").agg(F.min("ord").alias("ord"))
    related = _first(near, ["problem_id", "rank"], [F.col("ord"), F.col("file")], tests, "n").select("problem_id", "rank", "n", "file")
    given = explanations.select("problem_id", F.lit(1).alias("g"), F.lit(0).alias("k")).unionByName(kept.select("problem_id", F.lit(0).alias("g"), F.lit(1).alias("k")))
    counts = given.groupBy("problem_id").agg(F.sum("g").alias("n_given"), F.sum("k").alias("n_kept")).withColumn("n_dropped", F.col("n_given") - F.col("n_kept"))
    return kept, evidence, related, counts
