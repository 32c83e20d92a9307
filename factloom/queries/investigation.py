"""Questions: intent, retrieval, hypotheses, insights, triage, budget, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import estimate_tokens
from factloom.operators import grounding as G
from factloom.operators import intent as I
from factloom.operators import investigate as V
from factloom.operators import synthesis as Y
from factloom.operators.budget import fit_budget
from factloom.queries import query
from factloom.queries import sql as S
from factloom.session import cut_lineage
from factloom.sources import adapters as A


@query("q31_intent", """
    WITH o AS (SELECT *, 'o' || o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)
    SELECT id AS objective_id, 'bug-investigation' AS task_type, 'order_' || o_orderkey || ' status' AS entities, NULL::INT AS exact_count, NULL::INT AS max_words, NULL::INT AS max_evidence,
           false AS no_file_enumeration FROM o WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT id, 'architecture-overview', 'orders/o_' || o_orderkey || '.js', o_orderkey % 9 + 1, NULL, NULL, false FROM o WHERE o_orderpriority = '2-HIGH'
    UNION ALL SELECT id, 'dependency-trace', 'uses parts.js order-' || o_orderkey || ' answer under ' || CASE WHEN w >= 100 THEN w || ' ' ELSE '' END || 'words', NULL, w, NULL, false FROM o WHERE o_orderpriority = '3-MEDIUM'
    UNION ALL SELECT id, 'hotspot-analysis', 'risks maximum file enumeration', 5, NULL, o_orderkey % 20, true FROM o WHERE o_orderpriority = '4-NOT SPECIFIED'
    UNION ALL SELECT id, 'architecture-overview', lower(o_orderstatus) || '_queue', NULL, NULL, NULL, false FROM o WHERE o_orderpriority = '5-LOW'""")
def intent(spark, sf_dir):
    rows = I.parse_intent(A.worded_objectives(spark, sf_dir))
    return rows.select("objective_id", "task_type", F.array_join("entities", " ").alias("entities"), "exact_count", "max_words", "max_evidence", "no_file_enumeration")


_WORDS = ", ".join(f"'{w}'" for w in sorted({*I.INSTRUCTION_WORDS, *I.STOP_WORDS}))
KEYWORDS = f"""
objectives AS (
  SELECT 'b' || item_id AS objective_id, text FROM benchmark
  UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations WHERE role = 'user'),
tokens AS (SELECT objective_id, text, string_split(regexp_replace(lower(text), '[^a-z0-9_./-]+', ' ', 'g'), ' ') AS ws FROM objectives),
words AS (SELECT objective_id, regexp_replace(regexp_replace(unnest(ws), '^[._-]+', ''), '[._-]+$', '') AS keyword, generate_subscripts(ws, 1) AS wpos FROM tokens),
kw AS (SELECT objective_id, keyword, min(wpos) AS wpos FROM words WHERE length(keyword) > 2 AND keyword NOT IN ({_WORDS}) GROUP BY ALL),
{S.PAGE_FACTS},
hay AS (SELECT *, lower(concat_ws(' ', nullif(file, ''), nullif(name, ''), nullif(target, ''), type)) AS h FROM page_facts),
freq AS (SELECT keyword, count(*) AS n FROM (SELECT DISTINCT keyword FROM kw) k JOIN hay ON contains(h, keyword) GROUP BY keyword),
total AS (SELECT count(*) AS n_facts FROM page_facts),
rated AS (
  SELECT k.*, coalesce(n, 0) AS n, count(*) OVER (PARTITION BY objective_id) > 1 AND coalesce(n, 0) / n_facts >= 0.5 AND coalesce(n, 0) >= 20 AS broad
  FROM kw k LEFT JOIN freq USING (keyword), total),
rarest AS (SELECT objective_id, bool_and(broad) AS all_broad, arg_min(keyword, n * 100000 + wpos) AS rarest FROM rated GROUP BY objective_id),
dk AS (SELECT objective_id, keyword, n FROM rated JOIN rarest USING (objective_id) WHERE NOT broad OR (all_broad AND keyword = rarest))
"""
_STEM = "regexp_extract(keyword, '^(.{4,})ing$', 1)"
RETRIEVED = f"""
{KEYWORDS},
variants AS (
  SELECT objective_id, keyword, keyword AS v FROM dk
  UNION SELECT objective_id, keyword, {_STEM} || 'e' FROM dk WHERE {_STEM} <> ''
  UNION SELECT objective_id, keyword, {_STEM} || 'er' FROM dk WHERE {_STEM} <> ''
  UNION SELECT objective_id, keyword, {_STEM} FROM dk WHERE length({_STEM}) >= 5
  UNION SELECT objective_id, keyword, left(keyword, -1) FROM dk WHERE length(keyword) > 4 AND ends_with(keyword, 's')),
hits AS (SELECT DISTINCT v, file, line, pos FROM (SELECT DISTINCT v FROM variants) JOIN hay ON contains(h, v)),
raw_found AS (SELECT DISTINCT objective_id, file, line, pos FROM variants JOIN hits USING (v)),
asks_all AS (SELECT objective_id, bool_or(regexp_matches(keyword, '(?i)^(tests?|specs?|fixtures?|mocks?|examples?|samples?|demos?|benchmarks?)')) AS every FROM dk GROUP BY objective_id),
tiers AS (
  SELECT r.*, CASE WHEN every THEN 1 WHEN regexp_matches(file, '(?i)(^|/)(tests?|__tests__|__mocks__|__fixtures__|mocks|fixtures?|spec|examples?|samples?|demos?|benchmarks?)(/|$)') THEN 3 ELSE 2 END AS tier
  FROM raw_found r JOIN asks_all USING (objective_id)),
found AS (SELECT objective_id, file, line, pos FROM (SELECT *, min(tier) OVER (PARTITION BY objective_id) AS best FROM tiers) WHERE tier = best)
"""
HYPOTHESES = f"""
{RETRIEVED},
hyp AS (SELECT objective_id, file, count(*) AS n_facts, 0.3::DOUBLE + 0.6::DOUBLE * (count(*) / (count(*) + 5)) AS confidence FROM found GROUP BY ALL)
"""


def answers(spark, sf_dir, store=True):
    return V.answer_tables(A.objectives(spark, sf_dir), stored_facts(spark, sf_dir), store=store)


def stored_facts(spark, sf_dir):
    """Questions are asked to stored facts, as after a scan."""
    return cut_lineage(A.page_facts(spark, sf_dir), "facts")


@query("q31_keywords", f"WITH {KEYWORDS} SELECT objective_id, keyword FROM kw")
def keywords(spark, sf_dir):
    return I.keywords(I.parse_intent(A.objectives(spark, sf_dir))).select("objective_id", "keyword")


@query("q32_keyword_df", f"WITH {KEYWORDS} SELECT objective_id, keyword, n FROM dk")
def keyword_df(spark, sf_dir):
    words = I.keywords(I.parse_intent(A.objectives(spark, sf_dir)))
    return V.discriminating_keywords(words, A.page_facts(spark, sf_dir)).select("objective_id", "keyword", "n")


@query("q33_expanded_keywords", f"WITH {RETRIEVED} SELECT objective_id, keyword, v AS variant FROM variants")
def expanded_keywords(spark, sf_dir):
    words = I.keywords(I.parse_intent(A.objectives(spark, sf_dir)))
    kept = V.discriminating_keywords(words, A.page_facts(spark, sf_dir))
    return V.expand_keywords(kept).select("objective_id", "keyword", "variant")


@query("q33_retrieve", f"WITH {RETRIEVED} SELECT objective_id, file, CAST(line AS BIGINT) AS line, CAST(pos AS BIGINT) AS pos FROM found")
def retrieve(spark, sf_dir):
    return answers(spark, sf_dir, store=False)["retrieved"].select("objective_id", "file", "line", F.col("pos").cast("long").alias("pos"))


@query("q33_overview_retrieval", """
    WITH o AS (SELECT 'o' || o_orderkey AS objective_id FROM orders WHERE o_orderpriority = '5-LOW'),
    n AS (SELECT count(*) AS n FROM customer)
    SELECT objective_id, n AS n_facts FROM o, n""")
def overview_retrieval(spark, sf_dir):
    """Overview questions get all route facts of the repository."""
    intents = I.parse_intent(A.worded_objectives(spark, sf_dir)).filter(F.col("task_type") == "architecture-overview")
    broad = intents.filter(F.col("exact_count").isNull()).select("objective_id", "repo", "task_type")
    facts = A.route_facts(spark, sf_dir)
    # Each question would repeat every fact: count the facts once per repo instead of per question.
    one = broad.select("repo").distinct().withColumn("objective_id", F.lit("any"))
    sizes = V.retrieve_overview(one, facts).groupBy("repo").agg(F.count(F.lit(1)).alias("n_facts"))
    return broad.join(sizes, "repo").select("objective_id", "n_facts")


@query("q33_widened_retrieval", f"""
    WITH {RETRIEVED} SELECT objective_id, count(*) AS n FROM (
      SELECT objective_id, file, line, pos FROM raw_found) GROUP BY objective_id""")
def widened_retrieval(spark, sf_dir):
    t = answers(spark, sf_dir, store=False)
    wide = V.widen_retrieval(t["keywords"], t["unknowns"], t["retrieved"], A.page_facts(spark, sf_dir), t["overview"])
    return wide.groupBy("objective_id").agg(F.count(F.lit(1)).alias("n"))


@query("q34_unknowns", f"""
    WITH {RETRIEVED},
    seen AS (SELECT DISTINCT objective_id, file, name FROM found JOIN page_facts USING (file, line, pos))
    SELECT objective_id, keyword FROM dk k WHERE NOT EXISTS (
      SELECT 1 FROM seen s WHERE s.objective_id = k.objective_id AND (contains(lower(file), keyword) OR contains(lower(name), keyword)))""")
def unknowns(spark, sf_dir):
    return answers(spark, sf_dir, store=False)["unknowns"].select("objective_id", "keyword")


@query("q35_hypotheses", f"WITH {HYPOTHESES} SELECT objective_id, file, n_facts, confidence, CASE WHEN confidence >= 0.8 THEN 'confirmed' ELSE 'supported' END AS status FROM hyp")
def hypotheses(spark, sf_dir):
    return answers(spark, sf_dir, store=False)["hypotheses"].select("objective_id", "file", "n_facts", "confidence", "status")


@query("q35_drifted_hypotheses", """
    WITH i AS (SELECT l_orderkey AS ok, l_partkey AS pk, sum(l_quantity) AS q, sum(l_quantity) FILTER (l_returnflag <> 'R') AS q2 FROM lineitem GROUP BY ALL),
    f AS (SELECT ok, count(*) AS n, count_if(q2 IS NULL OR q2 <> q) AS d FROM i GROUP BY ok)
    SELECT 'orders/o_' || ok || '.js' AS file, n AS n_facts, d AS n_drifted, CASE WHEN d > 0 THEN 0.0 ELSE 0.3::DOUBLE + 0.6::DOUBLE * (n / (n + 5)) END AS confidence,
      CASE WHEN d > 0 THEN 'eliminated' WHEN 0.3::DOUBLE + 0.6::DOUBLE * (n / (n + 5)) >= 0.8 THEN 'confirmed' ELSE 'supported' END AS status FROM f""")
def drifted_hypotheses(spark, sf_dir):
    """One question that retrieves all imports, checked against the later version."""
    from factloom.queries.verification import verified

    found = A.import_facts(spark, sf_dir).withColumn("objective_id", F.lit("all"))
    scored = V.score_hypotheses(V.form_hypotheses(found, verified(spark, sf_dir)))
    return scored.select("file", "n_facts", "n_drifted", "confidence", "status")


@query("q36_rank", f"WITH {HYPOTHESES} SELECT objective_id, file, row_number() OVER (PARTITION BY objective_id ORDER BY confidence DESC, file) AS rank FROM hyp")
def rank(spark, sf_dir):
    return V.rank_hypotheses(answers(spark, sf_dir, store=("hypotheses",))["hypotheses"]).select("objective_id", "file", "rank")


_AREA = "array_to_string(string_split(file, '/')[1:2], '/')"


@query("q37_clusters", f"WITH {HYPOTHESES} SELECT objective_id, {_AREA} AS area, count(*) AS n_hypotheses, max(confidence) AS max_confidence, arg_min(file, (-confidence, file)) AS best_file FROM hyp GROUP BY ALL")
def clusters(spark, sf_dir):
    rows = Y.cluster_by_area(answers(spark, sf_dir, store=False)["hypotheses"])
    return rows.select("objective_id", "area", "n_hypotheses", "max_confidence", "best_file")


_INSIGHTS = f"""
{HYPOTHESES},
areas AS (SELECT objective_id, {_AREA} AS area, count(*) AS n_hyp, max(confidence) AS confidence, arg_min(file, (-confidence, file)) AS best_file, arg_min(n_facts, (-confidence, file)) AS best_n FROM hyp GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY objective_id ORDER BY confidence DESC, best_file) AS rank, count(*) OVER (PARTITION BY objective_id) AS total FROM areas),
top AS (SELECT * FROM ranked WHERE rank <= 8)
"""


@query("q38_insights", f"""
    WITH {_INSIGHTS},
    shown AS (SELECT * FROM (SELECT t.objective_id, t.rank, f.line, f.pos, p.type, p.name, row_number() OVER (PARTITION BY t.objective_id, t.rank ORDER BY f.line, f.pos) AS i
      FROM top t JOIN found f ON f.objective_id = t.objective_id AND f.file = t.best_file JOIN page_facts p ON p.file = f.file AND p.line = f.line AND p.pos = f.pos) WHERE i <= 5),
    heading AS (SELECT objective_id, rank, arg_min(name, i) AS name FROM shown WHERE type = 'doc_heading' GROUP BY ALL)
    SELECT objective_id, rank, area, area AS insight, confidence, n_hyp AS n_hypotheses, total AS total_found,
      CASE WHEN name IS NOT NULL THEN 'Explains: ' || name || '.' ELSE best_n || ' related facts lie here.' END AS why
    FROM top LEFT JOIN heading USING (objective_id, rank)""")
def insights(spark, sf_dir):
    t = answers(spark, sf_dir, store=("hypotheses",))
    top, totals = Y.top_insights(t["hypotheses"], t["intents"], cut_lineage(Y.cluster_by_area(t["hypotheses"]), "clusters"))
    told = Y.insight_reasons(top, t["retrieved_of"], A.page_facts(spark, sf_dir)).join(totals, "objective_id")
    return told.select("objective_id", "rank", "area", "insight", "confidence", "n_hypotheses", "total_found", F.col("why_it_matters").alias("why"))


@query("q38_insight_citations", f"""
    WITH {_INSIGHTS}
    SELECT objective_id, rank, ref, file, line FROM (
      SELECT t.objective_id, t.rank, h.file, CAST(f.line AS BIGINT) AS line, row_number() OVER (PARTITION BY t.objective_id, t.rank ORDER BY h.confidence DESC, h.file, f.line, f.pos) AS ref
      FROM top t JOIN hyp h ON h.objective_id = t.objective_id AND array_to_string(string_split(h.file, '/')[1:2], '/') = t.area
      JOIN found f ON f.objective_id = h.objective_id AND f.file = h.file) WHERE ref <= 5""")
def insight_citations(spark, sf_dir):
    t = answers(spark, sf_dir, store=("hypotheses",))
    clusters = cut_lineage(Y.cluster_by_area(t["hypotheses"]), "clusters")
    top = cut_lineage(Y.top_insights(t["hypotheses"], t["intents"], clusters)[0], "insights")
    refs = Y.insight_references(top, t["hypotheses"], t["retrieved_of"], t["intents"], clusters)
    return Y.attach_citations(refs, A.page_facts(spark, sf_dir)).select("objective_id", "rank", "ref", "file", "line")


@query("q38_deep_evidence", f"""
    WITH {HYPOTHESES}, r AS (SELECT *, row_number() OVER (PARTITION BY objective_id ORDER BY confidence DESC, file) AS hr FROM hyp)
    SELECT objective_id, rank, file, line FROM (
      SELECT r.objective_id, r.file, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY r.objective_id ORDER BY hr, line, pos) AS rank FROM r JOIN found f ON f.objective_id = r.objective_id AND f.file = r.file)
    WHERE rank <= 60""")
def deep_evidence(spark, sf_dir):
    t = answers(spark, sf_dir, store=("hypotheses",))
    best = V.top_hypotheses(t["hypotheses"], V.DEEP_CAP)
    picked = V.collect_deep_facts(best, t["retrieved_of"])
    facts = A.page_facts(spark, sf_dir).select(F.col("id").alias("fact_id"), "file", "line")
    return picked.join(facts, "fact_id").select("objective_id", F.col("rank").cast("long").alias("rank"), "file", "line")


TRIAGED = f"""
    {HYPOTHESES},
    seen AS (SELECT DISTINCT objective_id, file, name FROM found JOIN page_facts USING (file, line, pos)),
    unk AS (SELECT objective_id, count(*) AS n FROM dk k WHERE NOT EXISTS (
      SELECT 1 FROM seen s WHERE s.objective_id = k.objective_id AND (contains(lower(file), keyword) OR contains(lower(name), keyword))) GROUP BY objective_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY objective_id ORDER BY confidence DESC, file) AS rank FROM hyp),
    s AS (SELECT o.objective_id, coalesce(max(confidence) FILTER (rank = 1), 0) AS top, max(confidence) FILTER (rank = 2) AS second, count(file) AS n_hyp FROM objectives o LEFT JOIN r USING (objective_id) GROUP BY 1),
    t AS (SELECT s.*, coalesce(u.n, 0) AS n_unknown, CASE WHEN n_hyp > 1 THEN top - second END AS gap FROM s LEFT JOIN unk u USING (objective_id)),
    modes AS (SELECT *, CASE WHEN n_hyp = 0 OR gap < 0.15 OR n_unknown > 0 OR top < 0.6 THEN 'deep' ELSE 'shallow' END AS mode FROM t)"""


@query("q39_triage", f"""
    WITH {TRIAGED}
    SELECT objective_id, n_hyp AS n_hypotheses, n_unknown, top::DOUBLE AS confidence,
      mode,
      CASE WHEN n_hyp = 0 THEN 'no_hypotheses' ELSE concat_ws(',', CASE WHEN gap < 0.15 THEN 'ambiguous' END, CASE WHEN n_unknown > 0 THEN 'unknown_terms' END, CASE WHEN top < 0.6 THEN 'low_confidence' END) END AS reasons
    FROM modes""")
def triage(spark, sf_dir):
    return answers(spark, sf_dir, store=("hypotheses",))["triage"].select("objective_id", "n_hypotheses", "n_unknown", "confidence", "mode", F.array_join("reasons", ",").alias("reasons"))


@query("q39_deep_answers", f"""
    WITH {TRIAGED}
    SELECT objective_id, count(r.file) AS n_facts, count(DISTINCT r.file) AS n_hypotheses, least(count(r.file), 60) AS n_cited
    FROM modes JOIN raw_found r USING (objective_id) WHERE mode = 'deep' GROUP BY objective_id""")
def deep_answers(spark, sf_dir):
    """The second round of the questions that triage calls deep."""
    t = answers(spark, sf_dir, store=("hypotheses",))
    second = V.deepen(t, A.page_facts(spark, sf_dir))
    cited = second["facts"].groupBy("objective_id").agg(F.count(F.lit(1)).alias("n_cited"))
    formed = second["hypotheses"].groupBy("objective_id").agg(F.sum("n_facts").alias("n_facts"), F.count(F.lit(1)).alias("n_hypotheses"))
    return formed.join(cited, "objective_id").select("objective_id", "n_facts", "n_hypotheses", "n_cited")


@query("q39_outcomes", f"""
    WITH {HYPOTHESES} SELECT o.objective_id, CASE WHEN max(confidence) >= 0.5 THEN 'success' ELSE 'failure' END AS outcome FROM objectives o LEFT JOIN hyp USING (objective_id) GROUP BY 1""")
def outcomes(spark, sf_dir):
    t = answers(spark, sf_dir, store=False)
    return V.outcome_of_run(t["hypotheses"], t["intents"])


@query("q35_relevant_memory", f"""
    WITH {KEYWORDS}, rules AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS rule FROM pages WHERE page_id % 2 = 0)
    SELECT DISTINCT objective_id, 'p' || page_id AS rule_id FROM kw JOIN rules ON contains(rule, keyword)""")
def relevant_memory(spark, sf_dir):
    """Page titles as rules; those of even pages are approved."""
    words = I.keywords(I.parse_intent(A.objectives(spark, sf_dir)))
    rules = A.table(spark, sf_dir, "pages").select(
        F.lit(A.WEB).alias("repo"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("rule"),
        F.when(F.col("page_id") % 2 == 0, "approved").otherwise("proposed").alias("status"),
    )
    return V.relevant_memory(words, rules).select("objective_id", "rule_id")


@query("q40_budget", """
    WITH items AS (SELECT conv_id, CASE role WHEN 'user' THEN 1 WHEN 'system' THEN 2 ELSE 3 END AS s, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost FROM conversations),
    run AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id, s ORDER BY turn) AS running FROM items),
    c AS (SELECT DISTINCT conv_id, 10 AS used FROM conversations),
    k1 AS (SELECT c.conv_id, coalesce(sum(cost) FILTER (running <= greatest(0, 400 - used)), 0) AS tokens, count(*) FILTER (running <= greatest(0, 400 - used)) AS kept, count(cost) AS n, any_value(used) AS used
           FROM c LEFT JOIN run r ON r.conv_id = c.conv_id AND s = 1 GROUP BY 1),
    k2 AS (SELECT k1.conv_id, coalesce(sum(cost) FILTER (running <= greatest(0, 400 - used - k1.tokens)), 0) AS tokens, count(*) FILTER (running <= greatest(0, 400 - used - k1.tokens)) AS kept, count(cost) AS n, any_value(used + k1.tokens) AS used
           FROM k1 LEFT JOIN run r ON r.conv_id = k1.conv_id AND s = 2 GROUP BY 1),
    k3 AS (SELECT k2.conv_id, coalesce(sum(cost) FILTER (running <= greatest(0, 400 - used - k2.tokens)), 0) AS tokens, count(*) FILTER (running <= greatest(0, 400 - used - k2.tokens)) AS kept, count(cost) AS n, any_value(used + k2.tokens) AS used
           FROM k2 LEFT JOIN run r ON r.conv_id = k2.conv_id AND s = 3 GROUP BY 1)
    SELECT 'c' || conv_id AS objective_id, 'hypotheses' AS section, tokens::BIGINT AS tokens, kept, n - kept AS dropped FROM k1
    UNION ALL SELECT 'c' || conv_id, 'unknowns', tokens::BIGINT, kept, n - kept FROM k2
    UNION ALL SELECT 'c' || conv_id, 'insights', tokens::BIGINT, kept, n - kept FROM k3
    UNION ALL SELECT 'c' || conv_id, 'total', (used + tokens)::BIGINT, NULL, NULL FROM k3""")
def budget(spark, sf_dir):
    """Turns of a conversation as sections of an answer: user, system, assistant; 400 tokens, 10 used."""
    talk = A.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("objective_id"),
        F.when(F.col("role") == "user", "hypotheses").when(F.col("role") == "system", "unknowns").otherwise("insights").alias("section"),
        (F.col("turn") + 1).alias("pos"), estimate_tokens(F.col("text")).alias("cost"),
    )
    base = talk.select("objective_id").distinct().withColumn("used", F.lit(10))
    _, report = fit_budget(base, talk, 400, ("hypotheses", "unknowns", "insights"))
    return report


_PROBLEM_WORDS = ", ".join(f"'{w}'" for w in V.PROBLEM_STOP_WORDS)


@query("q41_pick_facts", f"""
    WITH problems AS (SELECT 'b' || item_id AS problem_id, text FROM benchmark),
    kws AS (SELECT DISTINCT problem_id, keyword FROM (SELECT problem_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_./-]{{2,}}')) AS keyword FROM problems) WHERE keyword NOT IN ({_PROBLEM_WORDS})),
    facts AS (SELECT 'routes/nation_' || c_nationkey || '.js' AS file, c_custkey + 1 AS line, lower('routes/nation_' || c_nationkey || '.js' || ' ' || '/c/' || c_custkey) AS h FROM customer
              UNION ALL SELECT lower(n_name) || '/the_' || n_nationkey || '/and.js', 1, lower(n_name) || '/the_' || n_nationkey || '/and.js' FROM nation),
    {S.PAGE_FACTS},
    texts AS (SELECT file, CAST(line AS BIGINT) AS line, pos, lower(file || ' ' || name || '   ' || coalesce(target, '')) AS h FROM page_facts),
    scored AS (SELECT problem_id, file, line, pos, count(*) AS score FROM kws JOIN texts ON contains(h, keyword) GROUP BY ALL)
    SELECT problem_id, file, line, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, file, line, pos) AS rank FROM scored) WHERE rank <= 40""")
def pick_facts(spark, sf_dir):
    """Page facts retyped as code references, ranked against the benchmark passages."""
    facts = A.page_facts(spark, sf_dir).withColumn("type", F.lit("reference")).withColumn("entity", F.col("name"))
    problems = A.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("problem_id"), F.lit(A.WEB).alias("repo"), "text")
    facts = facts.withColumn("ext_ord", F.lit(1))
    picked = V.pick_facts(facts, problems)
    places = facts.select(F.col("id").alias("fact_id"), "file", "line")
    return picked.join(places, "fact_id").select("problem_id", "file", "line", "score", F.col("rank").cast("long").alias("rank"))


@query("q42_grounding", """
    WITH says AS (SELECT conv_id, turn, trim(text, chr(10) || ' ') AS text FROM conversations WHERE role = 'assistant'),
    ev AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
    j AS (SELECT s.*, p.turn IS NOT NULL AS has_prev, n.turn IS NOT NULL AS has_next, coalesce(contains(p.text, 'the'), false) OR coalesce(contains(n.text, 'the'), false) AS quoted
          FROM says s LEFT JOIN ev p ON p.conv_id = s.conv_id AND p.turn = s.turn - 1 LEFT JOIN ev n ON n.conv_id = s.conv_id AND n.turn = s.turn + 1)
    SELECT 's' || conv_id || '_' || turn AS statement_id, reason IS NULL AS kept, reason FROM (
      SELECT *, CASE WHEN text = '' THEN 'empty statement' WHEN NOT has_prev AND NOT has_next THEN 'cites unknown evidence: u' || conv_id || '_' || (turn - 1) || ', u' || conv_id || '_' || (turn + 1)
        WHEN NOT has_prev THEN 'cites unknown evidence: u' || conv_id || '_' || (turn - 1) WHEN NOT has_next THEN 'cites unknown evidence: u' || conv_id || '_' || (turn + 1)
        WHEN NOT quoted THEN 'quote not found in cited evidence' END AS reason FROM j)""")
def grounding(spark, sf_dir):
    """Assistant turns cite the user turns around them and quote 'the'."""
    talk = A.table(spark, sf_dir, "conversations")
    name = lambda p, t: F.concat(F.lit(p), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))
    said = talk.filter(F.col("role") == "assistant").select(
        name("s", F.col("turn")).alias("statement_id"), "text",
        F.array(F.concat(F.lit("['"), name("u", F.col("turn") - 1), F.lit("', "), name("u", F.col("turn") + 1), F.lit("]"))).alias("cites"), F.lit(" the ").alias("quote"),
    )
    evidence = talk.filter(F.col("role") == "user").select(name("u", F.col("turn")).alias("fact_id"), F.col("text").alias("evidence"))
    return G.ground_statements(said, evidence).select("statement_id", "kept", "reason")


@query("q42_parsed_replies", """
    SELECT 'c' || conv_id || '_' || turn AS reply_id, CASE WHEN length(text) > 300 THEN NULL ELSE text END AS text, CASE WHEN length(text) > 300 THEN 'no statements list' END AS error,
           CASE WHEN length(text) > 300 THEN '' ELSE 'a1,a2' END AS cites FROM conversations WHERE role = 'assistant'""")
def parsed_replies(spark, sf_dir):
    """Assistant turns wrapped as JSON replies between prose; long ones are cut off."""
    talk = A.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    inner = F.to_json(F.struct(F.array(F.struct(F.col("text"), F.array(F.lit("a1"), F.lit("a2")).alias("citations"))).alias("statements")))
    reply = F.when(F.length("text") > 300, F.concat(F.lit("Sure: "), F.substring(inner, F.lit(1), F.length(inner) - 4))).otherwise(F.concat(F.lit("Here:\n```json\n"), inner, F.lit("\n```\nDone")))
    replies = talk.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("reply_id"), reply.alias("text"))
    return G.parse_statements(replies).select("reply_id", "text", "error", F.coalesce(F.array_join("cites", ","), F.lit("")).alias("cites"))


@query("q42_explanations", """
    WITH o AS (SELECT o_custkey AS ck, o_orderkey AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus AS s FROM orders),
    good AS (SELECT ck, ok, pos, row_number() OVER (PARTITION BY ck ORDER BY pos) AS rank FROM o WHERE pos < 8 AND s <> 'P')
    SELECT 'c' || ck AS problem_id, CAST(rank AS BIGINT) AS rank, 'orders/o_' || ok || '.js' AS file, 'customers/c_' || ck || '.test.js' AS test FROM good WHERE rank <= 4""")
def explanations(spark, sf_dir):
    """An explanation per order of a customer, citing the order's route; pending orders cite nothing known."""
    from factloom.functions.runs import number_rows
    from factloom.operators.derive import dependency_support
    from factloom.operators.extract import extract_imports
    from factloom.operators.facts import normalize_facts
    from factloom.operators.graph import dependency_edges

    orders = A.table(spark, sf_dir, "orders")
    numbered = number_rows(orders, ["o_custkey"], [F.floor(F.col("o_orderkey") / 4096)], [F.col("o_orderkey")], "n")
    key = F.col("o_orderkey").cast("string")
    said = numbered.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("problem_id"), (F.col("n") - 1).alias("pos"), F.concat(F.lit("because of "), key).alias("explanation"),
        F.array(F.lit("nothing"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.concat(F.lit("f"), key))).alias("fact_ids"),
    )
    picked = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("problem_id"), F.concat(F.lit("f"), key).alias("fact_id"))
    facts = orders.select(F.concat(F.lit("f"), key).alias("id"), F.lit(A.SHOP).alias("repo"), F.concat(F.lit("orders/o_"), key, F.lit(".js")).alias("file"), F.lit(1).alias("line"))
    tests = A.order_lines(spark, sf_dir).withColumn("file", F.regexp_replace("file", r"\.js\z", ".test.js"))
    edges = dependency_edges(dependency_support(normalize_facts(extract_imports(tests))))
    _, evidence, related, _ = G.ground_explanations(said, picked, edges, facts, read_up_to=8, keep=4, tests=5)
    return evidence.join(related.withColumnRenamed("file", "test"), ["problem_id", "rank"]).select("problem_id", F.col("rank").cast("long").alias("rank"), "file", "test")
