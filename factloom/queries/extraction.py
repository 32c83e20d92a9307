"""Corpus, line, fact and finding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import extract, findings
from factloom.operators.derive import architecture_summary
from factloom.operators.facts import normalize_facts
from factloom.operators.rules import merge
from factloom.queries import query
from factloom.queries import sql as S
from factloom.sources import adapters as A
from factloom.sources import corpus

_DOC_FILE = "lang || '/doc_' || doc_id || '.md'"


@query(
    "q01_lines_explode",
    f"""
    SELECT {_DOC_FILE} AS file, CAST(ln AS BIGINT) AS ln, {S.snippet('line')} AS evidence
    FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
    """,
)
def lines_explode(spark, sf_dir):
    from factloom.functions.text import evidence

    lines = corpus.to_lines(A.document_files(spark, sf_dir))
    return lines.select("file", F.col("ln").cast("long").alias("ln"), evidence(F.col("line")).alias("evidence"))


@query(
    "q02_coverage",
    """
    WITH f AS (
      SELECT source AS repo, true AS supported FROM documents
      UNION ALL SELECT 'web', false FROM pages
      UNION ALL SELECT 's_' || s_suppkey, false FROM supplier
      UNION ALL SELECT 'u_' || user_id, true FROM events)
    SELECT repo, count(*) AS files_discovered, count_if(supported) AS files_supported, count_if(supported) AS files_scanned,
           count_if(NOT supported) AS files_skipped,
           CASE WHEN count_if(supported) > 0 THEN 100.0::DOUBLE END AS coverage_percent,
           CASE WHEN count_if(supported) = 0 THEN 'no_supported_files' ELSE 'success' END AS status
    FROM f GROUP BY repo
    """,
)
def coverage(spark, sf_dir):
    parts = [A.document_files(spark, sf_dir), A.page_files(spark, sf_dir), A.manifest_files(spark, sf_dir), A.config_files(spark, sf_dir)]
    files = corpus.filter_ignored(merge([p.select("repo", "file") for p in parts]))
    return corpus.coverage_stats(corpus.assign_bucket(files)).drop("files_failed")


@query(
    "q03_imports",
    f"""
    WITH {S.IMPORTS}
    SELECT {S.order_file('ok')} AS file, pk + 2 AS line, {S.part_target('pk')} AS target,
           'import p' || pk || ' from "../parts/p_' || pk || '.js"; // qty ' || qty AS evidence
    FROM imp
    """,
)
def imports(spark, sf_dir):
    return extract.extract_imports(A.import_lines(spark, sf_dir)).select("file", "line", "target", "evidence")


@query(
    "q07_routes",
    """
    SELECT 'routes/nation_' || c_nationkey || '.js' AS file, c_custkey + 1 AS line, '/c/' || c_custkey AS route_path,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GET' WHEN 'BUILDING' THEN 'POST' WHEN 'FURNITURE' THEN 'PUT'
             WHEN 'HOUSEHOLD' THEN 'DELETE' WHEN 'MACHINERY' THEN 'PATCH' ELSE 'ALL' END AS method
    FROM customer
    """,
)
def routes(spark, sf_dir):
    return extract.extract_routes(A.route_lines(spark, sf_dir)).select("file", "line", "route_path", "method")


@query("q09_page_links", f"WITH {S.PAGE_FACTS} SELECT file, CAST(line AS BIGINT) AS line, type, name, target FROM page_facts")
def page_links(spark, sf_dir):
    facts = extract.extract_html(corpus.to_lines(A.page_files(spark, sf_dir)))
    return facts.select("file", "line", "type", "name", "target")


@query(
    "q10_markdown_fences",
    """
    WITH raw AS (
      SELECT 'notes/' || replace(p_brand, '#', '') || '.md' AS file, p_partkey AS pk, p_size, p_partkey * 10 + 1 AS base FROM part),
    fences AS (
      SELECT file, base AS ln, '```js' AS text FROM raw
      UNION ALL SELECT file, base + 5, '```' FROM raw WHERE p_size <= 40),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ln) AS n FROM fences),
    blocks AS (
      SELECT o.file, o.ln, o.text FROM numbered o JOIN numbered c ON c.file = o.file AND c.n = o.n + 1 WHERE o.n % 2 = 1),
    texts AS (
      SELECT file, base + 3 AS ln, 'doc_link' AS type, 'part' AS name, './p_' || pk || '.md' AS target FROM raw
      UNION ALL SELECT file, base + 3, 'doc_instruction', '[part](./p_' || pk || '.md) must hold', NULL FROM raw
      UNION ALL SELECT file, base + 7, 'doc_heading', 'Part ' || pk, NULL FROM raw),
    open_texts AS (
      SELECT t.*, (SELECT max(n) FROM numbered f WHERE f.file = t.file AND f.ln < t.ln) AS before FROM texts t)
    SELECT file, ln AS line, type, name, target FROM open_texts WHERE coalesce(before, 0) % 2 = 0
    UNION ALL SELECT file, ln, 'doc_code_block', NULL, NULL FROM blocks
    """,
)
def markdown_fences(spark, sf_dir):
    return extract.extract_markdown(A.fence_lines(spark, sf_dir)).select("file", "line", "type", "name", "target")


@query(
    "q11_config_keys",
    """
    SELECT 'events/e_' || event_id || '.json' AS file, event_type AS name, 2::BIGINT AS line, 'number' AS value_type, 'high' AS confidence FROM events
    UNION ALL SELECT 'events/e_' || event_id || '.json', 'props', 3, 'object', 'high' FROM events
    UNION ALL SELECT 'events/e_' || event_id || '.json', 'props.' || k, NULL, 'number', 'medium'
    FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)
    """,
)
def config_keys(spark, sf_dir):
    facts = extract.extract_config(A.config_files(spark, sf_dir))
    return facts.select("file", "name", "line", F.col("extra")["valueType"].alias("value_type"), "confidence")


@query(
    "q11_config_formats",
    """
    WITH e AS (SELECT 'settings/e_' || event_id AS file, event_type FROM events),
    keys(format, name, line, value_type) AS (VALUES
      ('.yaml', 'kind', 1, 'string'), ('.yaml', 'run', 2, 'string'), ('.yaml', 'value', 5, 'number'), ('.yaml', 'user', 6, 'object'), ('.yaml', 'user.id', NULL, 'number'),
      ('.yaml', 'user.tags', NULL, 'array'), ('.yaml', 'note', 7, 'string'), ('.yaml', 'details', 9, 'object'), ('.yaml', 'details.event', 10, 'number'), ('.yaml', 'details.list', 11, 'array'),
      ('.toml', 'title', 1, 'string'), ('.toml', 'value', 2, 'number'), ('.toml', 'server', 6, 'object'), ('.toml', 'server.port', 7, 'number'), ('.toml', 'server.tags', 8, 'array'),
      ('.toml', 'server.' || chr(42), 11, 'object'))
    SELECT file || format AS file, replace(name, chr(42), event_type) AS name, CAST(line AS BIGINT) AS line, value_type, CASE WHEN line IS NULL THEN 'medium' ELSE 'high' END AS confidence
    FROM e, keys
    """,
)
def config_formats(spark, sf_dir):
    facts = extract.extract_config(A.setting_files(spark, sf_dir))
    return facts.select("file", "name", "line", F.col("extra")["valueType"].alias("value_type"), "confidence")


_TOKEN = """'(?i)((?:token|secret|api_?key|passw(?:or)?d)\\s*["'']?\\s*[:=]\\s*["''])([A-Za-z0-9_\\-/+=.]{16,})(["''])'"""


@query(
    "q12_secrets",
    f"""
    SELECT source AS repo, {_DOC_FILE} AS file, CAST(ln AS BIGINT) AS line, 'Generic Token Assignment' AS rule, 'high' AS severity,
           {S.snippet("regexp_replace(line, " + _TOKEN + ", '\\1[REDACTED]\\3', 'g')")} AS evidence
    FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
    WHERE regexp_matches(line, {_TOKEN})
    """,
)
def secrets(spark, sf_dir):
    found = findings.secret_findings(corpus.to_lines(A.document_files(spark, sf_dir)))
    return found.select("repo", "file", "line", "rule", "severity", "evidence")


_KNOWN = ", ".join(f"('{k}', {i})" for i, k in enumerate(findings.KNOWN_PACKAGES))
_DEPS = f"""
known(k, i) AS (VALUES {_KNOWN}),
own AS (SELECT s_suppkey, s_nationkey, s_acctbal, lower(replace(s_name, '#', '-')) AS own FROM supplier),
typo AS (SELECT s_suppkey, s_acctbal, own, left(k, length(k) - 1) AS dep FROM own JOIN known ON i = s_nationkey % {len(findings.KNOWN_PACKAGES)}),
deps AS (
  SELECT s_suppkey, dep, 4 AS line, '    "' || dep || '": "1.0",' AS text FROM typo
  UNION ALL SELECT s_suppkey, 'express', 5, '    "express": "4.0",' FROM typo WHERE s_acctbal > 0
  UNION ALL SELECT s_suppkey, own, CASE WHEN s_acctbal > 0 THEN 6 ELSE 5 END, '    "' || own || '": "1.0"' FROM typo),
squats AS (
  SELECT s_suppkey, dep, line, text, arg_min(k, i) AS k FROM deps, known
  WHERE length(k) >= 4 AND dep <> k AND levenshtein(dep, k) <= 2 GROUP BY ALL)
"""


@query(
    "q13_typosquat",
    f"""
    WITH {_DEPS}
    SELECT 's_' || s_suppkey AS repo, CAST(line AS BIGINT) AS line, trim(text) AS evidence,
           'Dependency name "' || dep || '" closely resembles popular package "' || k || '"' AS rule
    FROM squats
    """,
)
def typosquat(spark, sf_dir):
    return findings.dependency_findings(A.manifest_files(spark, sf_dir)).select("repo", "line", "evidence", "rule")


def _all_findings(spark, sf_dir):
    secret = findings.secret_findings(corpus.to_lines(A.document_files(spark, sf_dir)))
    return findings.dedup_findings(secret.unionByName(findings.dependency_findings(A.manifest_files(spark, sf_dir))))


_FOUND = f"""
{_DEPS},
found AS (
  SELECT source AS repo, 'secret_exposure' AS category, 'high' AS severity, doc_id, ln FROM (
    SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
  WHERE regexp_matches(line, {_TOKEN})
  UNION ALL SELECT 's_' || s_suppkey, 'dependency_risk', 'medium', NULL, NULL FROM squats)
"""


@query("q14_severity_rollup", f"WITH {_FOUND} SELECT category, severity, count(*) AS n FROM found GROUP BY ROLLUP(category, severity)")
def severity_rollup(spark, sf_dir):
    return findings.severity_rollup(_all_findings(spark, sf_dir))


@query(
    "q14_severity_summary",
    f"""WITH {_FOUND} SELECT repo, 0::BIGINT AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium,
        0::BIGINT AS low, count(*) AS total FROM found GROUP BY repo""",
)
def severity_summary(spark, sf_dir):
    return findings.severity_summary(_all_findings(spark, sf_dir)).select(
        "repo", *[F.col(s).cast("long").alias(s) for s in findings.SEVERITIES], "total"
    )


@query(
    "q14_worst_findings",
    f"""
    WITH {_FOUND}, named AS (SELECT repo, lang || '/doc_' || f.doc_id || '.md' AS file, ln FROM found f JOIN documents d ON d.doc_id = f.doc_id)
    SELECT repo, file, CAST(ln AS BIGINT) AS line, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, ln) AS rank FROM named) WHERE rank <= 5
    """,
)
def worst_findings(spark, sf_dir):
    return findings.worst_findings(_all_findings(spark, sf_dir)).select("repo", "file", "line", F.col("rank").cast("long").alias("rank"))


@query(
    "q14_filter_findings",
    f"WITH {_FOUND} SELECT repo, count(*) AS n FROM found WHERE severity = 'medium' AND category = 'dependency_risk' GROUP BY repo",
)
def filter_findings(spark, sf_dir):
    chosen = findings.filter_findings(_all_findings(spark, sf_dir), "medium", "dependency_risk")
    return chosen.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q15_stack_summary",
    """
    WITH s AS (SELECT 's_' || s_suppkey AS repo, lower(replace(s_name, '#', '-')) AS name, s_acctbal > 0 AS express, s_nationkey % 18 AS i FROM supplier),
    r AS (SELECT count(*) AS n FROM customer)
    SELECT repo, CASE WHEN express THEN 'Express' ELSE '' END AS frameworks,
           CASE WHEN express THEN 'high' ELSE 'medium' END AS confidence,
           '"' || name || '" — ' || CASE WHEN express
             THEN 'Detected stack: Express. 0 React component(s), 0 Express route(s), 0 Next.js page route(s), 0 Next.js API route(s) across the scanned source tree.'
             ELSE 'No first-class framework (React/Next.js/Express) confirmed from package.json. 0 component-like function(s) detected heuristically.' END AS description
    FROM s
    UNION ALL
    SELECT 'shop', 'Express', 'high', 'Detected stack: Express. 0 React component(s), ' || n || ' Express route(s), 0 Next.js page route(s), 0 Next.js API route(s) across the scanned source tree.'
    FROM r
    """,
)
def stack_summary(spark, sf_dir):
    stack = corpus.detect_stack(A.manifest_files(spark, sf_dir))
    return architecture_summary(A.route_facts(spark, sf_dir), stack).select("repo", "frameworks", "confidence", "description")


@query(
    "q48_dedup_first",
    f"""
    WITH found AS (
      SELECT source AS repo, {_DOC_FILE} AS file, ln FROM (
        SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)
      WHERE regexp_matches(line, {_TOKEN}))
    SELECT repo, file, CAST(ln AS BIGINT) AS line, count(*) AS n FROM found GROUP BY ALL
    """,
)
def dedup_first(spark, sf_dir):
    lines = corpus.to_lines(A.document_files(spark, sf_dir))
    twice = findings.secret_findings(lines).unionByName(findings.secret_findings(lines).withColumn("ext_ord", F.lit(99)))
    once = findings.dedup_findings(twice).filter(F.col("ext_ord") == 12)
    return once.groupBy("repo", "file", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q49_function_calls_caller",
    """
    WITH o AS (SELECT 'svc/c_' || o_custkey || '.js' AS file, o_orderkey AS k, o_orderkey * 16 AS base, o_orderstatus = 'F' AS method FROM orders),
    scopes AS (
      SELECT file, base + 1 AS opens, base + 14 AS closes, CASE WHEN method THEN 'Order' || k || '.place' ELSE 'order' || k END AS name FROM o
      UNION ALL SELECT file, base + 9, base + 11, 'check' || k FROM o
      UNION ALL SELECT file, base + 13, base + 13, NULL FROM o),
    calls AS (
      SELECT 'svc/c_' || o_custkey || '.js' AS file, o_orderkey * 16 + 1 + l_linenumber AS line, 'part' || l_partkey AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT file, base + place, callee FROM o, (VALUES (10, 'audit'), (12, 'total'), (13, 'each'), (15, 'register')) t(place, callee))
    SELECT c.file, c.line, c.callee, s.name AS caller FROM calls c
    LEFT JOIN LATERAL (SELECT name FROM scopes s WHERE s.file = c.file AND c.line BETWEEN opens AND closes ORDER BY closes - opens LIMIT 1) s ON true
    """,
)
def function_calls(spark, sf_dir):
    return extract.extract_calls(A.call_lines(spark, sf_dir)).select("file", "line", "caller", "callee")


@query(
    "q50_component_lookahead",
    """
    WITH p AS (SELECT 'ui/' || replace(p_brand, '#', '') || '.jsx' AS file, p_partkey * 100 + 1 AS base, p_partkey, p_size FROM part)
    SELECT file, base AS line, 'Part' || p_partkey AS name, 'function' AS kind FROM p
    """,
)
def components(spark, sf_dir):
    return extract.extract_components(A.component_lines(spark, sf_dir)).select("file", "line", "name", "kind")


@query(
    "q50_first_hook",
    """
    SELECT 'ui/' || replace(p_brand, '#', '') || '.jsx' AS file, 'useSize' || p_size AS name, min(p_partkey * 100 + 61) AS line
    FROM part GROUP BY ALL
    """,
)
def first_hook(spark, sf_dir):
    return extract.extract_hooks(A.component_lines(spark, sf_dir)).select("file", "name", "line")


@query(
    "q52_notebooks",
    """
    WITH d AS (SELECT 'nb/n_' || doc_id || '.ipynb' AS file, lang, source, len(string_split(text, chr(10))) AS n FROM documents)
    SELECT file, 'notebook_structure' AS type, 1::BIGINT AS line, replace(substr(file, 4), '.ipynb', '') AS name, NULL AS role FROM d
    UNION ALL SELECT file, 'notebook_cell', n + 2, 'cell_2', 'imports' FROM d
    UNION ALL SELECT file, 'notebook_cell', n + 6, 'cell_3', 'visualization' FROM d
    UNION ALL SELECT file, 'notebook_import', n + 2, lang, NULL FROM d
    UNION ALL SELECT file, 'notebook_import', n + 2, 'pandas', NULL FROM d
    UNION ALL SELECT file, 'notebook_import', n + 3, source, NULL FROM d
    """,
)
def notebooks(spark, sf_dir):
    facts = extract.extract_notebook(A.notebook_files(spark, sf_dir))
    return facts.select("file", "type", "line", "name", F.col("extra")["role"].alias("role"))


@query(
    "q53_normalized_facts",
    """
    SELECT 'routes/nation_' || c_nationkey || '.js' AS file, '/c/' || c_custkey AS entity, 'router' AS receiver, count(*) AS n, 1::BIGINT AS ids
    FROM customer GROUP BY ALL
    """,
)
def normalized_facts(spark, sf_dir):
    facts = normalize_facts(extract.extract_routes(A.route_lines(spark, sf_dir)))
    return facts.groupBy("file", "entity", F.col("metadata")["receiver"].alias("receiver")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")
    )
