"""Dossiers, briefs and documentation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import documents as D
from factloom.operators import dossier as B
from factloom.operators import memory as M
from factloom.operators.extract import extract_config, extract_imports
from factloom.operators.facts import normalize_facts
from factloom.operators.rules import merge
from factloom.queries import query
from factloom.queries import sql as S
from factloom.session import cut_lineage
from factloom.sources import adapters as A


def _files(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select(F.lit(A.SHOP).alias("repo"), F.concat(F.lit("orders/o_"), F.col("o_orderkey").cast("string"), F.lit(".js")).alias("file"))
    customers = A.table(spark, sf_dir, "customer").select(F.lit(A.SHOP).alias("repo"), F.concat(F.lit("customers/c_"), F.col("c_custkey").cast("string"), F.lit(".js")).alias("file"))
    missing = A.table(spark, sf_dir, "supplier").select(F.lit(A.SHOP).alias("repo"), F.concat(F.lit("none/s_"), F.col("s_suppkey").cast("string"), F.lit(".js")).alias("file"))
    return orders.unionByName(customers), missing


def _facts(spark, sf_dir):
    lines = merge([A.import_lines(spark, sf_dir), A.order_lines(spark, sf_dir), A.customer_lines(spark, sf_dir)])
    return cut_lineage(normalize_facts(extract_imports(lines)), "facts")


@query("q28_dossier", f"""
    WITH {S.IMPORTS},
    per_customer AS (SELECT o_custkey AS ck, count(*) AS n FROM orders GROUP BY ALL),
    per_order AS (SELECT ok, count(*) AS n FROM imp GROUP BY ok)
    SELECT {S.order_file('o_orderkey')} AS file, coalesce(n, 0) AS n_facts, coalesce(n, 0) AS n_imports, 1::BIGINT AS n_source_dependents, 0::BIGINT AS n_test_dependents, NULL AS error
    FROM orders LEFT JOIN per_order ON ok = o_orderkey
    UNION ALL SELECT 'customers/c_' || c_custkey || '.js', coalesce(n, 0), coalesce(n, 0), 0, 1, NULL FROM customer LEFT JOIN per_customer ON ck = c_custkey
    UNION ALL SELECT 'none/s_' || s_suppkey || '.js', 0, 0, 0, 0, 'file not found in project: none/s_' || s_suppkey || '.js' FROM supplier""")
def dossier(spark, sf_dir):
    known, missing = _files(spark, sf_dir)
    rows = B.dossier(known.unionByName(missing), known, _facts(spark, sf_dir))
    return rows.select("file", "n_facts", "n_imports", "n_source_dependents", "n_test_dependents", "error")


@query("q28_dossier_dependents", f"""
    SELECT {S.order_file('o_orderkey')} AS target, 'customers/c_' || o_custkey || '.js' AS file, false AS is_test FROM orders
    UNION ALL SELECT 'customers/c_' || c_custkey || '.js', 'test/nation_' || c_nationkey || '.test.js', true FROM customer""")
def dossier_dependents(spark, sf_dir):
    known, _ = _files(spark, sf_dir)
    return B.dossier_dependents(known, _facts(spark, sf_dir)).select("target", "file", "is_test")


@query("q28_dossier_imports", f"WITH {S.IMPORTS} SELECT {S.order_file('ok')} AS file, {S.part_target('pk')} AS target FROM imp")
def dossier_imports(spark, sf_dir):
    known, _ = _files(spark, sf_dir)
    return B.dossier_imports(known, A.import_facts(spark, sf_dir)).select("file", "target")


@query("q29_doc_contradictions", """
    WITH h AS (SELECT DISTINCT l_orderkey AS ok, l_partkey AS pk FROM lineitem),
    d AS (SELECT 'docs/o_' || ok || '.md' AS file, pk + 1 AS line, pk, p_size FROM h LEFT JOIN part ON p_partkey = pk)
    SELECT 'broken_link' AS kind, file, line, 'link target not found: ../parts/p_' || pk || '.md#top' AS detail FROM d WHERE coalesce(p_size, 0) < 25
    UNION ALL SELECT 'missing_path', file, line, 'possible: documented path does not exist: parts/p_' || pk || '.md' FROM d WHERE coalesce(p_size, 0) < 25
    UNION ALL SELECT 'missing_npm_script', file, line, 'npm run pack-' || pk % 100 || ' is documented but package.json has no such script' FROM d
      WHERE pk % 100 NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT 'missing_npm_script', file, line, 'npm test is documented but package.json has no test script' FROM d""")
def doc_contradictions(spark, sf_dir):
    lines = A.handbook_lines(spark, sf_dir)
    files = A.handbook_files(spark, sf_dir).unionByName(A.files_of(lines))
    return D.contradictions(lines, files, A.handbook_manifest(spark, sf_dir)).select("kind", "file", "line", "detail")


@query("q29_page_broken_links", rf"""
    WITH {S.PAGE_FACTS},
    links AS (SELECT file, line, target, regexp_replace(target, '[#?].*$', '') AS path FROM page_facts
      WHERE type = 'doc_link' AND target <> '' AND NOT regexp_matches(target, '[()\s<>]') AND NOT regexp_matches(target, '(?i)^(?:[a-z][a-z0-9+.-]*:|#|//)')),
    joined AS (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE regexp_replace(file, '[^/]*$', '') || path END AS full_path FROM links WHERE path <> ''),
    steps AS (SELECT *, list_filter(string_split(full_path, '/'), lambda s: s NOT IN ('', '.')) AS parts FROM joined),
    -- A step back takes away the step before it; from the top it stays.
    resolved AS (SELECT *, list_reduce(list_prepend('', parts), lambda acc, s: CASE WHEN s = '..' AND acc <> '' AND NOT regexp_matches(acc, '(^|/)\.\.$') THEN regexp_replace(acc, '/?[^/]*$', '')
      WHEN acc = '' THEN s ELSE acc || '/' || s END) AS spot FROM steps),
    known AS (SELECT DISTINCT file FROM page_facts UNION SELECT DISTINCT file FROM page_lines),
    folders AS (SELECT DISTINCT array_to_string(p[:i], '/') AS path FROM (SELECT string_split(file, '/') AS p, unnest(range(1, len(string_split(file, '/')) + 1)) AS i FROM known))
    SELECT file, CAST(line AS BIGINT) AS line, target FROM resolved WHERE spot NOT IN ('', '.') AND spot NOT IN (SELECT path FROM folders)""")
def page_broken_links(spark, sf_dir):
    """All links of the pages that can be written as document links."""
    links = A.page_facts(spark, sf_dir).filter((F.col("type") == "doc_link") & ~F.col("target").rlike(r"[()\s<>]"))
    lines = links.select("repo", F.regexp_replace("file", r"\.html\z", ".md").alias("file"), F.col("line").alias("ln"), F.concat(F.lit("see [x]("), F.col("target"), F.lit(")")).alias("line"))
    found = D.broken_links(lines, D.existing_paths(A.page_files(spark, sf_dir).select("repo", "file")))
    return found.select(F.regexp_replace("file", r"\.md\z", ".html").alias("file"), "line", F.substring_index("detail", ": ", -1).alias("target"))


_FAILURES = """
    f AS (
      SELECT 'u_' || user_id AS repo, 0 AS src, event_type AS task, 'value ' || CAST(floor(value) AS BIGINT) AS strategy, ts, 'failure' AS outcome FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'u_' || user_id, 1, event_type, 'props ' || props, ts, 'failed' FROM events WHERE event_type = 'click' AND value > 20),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY src DESC, ts DESC, task DESC, strategy DESC) AS age, count(*) OVER (PARTITION BY repo) AS n FROM f)"""


def _failures(spark, sf_dir):
    """Failed runs from the experience log, and attempts on clicks, approved where their value is over 20."""
    log, _ = M.log_experience(A.experience_runs(spark, sf_dir))
    clicks = A.table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    attempts = clicks.select(
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("repo"), "ts", F.col("event_type").alias("task"), F.concat(F.lit("props "), F.col("props")).alias("strategy"),
        F.when(F.col("value") > 20, "approved").otherwise("proposed").alias("status"),
    )
    return log, attempts


@query("q65_brief_failures", f"""
    WITH {_FAILURES} SELECT repo, CAST(age AS BIGINT) AS age, strategy, task, outcome, n - 5 AS more FROM ranked WHERE age <= 5""".replace("n - 5", "greatest(n - 5, 0)"))
def brief_failures(spark, sf_dir):
    shown, more = B.brief_failures(*_failures(spark, sf_dir))
    return shown.join(more, "repo").select("repo", F.col("age").cast("long").alias("age"), "strategy", "task", "outcome", "more")


def _rules(spark, sf_dir):
    """A rule per event, approved where it is a purchase."""
    return A.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("repo"), F.col("event_id").cast("string").alias("id"), "ts",
        F.concat(F.lit("rule "), F.col("props")).alias("rule"), F.when(F.col("event_type") == "purchase", "approved").otherwise("proposed").alias("status"),
    )


@query("q65_brief_rules", """
    WITH r AS (SELECT 'u_' || user_id AS repo, event_id, ts, CASE WHEN event_type = 'purchase' THEN 'approved' ELSE 'proposed' END AS status FROM events)
    SELECT repo, count_if(status = 'approved' AND rank <= 10) AS shown, greatest(count_if(status = 'approved') - 10, 0) AS more, count_if(status = 'proposed') AS not_approved
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, status ORDER BY ts) AS rank FROM r) GROUP BY repo""")
def brief_rules(spark, sf_dir):
    shown, counts = B.brief_rules(_rules(spark, sf_dir))
    per_repo = shown.groupBy("repo").agg(F.count(F.lit(1)).alias("shown"))
    return counts.join(per_repo, "repo", "left").select("repo", F.coalesce("shown", F.lit(0)).alias("shown"), "more", "not_approved")


@query("q65_brief", f"""
    WITH {_FAILURES},
    rules AS (SELECT 'u_' || user_id AS repo, 'rule ' || props AS rule, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS rank FROM events WHERE event_type = 'purchase'),
    items AS (
      SELECT 'u_' || user_id AS repo, 0 AS part, 'files' AS section, 'events/e_' || event_id || '.json' AS key,
        'events/e_' || event_id || '.json: ' || (2 + len(json_keys(props))) || ' facts, 0 dependent sources, 0 tests, 0 findings' AS text FROM events WHERE event_type = 'error'
      UNION ALL SELECT repo, 1, 'rules', printf('%06d', rank), rule FROM rules WHERE rank <= 10
      UNION ALL SELECT repo, 2, 'failures', printf('%06d', 999999 - age), strategy || ' | ' || task || ' | ' || outcome FROM ranked WHERE age <= 5),
    placed AS (SELECT *, row_number() OVER w AS pos, sum(len(text) + 1) OVER w AS ends FROM items WINDOW w AS (PARTITION BY repo ORDER BY part, key, text))
    SELECT repo, pos, section, text FROM placed WHERE ends <= 900 AND repo IN (SELECT repo FROM items WHERE part = 0)""")
def brief(spark, sf_dir):
    """A brief per user for work on the files of its errors, cut at 900 characters."""
    return _brief(spark, sf_dir)[0]


def _brief(spark, sf_dir):
    events, files = A.table(spark, sf_dir, "events"), A.config_files(spark, sf_dir)
    repo = F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("repo")
    asked = events.filter(F.col("event_type") == "error").select(repo, F.concat(F.lit("events/e_"), F.col("event_id").cast("string"), F.lit(".json")).alias("file"))
    facts = cut_lineage(normalize_facts(extract_config(files)), "facts")
    return B.brief(asked, files, facts, _rules(spark, sf_dir), *_failures(spark, sf_dir), max_chars=900)


@query("q65_brief_left_out", f"""
    WITH {_FAILURES},
    u AS (SELECT 'u_' || user_id AS repo, count_if(event_type = 'purchase') AS approved, count_if(event_type <> 'purchase') AS not_approved, count_if(event_type = 'error') AS errors FROM events GROUP BY user_id),
    n AS (SELECT repo, max(n) AS n FROM ranked GROUP BY repo)
    SELECT u.repo, greatest(approved - 10, 0) AS more_rules, not_approved, greatest(coalesce(n, 0) - 5, 0) AS more_failures FROM u LEFT JOIN n USING (repo) WHERE errors > 0""")
def brief_left_out(spark, sf_dir):
    return _brief(spark, sf_dir)[1].drop("chars_left_out")
