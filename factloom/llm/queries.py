"""Named queries of this subpackage over the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import conversations, language, quality, toxicity
from factloom.llm.common import held_out, table
from factloom.llm.decontaminate import find_items
from factloom.llm.fingerprints import simhash_groups
from factloom.llm.html_text import extract_pages
from factloom.llm.near_duplicates import near_duplicates
from factloom.llm.nearest import search
from factloom.llm.packing import pack_documents
from factloom.llm.repeats import cut_repeats
from factloom.llm.url_reputation import Rule, filter_urls
from factloom.llm.variants import variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}

URL_RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            EXPECTED[name] = sql
        return run

    return register


@query("op1_html_text")
def html_text(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op2_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_WORDS_SQL = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@query("op3_decontamination", f"""
    WITH items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
    starts AS (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS win, len(list_slice(w, s, s + 9)) AS size FROM starts),
    sizes AS (SELECT DISTINCT size FROM windows),
    docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, sizes),
    hits AS (SELECT doc_id, item_id, s, p.size FROM (SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win FROM places) p JOIN windows USING (win, size)),
    words AS (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS at FROM hits),
    n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
    i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
        sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)""")
def decontamination(spark, sf_dir):
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op6_language_id")
def language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = language.identify(documents.select("doc_id", "text"), language.learn(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op4_toxicity")
def toxicity_scores(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_quality")
def quality_scores(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = quality.learn(documents, table(spark, sf_dir, "labels"))
    return quality.score_quality(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op5_near_duplicates")
def near_duplicate_groups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_repeated_bytes")
def repeated_bytes(spark, sf_dir):
    found = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _strength_sql(level: str) -> str:
    """One row (m, k): mean share and prior strength of a level's groups (bad, n)."""
    return f"""
    {level}_sums AS (SELECT coalesce(sum(bad), 0) AS bad, coalesce(sum(n), 0) AS n, count(*) AS g, sum(CAST(n AS DOUBLE) * n) AS sq, sum(CAST(bad AS DOUBLE) / n * bad) AS spread FROM {level} WHERE n > 0),
    {level}_mean AS (SELECT *, (bad + 1) / CAST(n + 2 AS DOUBLE) AS mean FROM {level}_sums),
    {level}_var AS (SELECT *, mean * (1 - mean) AS within, n - sq / n - (g - 1) AS size,
        spread - 2 * mean * bad + mean * mean * n - mean * (1 - mean) * (g - 1) AS between_ FROM {level}_mean),
    {level}_k AS (SELECT CASE WHEN n = 0 THEN 0.5 ELSE mean END AS m, CASE WHEN n = 0 THEN 0.5 WHEN size > 0 AND between_ / (within * size) > 0
        THEN least(greatest(1 / (between_ / (within * size)) - 1, 0.5), 10000.0) ELSE 10000.0 END AS k FROM {level}_var)"""


@query("op9_url_reputation", rf"""
    WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    judged AS (SELECT *, '.' || host AS dotted,
        CASE WHEN dotted LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7' WHEN dotted LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
             WHEN dotted LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/' WHEN dotted LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
             WHEN dotted LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule,
        CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 0 WHEN rule IS NOT NULL THEN 1 END AS bad FROM parts),
    hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM judged GROUP BY host),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
    {_strength_sql("suffixes")}, {_strength_sql("domains")}, {_strength_sql("hosts")},
    s AS (SELECT suffix, (bad + k * m) / (n + k) AS share FROM suffixes, suffixes_k),
    d AS (SELECT domain, (bad + k * s.share) / (n + k) AS share FROM domains JOIN s USING (suffix), domains_k),
    h AS (SELECT host, (bad + k * d.share) / (n + k) AS share, n + k AS weight FROM hosts JOIN d USING (domain), hosts_k)
    SELECT page_id, host, path, rule, CASE bad WHEN 1 THEN 'block' WHEN 0 THEN 'allow'
        ELSE CASE WHEN h.share - 1.6448536269514722 * sqrt(h.share * (1 - h.share) / (weight + 1)) >= 0.5 THEN 'block' ELSE 'allow' END END AS verdict
    FROM judged JOIN h USING (host)""")
def url_reputation(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op11_simhash_groups")
def simhash_components(spark, sf_dir):
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


#: CRC-32 of a text column as SQL: the table of 256 remainders follows from the polynomial.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"


def _crc_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII or Latin text; a character of the two bytes C2 or C3 and another is two."""
    codes = f"""flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)]
        ELSE [192 + (unicode(s) >> 6), 128 + (unicode(s) & 63)] END))"""
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, crc_table.t[xor(c & 255, b) + 1])))"


@query("op12_spelling_variants", rf"""
    WITH RECURSIVE crc_table AS (SELECT {_CRC_TABLE} AS t),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT run, n, {_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM counted, crc_table),
    words AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % len(run)) || substr(run, CAST(h % len(run) + 2 AS BIGINT)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed
        GROUP BY 1 HAVING len(word) >= 6 AND sum(n) >= 5),
    gaps AS (SELECT word, n, spot, left(word, spot - 1) || substr(word, spot + 1) AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS spot FROM words)),
    pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
    near AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'form': other}}) AS best FROM pairs GROUP BY word),
    known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.form END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n
        FROM words LEFT JOIN near USING (word)),
    chain AS (SELECT word, word AS root FROM known UNION ALL SELECT chain.word, form FROM chain JOIN known ON known.word = chain.root WHERE form IS NOT NULL),
    ends AS (SELECT chain.word, root FROM chain JOIN known ON known.word = root WHERE form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM known JOIN ends USING (word)""")
def spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))


def _ways_sql() -> str:
    """Ways of one row from state to state, as rows of values: class, from, to, cost, letters."""
    rows = [
        f"('{initial}{fault}', {start}, {end}, {price}, '{letters}')"
        for (initial, fault), ways in conversations.WAYS.items() for end, sources in enumerate(ways) for start, price, letters in sources
    ]
    return ", ".join(rows)


_SPACE = r"[\x20\x09-\x0D]"


@query("op13_conversation_repair", rf"""
    WITH RECURSIVE crc_table AS (SELECT {_CRC_TABLE} AS t),
    ways(kind, p, q, price, letters) AS (VALUES {_ways_sql()}),
    drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, crc_table),
    damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE d WHEN 3 THEN [1, 2] ELSE [1] END) FROM drawn WHERE d <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS copy,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial FROM placed),
    laid AS (SELECT *, CASE WHEN regexp_full_match(text, '{_SPACE}*') THEN 'blank' WHEN copy > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?]{_SPACE}*\z') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM seen),
    last AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM laid GROUP BY conv_id),
    way(conv_id, k, state, cost, audit) AS (
        SELECT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '' FROM last
        UNION ALL
        SELECT conv_id, k, q, best.cost, best.audit FROM (
            SELECT way.conv_id, laid.k, q, min({{'cost': way.cost + price, 'audit': way.audit || letters}}) AS best
            FROM way JOIN laid ON laid.conv_id IS NOT DISTINCT FROM way.conv_id AND laid.k = way.k + 1 JOIN ways ON kind = initial || fault AND p = state GROUP BY ALL)),
    ended AS (SELECT w.conv_id, min({{'cost': cost + 3 * len(tail), 'audit': audit || tail}}) AS best FROM (SELECT *, CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS tail FROM way) w
        JOIN last ON last.conv_id IS NOT DISTINCT FROM w.conv_id AND n = k GROUP BY 1),
    steps AS (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS j FROM ended),
    ops AS (SELECT conv_id, j, audit[j] AS op, len(replace(left(audit, j), 'I', '')) AS k, len(replace(left(audit, j), 'D', '')) AS spot FROM steps),
    kept AS (SELECT ops.*, laid.role, laid.text, max(CASE WHEN spot = 1 AND op = 'K' AND laid.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY ops.conv_id) AS opened
        FROM ops JOIN laid ON laid.conv_id IS NOT DISTINCT FROM ops.conv_id AND laid.k = greatest(ops.k, 1) WHERE op <> 'D'),
    hashes AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (spot - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM kept GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashes ON hashes.conv_id IS NOT DISTINCT FROM c.conv_id""")
def conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damage(rows))
