"""Shared SQL fragments: what the adapters stand for, said in terms of the tables."""

from factloom.functions.text import WHITE_SPACE

WS = "'" + WHITE_SPACE + "'"


def trim(expr: str) -> str:
    return f"trim({expr}, {WS})"


def snippet(expr: str) -> str:
    return f"substr({trim(expr)}, 1, 160)"


# Distinct parts per order, before and after the change.
IMPORTS = """
imp AS (SELECT l_orderkey AS ok, l_partkey AS pk, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL),
imp2 AS (SELECT l_orderkey AS ok, l_partkey AS pk, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem
         WHERE l_returnflag <> 'R' GROUP BY ALL),
audited AS (SELECT o_orderkey AS ok FROM orders WHERE o_orderstatus = 'F')
"""


def order_file(key: str) -> str:
    return f"'orders/o_' || {key} || '.js'"


def part_target(key: str) -> str:
    return f"'../parts/p_' || {key} || '.js'"


_A = """'(?i)<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)'"""
_H = """'(?i)<h([1-6])[^>]*>([^<]*)'"""

# Links and headings of pages: (file, line, type, name, target, pos).
PAGE_FACTS = f"""
page_lines AS (
  SELECT regexp_extract(url, '^https?://([^?#]*)', 1) || '/page_' || page_id || '.html' AS file,
         unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS ln
  FROM pages),
page_facts AS (
  SELECT file, ln AS line, 'doc_link' AS type, {trim("unnest(regexp_extract_all(line, " + _A + ", 2))")} AS name,
         unnest(regexp_extract_all(line, {_A}, 1)) AS target,
         generate_subscripts(regexp_extract_all(line, {_A}, 1), 1) - 1 AS pos, line AS text
  FROM page_lines
  UNION ALL
  SELECT file, ln, 'doc_heading', {trim("unnest(regexp_extract_all(line, " + _H + ", 2))")}, NULL,
         1000000 + generate_subscripts(regexp_extract_all(line, {_H}, 1), 1) - 1, line
  FROM page_lines)
"""
