"""A cross-section of the registered queries against their SQL at the smallest scale.

``python tests/compare.py 0.01`` runs all of them.
"""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("q02_coverage", "q03_imports", "q09_page_links", "q18_verify_drift", "q22_claims", "q30_ledger_verify", "q38_insights", "q42_grounding", "q49_function_calls_caller")


def test_every_query_is_named_once_and_has_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note, _, _ = compare(spark, connect(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, note
