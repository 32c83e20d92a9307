"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "q01_lines_explode", "q03_imports", "q04_file_dependency", "q05_impact", "q06_transitive_impact", "q09_page_links", "q12_secrets",
    "q18_verify_drift", "q20_delta", "q21_provenance", "q22_claims", "q25_unreviewed_dependents", "q27_text_search", "q28_dossier",
    "q29_doc_contradictions", "q30_ledger_verify", "q33_retrieve", "q36_rank", "q38_insights", "q39_triage", "q40_budget",
    "q42_grounding", "q46_bucketed_sessions", "q49_function_calls_caller", "q51_source_excerpt",
)


def main() -> None:
    from factloom import queries
    from factloom.session import local_session, release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "factloom-bench", **{"spark.sql.shuffle.partitions": str(max(int(cpus), 8))})
    queries.load_all()
    # One small query first, so that the first measured one does not pay for starting up.
    queries.QUERIES["q07_routes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
