"""Sources, logs, quarantine and registry: what the other modules do not reach by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import derive
from factloom.operators import memory as M
from factloom.operators.facts import normalize_facts
from factloom.operators.packs import SHELL
from factloom.operators.rules import extract_lines
from factloom.queries import query
from factloom.queries.packs import shell_lines
from factloom.registry import Extractor, Registry, guarded, split_errors
from factloom.session import fresh_folder
from factloom.sources import adapters as A
from factloom.sources.corpus import read_corpus, write_corpus
from factloom.sources.snapshots import append_log, read_jsonl_log

LONG = 5000


def _documents(spark, sf_dir, ending: str):
    key = F.col("doc_id").cast("string")
    return A.table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("d_"), key, F.lit(ending)).alias("file"), F.col("text").alias("content"))


@query("q67_read_corpus", "SELECT doc_id, strlen(text) + 1 AS size, md5(text || chr(10)) AS digest FROM documents")
def corpus_files(spark, sf_dir):
    """Every document written as a file of its own folder and read back by the folder source."""
    folder = fresh_folder(spark, "tree")
    name = F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("/text.txt"))
    write_corpus(A.table(spark, sf_dir, "documents").select(name.alias("file"), "text"), folder)
    found = read_corpus(spark, {"docs": folder}).filter(F.col("file").endswith(".txt"))
    return found.select(F.regexp_extract("file", r"doc_id=(\d+)/", 1).cast("long").alias("doc_id"), "size", F.md5("content").alias("digest"))


@query("q67_quarantine", f"""
    SELECT 'd_' || doc_id || '.txt' AS file, CASE WHEN length(text) > {LONG} THEN 'too long' ELSE 'size ' || length(text) END AS said, length(text) > {LONG} AS failed FROM documents""")
def quarantine(spark, sf_dir):
    """A plain function that raises on some files: they become warnings, the others give their facts."""

    def measure(file, content):
        if len(content) > LONG:
            raise ValueError("too long")
        return [{"line": 1, "name": f"size {len(content)}"}]

    facts, warnings = split_errors(guarded(measure, "doc_size")(_documents(spark, sf_dir, ".txt")), "sizes")
    return facts.select("file", F.col("name").alias("said"), F.lit(False).alias("failed")).unionByName(
        warnings.select("file", F.col("error").alias("said"), F.lit(True).alias("failed"))
    )


@query("q67_jsonl_log", """
    SELECT conv_id, role, count(*) + count_if(role = 'user') AS n FROM conversations WHERE role IS NOT NULL GROUP BY ALL
    UNION ALL SELECT conv_id, 'broken', 1 FROM (SELECT DISTINCT conv_id FROM conversations)""")
def jsonl_log(spark, sf_dir):
    """A log appended to three times, once with lines that are not JSON."""
    path = fresh_folder(spark, "log")
    turns = A.table(spark, sf_dir, "conversations").filter(F.col("role").isNotNull()).select("conv_id", "turn", "role")
    append_log(turns, path)
    append_log(turns.filter(F.col("role") == "user"), path)
    A.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("{broken "), F.col("conv_id").cast("string"))).write.mode("append").text(path)
    log = read_jsonl_log(spark, path, "conv_id long, turn int, role string")
    conv = F.coalesce("entry.conv_id", F.regexp_extract("raw", r"\A\{broken (-?\d+)", 1).cast("long"))
    return log.groupBy(conv.alias("conv_id"), F.coalesce("entry.role", F.lit("broken")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("q67_shell_dependency", """
    SELECT 'src/' || replace(p_brand, '#', '') || '.sh' AS file, 'shell_dependency' AS type, count(DISTINCT p_size) AS n_targets, count(*) AS n_support FROM part GROUP BY ALL""")
def shell_dependency(spark, sf_dir):
    facts = normalize_facts(extract_lines(shell_lines(spark, sf_dir), SHELL))
    nodes = derive.file_nodes(derive.dependency_support(facts))
    return nodes.select("file", "type", "n_targets", "n_support")


@query("q67_incomplete_notice", "SELECT DISTINCT 'u_' || user_id AS repo, 'scan_incomplete_notice' AS type, 'high' AS confidence FROM events")
def incomplete_notice(spark, sf_dir):
    return derive.incomplete_notice(A.experience_runs(spark, sf_dir).select("repo")).select("repo", "type", "confidence")


@query("q67_list_rules", """
    SELECT 'u_' || user_id AS repo, 'rule ' || props AS rule FROM events WHERE event_type = 'purchase' AND trim(coalesce(props, '')) <> ''""")
def list_rules(spark, sf_dir):
    """Approved rules alone: one proposed per event, those of purchases approved."""
    events = A.table(spark, sf_dir, "events").filter(F.trim(F.coalesce("props", F.lit(""))) != "")
    repo = F.concat(F.lit("u_"), F.col("user_id").cast("string"))
    proposals = events.select(repo.alias("repo"), F.concat(F.lit("rule "), F.col("props")).alias("rule"), F.col("event_type").alias("category"), F.col("event_id").cast("string").alias("evidence_note"), "ts")
    rules, _ = M.propose_rules(proposals)
    approvals = rules.filter(F.col("category") == "purchase").select("id", F.lit("approved").alias("status"), "ts")
    return M.list_rules(M.set_status(rules, approvals)[0], "approved").select("repo", "rule")


@query("q67_approved_failures", """
    SELECT DISTINCT event_type AS task, 'value ' || CAST(floor(value) AS BIGINT) AS strategy FROM events WHERE event_type = 'error' AND value IS NOT NULL""")
def approved_failures(spark, sf_dir):
    """Attempts proposed from all events; those on errors approved, the others rejected."""
    proposals = A.experience_runs(spark, sf_dir).select("task", "strategy", F.lit("manual").alias("source"), F.col("evidence_source").alias("evidence"), "ts")
    attempts = M.propose_attempts(proposals.filter(F.lit(False)).select(F.col("task").alias("id")), proposals)
    verdicts = attempts.select("id", F.when(F.col("task") == "error", "approved").otherwise("rejected").alias("status"), "ts")
    return M.approved_failures(M.set_status(attempts, verdicts)[0]).select("task", "strategy")


@query("q67_registered_extractor", """
    SELECT source AS repo, 'd_' || doc_id || '.doc' AS file, lang AS name FROM documents""")
def registered_extractor(spark, sf_dir):
    """An extractor with an ending of its own; once removed it gives nothing."""
    documents = A.table(spark, sf_dir, "documents")
    langs = documents.select(F.concat(F.lit("d_"), F.col("doc_id").cast("string"), F.lit(".doc")).alias("file"), F.col("lang").alias("name"))

    def languages(files):
        return files.select("repo", "file").join(langs, "file").select("repo", F.lit("doc_language").alias("type"), "file", F.lit(1).alias("line"), "name")

    registry = Registry()
    unregister = registry.register(Extractor("doc-language", "docFiles", "facts", languages, (".doc",)))
    files = _documents(spark, sf_dir, ".doc")
    others = [name for name, _, _ in registry.list() if name != "doc-language"]
    facts, _, _ = registry.run(files, skip=others)
    unregister()
    after, _, _ = registry.run(files, skip=others)
    found = facts.filter(F.col("type") == "doc_language").select("repo", "file", "name")
    return found.unionByName(after.filter(F.col("type") == "doc_language").select("repo", "file", "name"))
