"""Streaming jobs run to the end on the tables, compared with what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import memory as M
from factloom.operators.extract import extract_html
from factloom.operators.facts import normalize_facts
from factloom.queries import query
from factloom.queries import sql as S
from factloom.session import fresh_folder
from factloom.sources import adapters as A
from factloom.sources.corpus import to_lines
from factloom.streaming import jobs as J

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("q45_experience_windows", """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n
    FROM events WHERE event_type <> 'signup' GROUP BY ALL""")
def experience_windows(spark, sf_dir):
    log, _ = M.log_experience(A.experience_runs(spark, sf_dir))
    return J.stream_activity(log, "1 hour", watermark=None).select("started", "outcome", "n")


@query("q45_sliding_windows", """
    WITH e AS (SELECT ts, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome FROM events WHERE event_type <> 'signup'),
    w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS started, outcome FROM e UNION ALL SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, outcome FROM e)
    SELECT started, outcome, count(*) AS n FROM w GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    log, _ = M.log_experience(A.experience_runs(spark, sf_dir))
    return J.stream_activity(log, "1 hour", "30 minutes", watermark=None).select("started", "outcome", "n")


_SESSIONS = """
    WITH m AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR AS gap FROM events),
    r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM m)
    SELECT 'u_' || user_id AS repo, min(ts) AS started, {end} count(*) AS n_changes FROM r GROUP BY user_id, run"""


def _changes(spark, sf_dir) -> DataFrame:
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("repo"), "ts")


@query("q46_debounce_sessions", _SESSIONS.format(end="max(ts) + INTERVAL 12 HOUR AS quiet_from,"))
def debounce_sessions(spark, sf_dir):
    return J.debounce_changes(_changes(spark, sf_dir), "12 hours", watermark=None)


@query("q46_bucketed_sessions", _SESSIONS.format(end="max(ts) AS ended,"))
def bucketed_sessions(spark, sf_dir):
    return J.batch_sessions(_changes(spark, sf_dir), "repo", 12 * 3600).select("repo", "started", "ended", "n_changes")


def _page_versions(spark, sf_dir) -> DataFrame:
    """Every page, then a shorter version of those served by https, then the end of all blogs."""
    pages = A.table(spark, sf_dir, "pages")
    files = A.page_files(spark, sf_dir)
    base = files.join(pages.select(F.regexp_replace("url", r"[?#].*\z", "").alias("url"), F.col("page_id")), F.regexp_extract("file", r"page_(\d+)\.html\z", 1).cast("long") == F.col("page_id"))

    def version(df: DataFrame, number: int, content, deleted: bool) -> DataFrame:
        return df.select(
            "repo", "file", content.alias("content"), F.timestamp_seconds(F.lit(1_700_000_000 + number)).alias("ts"), F.lit(deleted).alias("deleted")
        )

    first = version(base, 1, F.col("content"), False)
    second = version(base.filter(F.col("url").startswith("https:")), 2, F.substring_index("content", "</nav>", 1), False)
    third = version(base.filter(F.contains(F.col("url"), F.lit("//blog."))), 3, F.lit(None).cast("string"), True)
    return first.unionByName(second).unionByName(third)


def _write_versions(spark, sf_dir) -> str:
    folder = fresh_folder(spark, "changes")
    versions = _page_versions(spark, sf_dir)
    for number in (1, 2, 3):
        rows = versions.filter(F.col("ts") == F.timestamp_seconds(F.lit(1_700_000_000 + number)))
        rows.write.mode("append").parquet(folder)
    return folder


def _extract(files: DataFrame) -> DataFrame:
    return extract_html(to_lines(files))


_VERSIONS = f"""
{S.PAGE_FACTS},
meta AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) || '/page_' || page_id || '.html' AS file, starts_with(url, 'https:') AS second, contains(url, '//blog.') AS gone FROM pages),
nav AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) || '/page_' || page_id || '.html' AS file, split_part(html, '</nav>', 1) AS html FROM pages),
nav_lines AS (SELECT file, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS ln FROM nav),
short AS (
  SELECT file, ln AS line, 'doc_link' AS type, unnest(regexp_extract_all(line, {S._A}, 1)) AS target, {S.trim("unnest(regexp_extract_all(line, " + S._A + ", 2))")} AS name FROM nav_lines
  UNION ALL SELECT file, ln, 'doc_heading', NULL, {S.trim("unnest(regexp_extract_all(line, " + S._H + ", 2))")} FROM nav_lines)
"""


@query("q47_stream_equals_batch", f"""
    WITH {_VERSIONS}
    SELECT f.file, CAST(f.line AS BIGINT) AS line, f.type, f.target FROM page_facts f JOIN meta USING (file) WHERE NOT second AND NOT gone
    UNION ALL SELECT f.file, CAST(f.line AS BIGINT), f.type, f.target FROM short f JOIN meta USING (file) WHERE second AND NOT gone""")
def stream_equals_batch(spark, sf_dir):
    folder = _write_versions(spark, sf_dir)
    log, checkpoint = fresh_folder(spark, "facts"), fresh_folder(spark, "state")
    J.stream_corpus(J.read_changes(spark, folder, 1), _extract, log, checkpoint).awaitTermination()
    return J.current_facts(spark.read.parquet(log)).select("file", "line", "type", "target")


@query("q47_heartbeat_drift", f"""
    WITH {_VERSIONS},
    now AS (SELECT file, ln, line FROM nav_lines), had AS (SELECT f.*, second, gone FROM page_facts f JOIN meta USING (file))
    SELECT h.file, CAST(h.line AS BIGINT) AS line, h.type, h.target,
      CASE WHEN gone THEN 'file_missing' WHEN n.line IS NULL THEN 'line_gone' ELSE 'stale' END AS status
    FROM had h LEFT JOIN now n ON n.file = h.file AND n.ln = h.line AND second AND NOT gone
    WHERE gone OR (second AND (n.line IS NULL OR {S.trim('n.line')} <> {S.trim('h.text')}))""")
def heartbeat_drift(spark, sf_dir):
    """Recorded page facts against the newest versions, one trigger at a time; the last word per fact counts."""
    folder = _write_versions(spark, sf_dir)
    out, checkpoint = fresh_folder(spark, "drift"), fresh_folder(spark, "state")
    facts = A.page_facts(spark, sf_dir)
    J.heartbeat_drift(J.read_changes(spark, folder), facts, out, checkpoint).awaitTermination()
    drifted = spark.read.parquet(out).select("id", "status")
    return drifted.join(facts.select("id", "file", "line", "type", "target"), "id").select("file", "line", "type", "target", "status")


@query("q47_stream_delta", f"""
    WITH {_VERSIONS},
    b AS (SELECT f.file, f.type, name, count(*) AS n FROM page_facts f JOIN meta USING (file) WHERE second OR gone GROUP BY ALL),
    v2 AS (SELECT s.file, s.type, s.name, count(*) AS n FROM short s JOIN meta USING (file) WHERE second GROUP BY ALL),
    removed2 AS (SELECT b.file, b.type, b.name, b.n - coalesce(v2.n, 0) AS n FROM b JOIN meta USING (file) LEFT JOIN v2 USING (file, type, name) WHERE second AND b.n > coalesce(v2.n, 0)),
    removed3 AS (SELECT file, v2.n AS n FROM v2 JOIN meta USING (file) WHERE gone UNION ALL SELECT file, b.n FROM b JOIN meta USING (file) WHERE gone AND NOT second)
    SELECT 'added' AS side, file, count(*) AS n FROM page_facts GROUP BY file
    UNION ALL SELECT 'removed', file, CAST(sum(n) AS BIGINT) FROM (SELECT file, n FROM removed2 UNION ALL SELECT file, n FROM removed3) GROUP BY file""")
def stream_delta(spark, sf_dir):
    """File versions as a stream, one trigger each: additions and removals per fact, told from absence and deletion."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    folder, out, checkpoint = _write_versions(spark, sf_dir), fresh_folder(spark, "delta"), fresh_folder(spark, "state")

    def extract(files: DataFrame) -> DataFrame:
        return extract_html(to_lines(files, keep=["ts"]).select("repo", "file", "ln", "line", "ts"), keep=["ts"])

    job = J.stream_version_delta(J.read_changes(spark, folder), extract).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(J.DELTA_OUT).parquet(out).groupBy("side", "file").agg(F.sum("n").alias("n"))
