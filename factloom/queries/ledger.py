"""Review ledgers, memory, experience and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import ledger as L
from factloom.operators import memory as M
from factloom.queries import query
from factloom.session import cut_lineage
from factloom.sources import adapters as A

_BODY = """'{"v":1,"ts":"e' || event_id || '","base":"HEAD","head":null,"overall":"' || CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END ||
  '","reasons":["' || event_type || '"],"changedFiles":1,"results":[{"claim":"handled ' || event_type || '","verdict":"' ||
  CASE WHEN event_type = 'error' THEN 'contradicted' ELSE 'supported' END || '","reason":"checked","evidence":[]}]'"""
_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)"
_CHAIN = f"""
RECURSIVE {_NUMBERED},
bodies AS (SELECT user_id, seq, event_type, value, {_BODY} AS head FROM numbered),
chain(user_id, seq, hash) AS (
  SELECT user_id, seq, sha256(head || ',"prev":"genesis"}}') FROM bodies WHERE seq = 0
  UNION ALL
  SELECT b.user_id, b.seq, sha256(b.head || ',"prev":"' || c.hash || '"}}') FROM chain c JOIN bodies b ON b.user_id = c.user_id AND b.seq = c.seq + 1)
"""


#: Entries of a ledger that are there before the others are appended, and of a segment in these queries.
_BEFORE, _SEGMENT = 3, 16


def _ledger(spark, sf_dir, segment=L.SEGMENT):
    """Every ledger in two appends, the second of which goes on from the first."""
    reviews = A.reviews(spark, sf_dir)
    first = cut_lineage(L.ledger_append(_empty(spark, sf_dir), reviews.filter(F.col("seq") < _BEFORE), segment), "ledger")
    later = reviews.filter(F.col("seq") >= _BEFORE).withColumn("seq", F.col("seq") - _BEFORE)
    return first.unionByName(L.ledger_append(first, later, segment))


def _empty(spark, sf_dir):
    """A ledger without entries, keyed like the reviews."""
    return A.table(spark, sf_dir, "events").filter(F.lit(False)).select(
        F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), F.col("props").alias("raw")
    )


@query("q30_ledger_append", f"WITH {_CHAIN} SELECT user_id AS ledger, seq, hash FROM chain")
def ledger_append(spark, sf_dir):
    return _ledger(spark, sf_dir).select("ledger", "seq", F.get_json_object("raw", "$.hash").alias("hash"))


_SEGMENTS = f"""
RECURSIVE {_NUMBERED},
bodies AS (SELECT user_id, seq, {_BODY} AS head FROM numbered),
chain(user_id, seq, hash) AS (
  SELECT user_id, seq, sha256(head || ',"prev":"' || CASE seq WHEN 0 THEN 'genesis' ELSE 'segment-' || seq // {_SEGMENT} END || '"}}') FROM bodies WHERE seq % {_SEGMENT} = 0
  UNION ALL
  SELECT b.user_id, b.seq, sha256(b.head || ',"prev":"' || c.hash || '"}}') FROM chain c JOIN bodies b ON b.user_id = c.user_id AND b.seq = c.seq + 1 AND b.seq % {_SEGMENT} <> 0),
seals(user_id, segment, last, hash) AS (
  SELECT user_id, 0, hash, sha256('genesis:0:' || hash) FROM chain WHERE seq = {_SEGMENT} - 1
  UNION ALL
  SELECT c.user_id, s.segment + 1, c.hash, sha256(s.hash || ':' || (s.segment + 1) || ':' || c.hash) FROM seals s JOIN chain c ON c.user_id = s.user_id AND c.seq = (s.segment + 2) * {_SEGMENT} - 1)
"""


@query("q30_ledger_segments", f"WITH {_SEGMENTS} SELECT user_id AS ledger, seq, hash FROM chain")
def ledger_segments(spark, sf_dir):
    """Segments of one ledger chain side by side."""
    return _ledger(spark, sf_dir, _SEGMENT).select("ledger", "seq", F.get_json_object("raw", "$.hash").alias("hash"))


@query("q30_ledger_seals", f"""
    WITH {_SEGMENTS}, ends AS (SELECT user_id, count(*) AS entries, count(*) // {_SEGMENT} AS n FROM chain GROUP BY user_id)
    SELECT e.user_id AS ledger, entries, hash AS newest_seal, n = 0 OR e.user_id % 2 = 0 AS ok, CASE WHEN n > 0 AND e.user_id % 2 = 1 THEN {_SEGMENT} - 1 END AS bad_index,
      CASE WHEN n > 0 AND e.user_id % 2 = 1 THEN 'segment altered' END AS reason
    FROM ends e LEFT JOIN seals s ON s.user_id = e.user_id AND s.segment = n - 1""")
def ledger_seals(spark, sf_dir):
    """Ledgers of odd users write their first segment anew, sound in itself; their seals tell."""
    rows = cut_lineage(_ledger(spark, sf_dir, _SEGMENT), "ledger")
    first = cut_lineage(L.ledger_seals(rows.filter(F.col("seq") < 2 * _SEGMENT), None, _SEGMENT), "seals")
    seals = first.unionByName(L.ledger_seals(rows, first, _SEGMENT))
    begun = (F.col("ledger") % 2 == 1) & (F.col("seq") < _SEGMENT)
    others = A.reviews(spark, sf_dir).filter((F.col("ledger") % 2 == 1) & (F.col("seq") < _SEGMENT)).withColumn("ts", F.lit("later"))
    forged = rows.filter(~begun).unionByName(L.ledger_append(rows.filter(F.lit(False)), others, _SEGMENT))
    newest = seals.groupBy("ledger").agg(F.max_by("hash", "segment").alias("newest_seal"))
    return L.ledger_verify(forged, seals, _SEGMENT).join(newest, "ledger", "left").select("ledger", "entries", "newest_seal", "ok", "bad_index", "reason")


_TAMPERED = f"""
{_NUMBERED},
bad AS (SELECT user_id, seq, CASE WHEN event_type = 'purchase' AND value > 20 THEN 'unreadable entry' WHEN event_type = 'signup' AND value > 15 THEN 'entry altered'
               WHEN event_type = 'click' AND value > 30 THEN 'chain broken' END AS reason FROM numbered),
marked AS (SELECT user_id, min(seq) FILTER (reason IS NOT NULL) AS bad_index, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason, count(*) AS entries FROM bad GROUP BY user_id)
"""


def _tampered(spark, sf_dir):
    """The ledgers with some entries garbled, some reworded, some rehashed on a wrong predecessor."""
    marks = A.reviews(spark, sf_dir).select("ledger", "seq", "value", "event_type")
    rows = _ledger(spark, sf_dir).join(marks, ["ledger", "seq"])
    kind, value = F.col("event_type"), F.col("value")
    reworded = F.regexp_replace("raw", '"overall":"[A-Z]+"', '"overall":"PASSED"')
    body = F.regexp_replace(F.regexp_replace("raw", ',"hash":"[0-9a-f]{64}"\\}\\z', "}"), '"prev":"[0-9a-z]+"', '"prev":"elsewhere"')
    rehashed = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"hash":"'), F.sha2(body, 256), F.lit('"}'))
    raw = (
        F.when((kind == "purchase") & (value > 20), F.lit("{oops")).when((kind == "signup") & (value > 15), reworded)
        .when((kind == "click") & (value > 30), rehashed).otherwise(F.col("raw"))
    )
    return rows.select("ledger", "seq", raw.alias("raw"))


@query("q30_ledger_verify", f"WITH {_TAMPERED} SELECT user_id AS ledger, entries, bad_index IS NULL AS ok, bad_index, reason FROM marked")
def ledger_verify(spark, sf_dir):
    return L.ledger_verify(_tampered(spark, sf_dir))


@query("q30_ledger_history", f"""
    WITH {_NUMBERED}
    SELECT user_id AS ledger, seq, 'e' || event_id AS ts, CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS overall,
      CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS supported, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS contradicted, 0 AS unverifiable
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS age FROM numbered) WHERE age <= 10""")
def ledger_history(spark, sf_dir):
    return L.ledger_history(_ledger(spark, sf_dir)).select("ledger", "seq", "ts", "overall", "supported", "contradicted", "unverifiable")


@query("q43_attempts", """
    SELECT substr(sha256(task || chr(10) || strategy), 1, 32) AS id, task, strategy, 'proposed' AS status FROM (
      SELECT DISTINCT event_type AS task, 'value ' || CAST(floor(value) AS BIGINT) AS strategy FROM events WHERE event_type <> 'view')""")
def attempts(spark, sf_dir):
    """Attempts proposed from every event; those on views are known already."""
    runs = A.experience_runs(spark, sf_dir)
    proposals = runs.select("task", "strategy", F.lit("manual").alias("source"), F.col("evidence_source").alias("evidence"), "ts")
    none = proposals.filter(F.lit(False)).select(F.col("task").alias("id"))
    known = M.propose_attempts(none, proposals.filter(F.col("task") == "view"))
    return M.propose_attempts(known, proposals).select("id", "task", "strategy", "status")


@query("q43_suggestions", f"""
    WITH {_NUMBERED}
    SELECT DISTINCT 'agent change reviewed against HEAD' AS task, 'claimed: handled error (contradicted by the code)' AS strategy, 'ledger' AS source FROM numbered WHERE event_type = 'error'""")
def suggestions(spark, sf_dir):
    rows = _ledger(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", '"ts":"e(\\d+)"', '"ts":"2024-01-01T00:00:00Z"'))
    none = A.table(spark, sf_dir, "events").filter(F.lit(False)).select(F.col("props").alias("id"))
    return M.suggest_from_ledger(rows, none).select("task", "strategy", "source")


@query("q44_memory_status", """
    WITH newest AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
    SELECT 'u_' || u.user_id AS repo, CASE kind WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'proposed' END AS status, 0.5::DOUBLE AS confidence
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN newest n ON n.user_id = u.user_id""")
def memory_status(spark, sf_dir):
    """A rule per user; purchases approve it, errors reject it, the newest event counts."""
    events = A.table(spark, sf_dir, "events")
    repo = F.concat(F.lit("u_"), F.col("user_id").cast("string"))
    users = events.groupBy("user_id").agg(F.min("ts").alias("ts")).select(
        repo.alias("repo"), F.lit("keep it small").alias("rule"), F.lit(None).cast("string").alias("category"), F.lit("seen").alias("evidence_note"), "ts"
    )
    rules, _ = M.propose_rules(users)
    status = F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected")
    changes = events.filter(F.col("event_type").isin("purchase", "error")).select(repo.alias("repo"), status.alias("status"), F.col("event_id").alias("ts"))
    changes = changes.join(rules.select("repo", "id"), "repo").select("id", "status", "ts")
    return M.list_rules(M.set_status(rules, changes)[0]).select("repo", "status", "confidence")


@query("q44_experience_log", """
    SELECT 'u_' || user_id AS repo, count_if(event_type NOT IN ('error', 'signup')) AS success, count_if(event_type = 'error') AS failure, count_if(event_type = 'signup') AS refused
    FROM events GROUP BY user_id""")
def experience_log(spark, sf_dir):
    log, refused = M.log_experience(A.experience_runs(spark, sf_dir))
    rows = log.select("repo", "outcome").unionByName(refused.select("repo", F.lit("refused").alias("outcome")))
    return rows.groupBy("repo").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failure", "refused")])
