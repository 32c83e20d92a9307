"""Streams of file versions in, streams of evidence out.

A change stream has a row per new version of a file: ``(repo, file, content, ts[, deleted])``. Only
changed files are extracted again. Deletions do not show up in a file source, so they come as rows
with ``deleted = true`` (a manifest stream writes them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factloom.operators.facts import normalize_facts
from factloom.operators.verification import DRIFTED, fact_key, verify_facts

CHANGES = "repo string, file string, content string, ts timestamp, deleted boolean"


def read_changes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of parquet change files as a stream."""
    reader = spark.readStream.schema(CHANGES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_facts(changes: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless extraction on a stream: ``extract`` must be a narrow extractor (rule packs)."""
    return extract(changes)


def latest_versions(changes: DataFrame) -> DataFrame:
    """Newest version per file of one batch."""
    return changes.groupBy("repo", "file").agg(F.max_by(F.struct("content", "deleted"), "ts").alias("v"), F.max("ts").alias("ts")).select(
        "repo", "file", "v.content", F.coalesce("v.deleted", F.lit(False)).alias("deleted"), "ts"
    )


def stream_corpus(
    changes: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    **trigger: Any,
) -> StreamingQuery:
    """Keep a fact log up to date: each batch writes the facts of its changed files only.

    The batch id is a partition of the log and is overwritten on a repeated attempt, so a restart
    gives the same log. :func:`current_facts` reads the newest version of each file.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest_versions(batch).persist()
        try:
            facts = normalize_facts(extract(newest.filter(~F.col("deleted")).select("repo", "file", "content")))
            # ``ts`` is the version of the file; files without facts still leave a version row.
            out = newest.select("repo", "file", "ts", "deleted").join(
                facts.drop("location", "metadata", "source"), ["repo", "file"], "left"
            )
            out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch_id").parquet(path)
        finally:
            newest.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_facts(log: DataFrame) -> DataFrame:
    """Facts of the newest version of each file; deleted files have none."""
    newest = log.groupBy("repo", "file").agg(F.max(F.struct("ts", "batch_id")).alias("v"))
    rows = log.join(newest, ["repo", "file"]).filter((F.col("ts") == F.col("v.ts")) & (F.col("batch_id") == F.col("v.batch_id")))
    return rows.filter(F.col("id").isNotNull() & ~F.col("deleted")).drop("v", "batch_id", "deleted")


def debounce_changes(changes: DataFrame, gap: str = "300 milliseconds", watermark: str | None = "1 minute") -> DataFrame:
    """Collapse bursts of changes: one row per repo and run of changes no more than ``gap`` apart."""
    rows = changes if watermark is None else changes.withWatermark("ts", watermark)
    session = F.session_window("ts", gap)
    return rows.groupBy("repo", session).agg(F.count(F.lit(1)).alias("n_changes")).select(
        "repo", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("quiet_from"), "n_changes"
    )


def batch_sessions(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """The same runs on a table. Windows of fixed buckets keep a hot key spread: a run is cut by
    the distance to the previous event, found within its bucket or as the last event before it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col(key), "ts", micros.alias("_t")).withColumn("_b", F.floor(F.col("_t") / (3600 * 1_000_000)))
    inside = Window.partitionBy(key, "_b").orderBy("_t")
    last = rows.groupBy(key, "_b").agg(F.max("_t").alias("_m"))
    carried = last.withColumn("_prev_max", F.max("_m").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_p", F.lag("_t").over(inside)).join(carried.drop("_m"), [key, "_b"])
    before = F.coalesce("_p", "_prev_max")
    opens = rows.withColumn("_open", (before.isNull() | (F.col("_t") - before >= seconds * 1_000_000)).cast("long"))
    per_bucket = opens.groupBy(key, "_b").agg(F.sum("_open").alias("_s")).withColumn(
        "_base", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_s")
    running = F.sum("_open").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = opens.withColumn("_r", running).join(per_bucket, [key, "_b"])
    return numbered.groupBy(key, (F.col("_r") + F.col("_base")).alias("run")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_changes")
    )


def heartbeat_drift(changes: DataFrame, facts: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Drift check against incoming file versions: which recorded facts no longer hold.

    Facts are filtered to the files of the batch by a semi join before anything else.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        newest = latest_versions(batch).persist()
        try:
            live = newest.filter(~F.col("deleted"))
            lines = live.select("repo", "file", F.posexplode(F.split("content", "\n", -1)).alias("_p", "line")).select(
                "repo", "file", (F.col("_p") + 1).alias("ln"), "line"
            )
            touched = facts.join(newest.select("repo", "file"), ["repo", "file"], "left_semi")
            verified = verify_facts(touched, live, lines).filter(F.col("status").isin(*DRIFTED))
            verified.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch_id").parquet(path)
        finally:
            newest.unpersist()

    return changes.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


DELTA_OUT = "repo string, file string, fact_key string, side string, n long, version timestamp"


class FactDelta(StatefulProcessor):
    """Keyed by (repo, file, fact key): remembers how often a fact occurs and reports the difference.

    State is one counter per fact, so a file with very many facts spreads over many keys.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._count = handle.getValueState("count", "n long, version timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("version")
        held, seen = self._count.get() if self._count.exists() else (0, None)
        out = []
        for version, n in zip(table["version"], table["n"]):
            if seen is not None and version <= seen:
                continue
            if n != held:
                out.append((*key, "added" if n > held else "removed", abs(int(n) - int(held)), version))
            held, seen = int(n), version
        self._count.update((held, seen))
        yield pd.DataFrame(out, columns=["repo", "file", "fact_key", "side", "n", "version"])

    def close(self) -> None:
        pass


def fact_counts(facts: DataFrame, version: str = "ts") -> DataFrame:
    """``(repo, file, fact_key, n, version)`` of the facts of one or more file versions."""
    keyed = facts.withColumn("fact_key", fact_key(facts))
    return keyed.groupBy("repo", "file", "fact_key", F.col(version).alias("version")).agg(F.count(F.lit(1)).alias("n"))


def stream_delta(counts: DataFrame) -> DataFrame:
    """Stream of added and removed facts from a stream of ``(repo, file, fact_key, n, version)``.

    A row with ``n = 0`` says the fact is gone from that version. Needs the RocksDB state store.
    """
    return counts.groupBy("repo", "file", "fact_key").transformWithStateInPandas(
        statefulProcessor=FactDelta(), outputStructType=DELTA_OUT, outputMode="Append", timeMode="None"
    )


class VersionDelta(StatefulProcessor):
    """Keyed by (repo, file): remembers how often each fact occurs in the newest version seen.

    A version lists all facts of its file, so what it lacks is removed; a deleted file loses all.
    State is one map entry per fact of the file, and a file is no larger than one row of the corpus.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counts = handle.getMapState("counts", "fact_key string", "n long")
        self._seen = handle.getValueState("seen", "version timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        seen = self._seen.get()[0] if self._seen.exists() else None
        held = {k[0]: int(n[0]) for k, n in self._counts.iterator()} if self._counts.exists() else {}
        before, out = dict(held), []
        for version, group in table.groupby("version", sort=True):
            if seen is not None and version <= seen:
                continue
            now = group["fact_key"].dropna().value_counts().to_dict()
            for fact in sorted(held.keys() | now.keys()):
                change = int(now.get(fact, 0)) - held.get(fact, 0)
                if change:
                    out.append((*key, fact, "added" if change > 0 else "removed", abs(change), version))
            held, seen = {f: int(n) for f, n in now.items()}, version
        for fact in before.keys() - held.keys():
            self._counts.removeKey((fact,))
        for fact, n in held.items():
            if before.get(fact) != n:
                self._counts.updateValue((fact,), (n,))
        self._seen.update((seen,))
        yield pd.DataFrame(out, columns=["repo", "file", "fact_key", "side", "n", "version"])

    def close(self) -> None:
        pass


def stream_version_delta(changes: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stream of added and removed facts from a stream of file versions ``(repo, file, content, ts, deleted)``.

    ``extract`` turns ``files(repo, file, content, ts)`` into raw facts that carry ``ts``; it must be
    narrow. Every version also gives a row without a fact, so that one that lost all its facts, or the
    file itself, is told. A version older than what was seen is passed over; the rows of one version
    must arrive in one trigger, as they do from a file row. Needs the RocksDB state store.
    """
    live = changes.filter(~F.coalesce("deleted", F.lit(False)) & F.col("content").isNotNull())
    facts = normalize_facts(extract(live.select("repo", "file", "content", "ts")))
    facts = facts.withColumn("fact_key", fact_key(facts))
    marks = changes.select("repo", "file", F.lit(None).cast("string").alias("fact_key"), F.col("ts").alias("version"))
    rows = facts.select("repo", "file", "fact_key", F.col("ts").alias("version")).unionByName(marks)
    return rows.groupBy("repo", "file").transformWithStateInPandas(
        statefulProcessor=VersionDelta(), outputStructType=DELTA_OUT, outputMode="Append", timeMode="None"
    )


def stream_activity(log: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str | None = "10 minutes") -> DataFrame:
    """Counts of outcomes per tumbling or sliding window; rows later than the watermark are dropped."""
    rows = log if watermark is None else log.withWatermark("ts", watermark)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window, "outcome").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "outcome", "n"
    )
