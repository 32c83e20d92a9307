"""Streams give what a batch gives."""

import datetime as dt

from helpers import rows
from pyspark.sql import functions as F

from factloom.operators import packs
from factloom.operators.facts import normalize_facts
from factloom.operators.rules import extract_lines
from factloom.session import fresh_folder
from factloom.sources.corpus import to_lines
from factloom.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def extract(files):
    return extract_lines(to_lines(files), packs.SHELL)


def write(spark, folder, *changes):
    data = [("r", f, c, T0 + dt.timedelta(seconds=s), c is None) for f, c, s in changes]
    spark.createDataFrame(data, J.CHANGES).coalesce(1).write.mode("append").parquet(folder)


def test_only_the_newest_version_counts(spark):
    folder, log, state = (fresh_folder(spark, n) for n in ("in", "log", "state"))
    write(spark, folder, ("a.sh", "source x\n", 1), ("b.sh", "ls\n", 1), ("c.sh", "make\n", 1))
    J.stream_corpus(J.read_changes(spark, folder), extract, log, state).awaitTermination()
    write(spark, folder, ("a.sh", "source y\nsource z\n", 5), ("b.sh", None, 6), ("a.sh", "old", 0))
    J.stream_corpus(J.read_changes(spark, folder), extract, log, state).awaitTermination()
    now = J.current_facts(spark.read.parquet(log))
    assert rows(now, "file", "line", "entity") == [("a.sh", 1, "y"), ("a.sh", 2, "z"), ("c.sh", 1, "make")]


def test_heartbeat_reports_drift(spark):
    folder, out, state = (fresh_folder(spark, n) for n in ("in", "drift", "state"))
    known = normalize_facts(extract(spark.createDataFrame([("r", "a.sh", "source x\nls -l"), ("r", "b.sh", "make")], "repo string, file string, content string")))
    write(spark, folder, ("a.sh", "source x\nls -a", 1), ("b.sh", None, 1))
    J.heartbeat_drift(J.read_changes(spark, folder), known, out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "file", "line", "status") == [("a.sh", 2, "stale"), ("b.sh", 1, "file_missing")]


def test_delta_stream(spark):
    folder, out, state = (fresh_folder(spark, n) for n in ("in", "delta", "state"))
    schema = "repo string, file string, fact_key string, n long, version timestamp"
    data = [("r", "a", "k1", 2, T0), ("r", "a", "k2", 1, T0), ("r", "a", "k1", 1, T0 + dt.timedelta(1)), ("r", "a", "k2", 1, T0 + dt.timedelta(1)), ("r", "a", "k3", 1, T0 + dt.timedelta(1))]
    spark.createDataFrame(data, schema).write.parquet(folder)
    stream = J.stream_delta(spark.readStream.schema(schema).parquet(folder))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.schema(J.DELTA_OUT).parquet(out), "fact_key", "side", "n") == [("k1", "added", 2), ("k1", "removed", 1), ("k2", "added", 1), ("k3", "added", 1)]


def test_bursts_collapse_and_late_rows_drop(spark):
    at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
    df = spark.createDataFrame([("r", at(ms)) for ms in (0, 100, 350, 900, 1199, 1500)], "repo string, ts timestamp")
    assert [r["n_changes"] for r in J.debounce_changes(df, watermark=None).orderBy("started").collect()] == [3, 2, 1]
    assert [r["n_changes"] for r in J.batch_sessions(df, "repo", 0.3).orderBy("started").collect()] == [3, 2, 1]
    folder, out, state = (fresh_folder(spark, n) for n in ("in", "act", "state"))
    for batch in ([0, 60], [7200], [10], [20000]):
        spark.createDataFrame([("success", T0 + dt.timedelta(seconds=s)) for s in batch], "outcome string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
        stream = J.stream_activity(spark.readStream.schema("outcome string, ts timestamp").parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).orderBy("started").select(F.unix_timestamp("started").alias("s"), "n").collect()
    assert [r["n"] for r in got] == [2, 1]
