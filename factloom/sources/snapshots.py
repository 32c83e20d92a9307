"""Snapshots of evidence tables and append-only logs."""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOT_TABLES = ("facts", "derived", "support", "findings", "warnings", "meta")


#: Repositories are dealt over this many folders per table, whatever their number.
REPO_BUCKETS = 64
_MANIFESTS = "manifests"
_MANIFEST = "snapshot_id string, written_at long, folder string, tables map<string,struct<rows:long,schema:string>>"


def _repo_bucket(repo: Column) -> Column:
    return F.pmod(F.hash(repo), F.lit(REPO_BUCKETS))


def write_snapshot(tables: Mapping[str, DataFrame], path: str, snapshot_id: str) -> None:
    """Write the tables into a folder of this attempt, then one manifest line that makes them the snapshot.

    Readers go by manifests, so an attempt that fails half way is never seen, and a repeated one replaces
    the snapshot as a whole, repositories that it no longer has included. Rows are dealt by a hash of the
    repository and rebalanced by size: files grow with the rows, not with tasks times repositories, and
    a repository with a third of the rows is written by many tasks.
    """
    folder = f"data/{uuid.uuid4().hex}"
    written = {}
    for name, table in tables.items():
        target = f"{_root(path)}/{folder}/{name}"
        dealt = table.withColumn("repo_bucket", _repo_bucket(F.col("repo")))
        dealt.hint("rebalance", "repo_bucket").write.partitionBy("repo_bucket").parquet(target)
        # Counted from the footers of what was written.
        written[name] = (table.sparkSession.read.schema(table.schema).parquet(target).count(), table.schema.json())
    line = table.sparkSession.createDataFrame([(snapshot_id, time.time_ns(), folder, written)], _MANIFEST)
    line.coalesce(1).write.mode("append").json(f"{_root(path)}/{_MANIFESTS}")


def _root(path: str) -> str:
    return path.rstrip("/")


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest lines under ``path``; None where there are none."""
    try:
        lines = spark.read.schema(_MANIFEST).json(f"{_root(path)}/{_MANIFESTS}")
    except AnalysisException:
        return None
    return lines.filter(F.col("snapshot_id").isNotNull() & F.col("tables").isNotNull())


def _newest(manifests: DataFrame, snapshot_id: str | None = None) -> Row | None:
    if snapshot_id is not None:
        manifests = manifests.filter(F.col("snapshot_id") == snapshot_id)
    return manifests.orderBy(F.desc("snapshot_id"), F.desc("written_at")).limit(1).first()


def superseded_attempts(spark: SparkSession, path: str) -> DataFrame:
    """``snapshot_id, folder`` of attempts that a later one of the same snapshot replaced; none is read any more."""
    manifests = _manifests(spark, path)
    if manifests is None:
        return spark.createDataFrame([], "snapshot_id string, folder string")
    kept = manifests.groupBy("snapshot_id").agg(F.max_by("folder", "written_at").alias("folder"))
    return manifests.select("snapshot_id", "folder").join(kept, ["snapshot_id", "folder"], "left_anti")


def latest_snapshot_id(spark: SparkSession, path: str) -> str | None:
    """Newest snapshot by id, or None where nothing was written yet or it cannot be read."""
    manifests = _manifests(spark, path)
    if manifests is None:
        return _latest_without_manifest(spark, path)
    row = _newest(manifests)
    return None if row is None else row["snapshot_id"]


def _latest_without_manifest(spark: SparkSession, path: str) -> str | None:
    try:
        meta = spark.read.parquet(f"{_root(path)}/meta")
        row = meta.agg(F.max("snapshot_id").alias("s")).first()
    except AnalysisException:
        return None
    except (PySparkException, Py4JJavaError) as broken:
        _warn(path, broken)
        return None
    return None if row is None else row["s"]


def _warn(path: str, error: Exception | str) -> None:
    warnings.warn(f"snapshot under {path} cannot be read: {str(error).splitlines()[0][:200]}", stacklevel=3)


def read_snapshot(
    spark: SparkSession, path: str, snapshot_id: str | None = None, repos: Sequence[str] | None = None
) -> dict[str, DataFrame] | None:
    """Tables of one snapshot (default: the newest); None where there is none to read.

    ``repos`` reads the folders of these repositories only. A table whose files are broken or gone makes
    the snapshot unreadable: a warning, and None. Only the footers are looked at here. Folders written
    without manifests (``<table>/snapshot_id=.../repo=...``) are read as well.
    """
    manifests = _manifests(spark, path)
    if manifests is None:
        tables = _read_without_manifest(spark, path, snapshot_id)
        return tables if tables is None or repos is None else {n: t.filter(F.col("repo").isin(*repos)) for n, t in tables.items()}
    chosen = _newest(manifests, snapshot_id)
    if chosen is None:
        return None
    tables = {}
    for name, entry in chosen["tables"].items():
        schema = StructType.fromJson(json.loads(entry["schema"]))
        folder = f"{_root(path)}/{chosen['folder']}/{name}"
        try:
            frame = spark.read.parquet(folder) if entry["rows"] else spark.createDataFrame([], schema.add("repo_bucket", "integer"))
        except (PySparkException, Py4JJavaError) as broken:
            _warn(path, broken)
            return None
        if repos is not None:
            wanted = F.lit(False)
            for repo in repos:
                wanted = wanted | ((F.col("repo_bucket") == _repo_bucket(F.lit(repo))) & (F.col("repo") == repo))
            frame = frame.filter(wanted)
        tables[name] = frame.drop("repo_bucket").withColumn("snapshot_id", F.lit(chosen["snapshot_id"]))
    return tables


def _read_without_manifest(spark: SparkSession, path: str, snapshot_id: str | None) -> dict[str, DataFrame] | None:
    chosen = snapshot_id or _latest_without_manifest(spark, path)
    if chosen is None:
        return None
    tables = {}
    for name in SNAPSHOT_TABLES:
        try:
            frame = spark.read.parquet(f"{_root(path)}/{name}")
        except AnalysisException:
            continue
        except (PySparkException, Py4JJavaError) as broken:
            _warn(path, broken)
            return None
        tables[name] = frame.filter(F.col("snapshot_id") == F.lit(chosen).cast(frame.schema["snapshot_id"].dataType))
    return tables


def read_jsonl_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(raw, entry)`` per non-empty line; ``entry`` is null where the line is not valid JSON."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw").filter(F.col("raw") != "")
    return parse_log(raw, schema)


def parse_log(raw: DataFrame, schema: str) -> DataFrame:
    broken = F.try_parse_json("raw").isNull()
    return raw.withColumn("entry", F.when(~broken, F.from_json("raw", schema)))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


# What an older or partial memory document lacks gets these.
_MEMORY = "version int, projectMemory array<string>, experience array<string>"


def read_memory_documents(docs: DataFrame) -> DataFrame:
    """``(repo, content)`` -> version, rule texts and experience texts with defaults; never fails."""
    parsed = F.from_json("content", _MEMORY, {"mode": "PERMISSIVE"})
    empty = F.array().cast("array<string>")
    return docs.select(
        "repo",
        F.coalesce(parsed["version"], F.lit(1)).alias("version"),
        F.coalesce(parsed["projectMemory"], empty).alias("project_memory"),
        F.coalesce(parsed["experience"], empty).alias("experience"),
    )
