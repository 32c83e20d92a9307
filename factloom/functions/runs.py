"""Order-dependent building blocks that never put one whole group into one task.

A plain ``window(partitionBy=key)`` sends every row of a key to a single task, so a file or a
question holding a third of the table stalls the job. The helpers here cut a group along its own
order into bounded runs, summarise each run (with map-side combine), carry the summaries over the
runs, and add them to a window inside each run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_WIDTH = 4096


def _carry(rows: DataFrame, keys: Sequence[str], run: Sequence[str], summary: DataFrame) -> DataFrame:
    on = [*keys, *run]
    return rows.join(summary, on, "left")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    out: str,
    width: int = RUN_WIDTH,
) -> DataFrame:
    """Inclusive running sum of ``value`` along integer ``position`` within ``keys``."""
    rows = df.withColumn("_v", value.cast("long")).withColumn("_run", F.floor(F.col(position) / width))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        rows.groupBy(*keys, "_run")
        .agg(F.sum("_v").alias("_s"))
        .withColumn("_base", F.sum("_s").over(before))
        .drop("_s")
    )
    inside = (
        Window.partitionBy(*keys, "_run")
        .orderBy(position)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_in", F.sum("_v").over(inside))
    return (
        _carry(rows, keys, ["_run"], summary)
        .withColumn(out, F.col("_in") + F.coalesce("_base", F.lit(0)))
        .drop("_v", "_run", "_in", "_base")
    )


def last_seen(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Mapping[str, Column],
    width: int = RUN_WIDTH,
) -> DataFrame:
    """Adds, per ``out: value``, the latest non-null value at or before ``position`` within ``keys``.

    All values share one shuffle of the rows; the summaries are one map-side aggregate.
    """
    names = {out: f"_v{i}" for i, out in enumerate(values)}
    rows = df.withColumn("_run", F.floor(F.col(position) / width))
    for out, value in values.items():
        rows = rows.withColumn(names[out], value)
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(*keys, "_run").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(position))).alias(f"{v}l") for v in names.values()]
    )
    summary = summary.select(
        *keys, "_run", *[F.last(f"{v}l", ignorenulls=True).over(before).alias(f"{v}b") for v in names.values()]
    )
    inside = (
        Window.partitionBy(*keys, "_run")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for v in names.values():
        rows = rows.withColumn(f"{v}i", F.last(v, ignorenulls=True).over(inside))
    joined = _carry(rows, keys, ["_run"], summary)
    return joined.select(
        *df.columns, *[F.coalesce(f"{v}i", f"{v}b").alias(out) for out, v in names.items()]
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    runs: Sequence[Column],
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """1-based row number per ``keys`` by ``runs`` then ``order``.

    ``runs`` are leading sort expressions that cut a group into pieces: rows of one piece sort
    together, pieces sort by the run values.
    """
    names = [f"_r{i}" for i in range(len(runs))]
    rows = df
    for name, expr in zip(names, runs):
        rows = rows.withColumn(name, expr)
    before = (
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    summary = (
        rows.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(before))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    rows = rows.withColumn("_in", F.row_number().over(inside))
    condition = [rows[c].eqNullSafe(summary[c]) for c in [*keys, *names]]
    joined = rows.join(summary, condition, "left")
    return joined.select(
        *[rows[c] for c in df.columns],
        (rows["_in"] + F.coalesce(summary["_base"], F.lit(0))).cast("long").alias(out),
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``: an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return ranked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, out: str) -> DataFrame:
    """Rows ranked ``<= k`` per key, with the rank as ``out``.

    Catalyst turns a constant bound into a group limit before the shuffle, so each task sends at
    most k rows of a key however large the key is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= k)


def top_per_asked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    default: int,
    asked: str,
    runs: Sequence[Column],
    out: str,
) -> DataFrame:
    """As :func:`top_per`, where column ``asked`` may give a key its own bound (null = ``default``).

    Keys with the default keep the constant bound and its group limit; the others are numbered run
    by run, so no bound, however large, puts a whole key into one task.
    """
    usual = top_per(df.filter(F.col(asked).isNull()), keys, order, default, out)
    special = number_rows(df.filter(F.col(asked).isNotNull()), keys, runs, order, out).filter(F.col(out) <= F.col(asked))
    return usual.withColumn(out, F.col(out).cast("long")).unionByName(special)
