"""Documentation that disagrees with the repository: links, npm scripts, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import dir_name, normalize_path, strip
from factloom.operators.extract import with_fences

# Fences of the checker (also ~~~, also indented), link and path shapes.
DOC_FENCE = r"\A\s*(```|~~~)"
LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
NOT_LOCAL = r"(?i)\A([a-z][a-z0-9+.-]*:|#|//)"
PATH_SPAN = r"\A[\w.@-]+(?:/[\w.@-]+)+\.[A-Za-z0-9]{1,5}\z"


def _doc_lines(lines: DataFrame) -> DataFrame:
    rows = with_fences(lines.filter(F.col("file").endswith(".md")).select("repo", "file", "ln", "line"), DOC_FENCE)
    return rows.filter(~F.col("is_fence")).withColumn("inside", F.col("fences_before") % 2 == 1)


def existing_paths(files: DataFrame) -> DataFrame:
    """``(repo, path)`` of all files and of every folder above them."""
    steps = F.split("file", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    return files.select("repo", F.explode(every).alias("path")).distinct()


def broken_links(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Local link targets, outside fences, that no file or folder answers to."""
    found = F.regexp_extract_all("line", F.lit(LINK), F.lit(1))
    local = F.filter(found, lambda t: ~t.rlike(NOT_LOCAL))
    rows = _doc_lines(lines).filter(~F.col("inside")).select("repo", "file", "ln", F.explode(local).alias("target"))
    rows = rows.withColumn("path", F.regexp_replace("target", r"[#?].*\z", "")).filter(F.col("path") != "")
    joined = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", F.nullif(dir_name(F.col("file")), F.lit("")), "path"))
    resolved = F.regexp_replace(normalize_path(joined), r"\A/+|/+\z", "")
    rows = rows.withColumn("path", resolved).filter(~F.col("path").isin("", "."))
    return rows.join(paths, ["repo", "path"], "left_anti").select(
        F.lit("broken_link").alias("kind"), "repo", "file", F.col("ln").alias("line"),
        F.concat(F.lit("link target not found: "), F.col("target")).alias("detail"),
    )


def _spans(lines: DataFrame) -> DataFrame:
    """Backticked text outside fences, whole lines inside them."""
    ticks = F.regexp_extract_all("line", F.lit(r"`([^`]+)`"), F.lit(1))
    return _doc_lines(lines).select(
        "repo", "file", "ln", F.explode(F.when(F.col("inside"), F.array("line")).otherwise(ticks)).alias("span")
    )


def missing_scripts(lines: DataFrame, manifests: DataFrame) -> DataFrame:
    """Documented npm scripts a readable manifest does not define."""
    named = F.regexp_extract_all("span", F.lit(r"(?<!\w)npm run ([\w:.-]+)"), F.lit(1))
    test = F.when(F.col("span").rlike(r"(?<!\w)npm (?:t|test)(?!\w)"), F.array(F.lit("\u0001test"))).otherwise(F.array().cast("array<string>"))
    rows = _spans(lines).select("repo", "file", "ln", F.explode(F.concat(named, test)).alias("name"))
    readable = manifests.filter(F.col("readable")).select("repo")
    scripts = manifests.select("repo", F.explode(F.map_keys(F.coalesce("scripts", F.create_map().cast("map<string,string>")))).alias("script")).distinct()
    asked = rows.join(readable, "repo", "left_semi").withColumn("script", F.replace("name", F.lit("\u0001"), F.lit("")))
    # Wording.
    detail = F.when(
        F.col("name").startswith("\u0001"), F.lit("npm test is documented but package.json has no test script")
    ).otherwise(F.concat(F.lit("npm run "), F.col("script"), F.lit(" is documented but package.json has no such script")))
    return asked.join(scripts, ["repo", "script"], "left_anti").select(
        F.lit("missing_npm_script").alias("kind"), "repo", "file", F.col("ln").alias("line"), detail.alias("detail")
    )


def missing_paths(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """Documented paths under a known top folder that do not exist."""
    path = strip(F.col("span"))
    rows = _spans(lines).select("repo", "file", "ln", path.alias("path")).filter(F.col("path").rlike(PATH_SPAN))
    rows = rows.withColumn("top", F.substring_index("path", "/", 1)).filter(F.col("top") != "node_modules")
    tops = paths.filter(F.contains(F.col("path"), F.lit("/"))).select("repo", F.substring_index("path", "/", 1).alias("top")).distinct()
    return rows.join(tops, ["repo", "top"], "left_semi").join(paths, ["repo", "path"], "left_anti").select(
        F.lit("missing_path").alias("kind"), "repo", "file", F.col("ln").alias("line"),
        F.concat(F.lit("possible: documented path does not exist: "), F.col("path")).alias("detail"),
    )


def contradictions(lines: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    paths = existing_paths(files)
    return broken_links(lines, paths).unionByName(missing_scripts(lines, manifests)).unionByName(missing_paths(lines, paths))
