"""From folders and tables of texts to ``files`` and ``lines``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import base_name, dir_name, extension

# Names never scanned.
DEFAULT_IGNORES = (
    "node_modules", ".git", ".factloom", "dist", "build", ".next", "coverage", ".turbo", ".cache",
)
# Which extension belongs to which bucket.
BUCKET_EXTENSIONS = {
    "files": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"),
    "shellFiles": (".sh", ".bash"),
    "configFiles": (".toml", ".yaml", ".yml", ".json", ".jsonc"),
    "markdownFiles": (".md", ".mdx"),
    "luaFiles": (".lua",),
}
# Manifests and lock files, which no per-file bucket takes.
CONFIG_NAME_EXCLUDES = ("package.json", "package-lock.json", "npm-shrinkwrap.json")
# Fixed value: dot files that are scanned nevertheless.
ENV_NAME = r"(?i)\A\.env(\..+)?\z"
# Presence of one of these marks a Next.js project.
NEXT_CONFIG_NAMES = ("next.config.js", "next.config.ts", "next.config.mjs")


def read_corpus(
    spark: SparkSession, roots: Mapping[str, str], glob: str | None = None, ignore: Sequence[str] | None = None,
    texts: Sequence[str] | None = None,
) -> DataFrame:
    """Files below each root as ``files(repo, file, content, size, mtime)``.

    ``roots`` maps a repository name to its folder. Dot folders and dot files are left out, except
    ``.env*``; undecodable bytes become replacement characters. Spark's own file source hides names
    that start with '.' or '_', so the ``source_tree`` data source does the listing.

    ``ignore`` gives the patterns of :func:`filter_ignored` to the listing (the defaults with them), which
    then does not enter such folders. ``texts`` names the endings whose text is read (see
    ``Registry.text_endings``); other files are listed with a null content and not opened.
    """
    from factloom.sources.tree import SourceTree

    spark.dataSource.register(SourceTree)
    parts = []
    for repo, root in roots.items():
        reader = spark.read.format("source_tree").option("path", root)
        if glob:
            reader = reader.option("glob", glob)
        if ignore is not None:
            # Python's patterns write the end of a text with a capital letter.
            reader = reader.option("ignore", json.dumps([p.replace(r"\z", r"\Z") for p in _ignore_patterns([*DEFAULT_IGNORES, *ignore])]))
        if texts is not None:
            reader = reader.option("texts", json.dumps(list(texts)))
        parts.append(reader.load().withColumn("repo", F.lit(repo)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("repo", "file", "content", "size", "mtime")


def read_corpus_binary(spark: SparkSession, root: str, repo: str, glob: str = "*") -> DataFrame:
    """The same through the built-in binary source, for object stores; dot and '_' names are hidden."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    prefix = r"\A.*?" + _escape(root.rstrip("/") + "/")
    path = F.regexp_replace("path", r"\A[a-z]+:/+(?=/)|\A[a-z]+:(?=/)", "")
    return raw.select(
        F.lit(repo).alias("repo"),
        F.regexp_replace(path, prefix, "").alias("file"),
        F.decode("content", "UTF-8").alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    ).filter(~F.col("file").rlike(r"(^|/)\.[^/]*/"))


def write_corpus(texts: DataFrame, folder: str) -> int:
    """Write ``texts(file, text)`` as files below a shared folder, each by one task, and return how many.

    Rows of one file are its lines, each with a line end; a null is an empty line. A file appears under its
    name once it is whole, so a task that runs again writes the same.
    """
    from factloom.sources.tree import open_folder

    def write(batches):
        import posixpath
        import uuid

        import pyarrow as pa

        filesystem, root = open_folder(folder)
        current = stream = hidden = None
        done = 0

        def close():
            stream.close()
            filesystem.move(hidden, f"{root.rstrip('/')}/{current}")

        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                if file != current:
                    if stream is not None:
                        close()
                    below = f"{root.rstrip('/')}/{posixpath.dirname(file)}"
                    filesystem.create_dir(below, recursive=True)
                    current, hidden, done = file, f"{below}/.{uuid.uuid4().hex}", done + 1
                    stream = filesystem.open_output_stream(hidden)
                stream.write((text or "").encode() + b"\n")
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("file", "text").filter("file IS NOT NULL").repartition(spread, "file").sortWithinPartitions("file")
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _ignore_patterns(patterns: Iterable[str]) -> list[str]:
    """Regular expressions of all patterns: exact names, path prefixes, globs. A folder that one finds is ignored whole."""
    names, prefixes, globs = [], [], []
    for raw in patterns:
        pattern = str(raw).replace("\\", "/")
        pattern = pattern[2:] if pattern.startswith("./") else pattern
        if "*" in pattern:
            globs.append("".join(".*" if ch == "*" else _escape(ch) for ch in pattern))
        elif "/" in pattern:
            prefixes.append(_escape(pattern.rstrip("/")))
        else:
            names.append(_escape(pattern))
    found = []
    if names:
        found.append(rf"(^|/)({'|'.join(names)})(/|\z)")
    if prefixes:
        found.append(rf"\A({'|'.join(prefixes)})(/|\z)")
    for pattern in globs:
        # A glob may meet a whole path, a leading folder path, or any single name on the way.
        found += [rf"\A({pattern})(/|\z)", rf"(^|/)({pattern.replace('.*', '[^/]*')})(/|\z)"]
    return found


def _ignore_condition(patterns: Iterable[str], file: Column) -> Column:
    """One predicate for all patterns."""
    hit = F.lit(False)
    for pattern in _ignore_patterns(patterns):
        hit = hit | file.rlike(pattern)
    return hit


def _escape(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_/" else "\\" + ch for ch in text)


def filter_ignored(files: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """Drop files under ignored names, prefixes or globs (defaults always apply)."""
    return files.filter(~_ignore_condition([*DEFAULT_IGNORES, *patterns], F.col("file")))


def filter_ignored_by_repo(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same with ``patterns(repo, pattern)`` from each repository's own settings.

    Names and prefixes become equi-joins on the folders of a path; the globs of a repo become one
    pattern, so that each step of a path meets one row.
    """
    kept = filter_ignored(files)
    clean = patterns.select(
        "repo", F.regexp_replace(F.regexp_replace("pattern", r"\\", "/"), r"\A\./|/+\z", "").alias("pattern")
    )
    is_glob = F.contains(F.col("pattern"), F.lit("*"))
    steps = F.split("file", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")
    )
    keyed = kept.select("repo", "file", F.explode(F.array_union(steps, prefixes)).alias("pattern"))
    plain_hits = keyed.join(clean.filter(~is_glob), ["repo", "pattern"], "left_semi").select("repo", "file").distinct()
    globs = clean.filter(is_glob).select(
        "repo",
        F.regexp_replace(F.regexp_replace("pattern", r"([.+^${}()|\[\]\\])", r"\\$1"), r"\*", ".*").alias("rx"),
    ).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("rx")), "|").alias("rx"))
    glob_hits = (
        keyed.join(globs, "repo")
        .filter(F.regexp_like("pattern", F.concat(F.lit(r"\A("), F.col("rx"), F.lit(r")\z"))))
        .select("repo", "file")
        .distinct()
    )
    return kept.join(plain_hits.unionByName(glob_hits), ["repo", "file"], "left_anti")


def assign_bucket(files: DataFrame, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``ext`` and ``bucket`` (null where no extractor handles the file)."""
    ext = extension(F.col("file"))
    name = base_name(F.col("file"))
    bucket = F.when(name.rlike(ENV_NAME), "envFiles")
    for label, extensions in BUCKET_EXTENSIONS.items():
        match = ext.isin(*extensions)
        if label == "configFiles":
            bucket = bucket.when(match & name.isin(*CONFIG_NAME_EXCLUDES), F.lit(None))
        bucket = bucket.when(match, label)
    for extra_ext, label in (extra or {}).items():
        bucket = bucket.when(F.lower(ext) == extra_ext.lower(), label)
    return files.withColumn("ext", ext).withColumn("bucket", bucket)


def coverage_stats(bucketed: DataFrame, warnings: DataFrame | None = None, scanned: Column | None = None) -> DataFrame:
    """One row per repo: what was found, supported, scanned, skipped, failed, and the status.

    ``scanned`` marks files that were reached; without it all supported files were.
    """
    supported = F.col("bucket").isNotNull()
    reached = supported if scanned is None else supported & scanned
    stats = bucketed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files_discovered"),
        F.count_if(supported).alias("files_supported"),
        F.count_if(reached).alias("files_scanned"),
        F.count_if(~supported).alias("files_skipped"),
    )
    if warnings is None:
        stats = stats.withColumn("files_failed", F.lit(0).cast("long"))
    else:
        failed = warnings.groupBy("repo").agg(F.count_distinct("file").alias("files_failed"))
        stats = stats.join(failed, "repo", "left").withColumn("files_failed", F.coalesce("files_failed", F.lit(0)))
    percent = F.round(F.col("files_scanned") * 1000 / F.nullif(F.col("files_supported"), F.lit(0))) / 10
    status = (
        F.when(F.col("files_supported") == 0, "no_supported_files")
        .when(F.col("files_scanned") < F.col("files_supported"), "timeout")
        .otherwise("success")
    )
    return stats.withColumn("coverage_percent", percent).withColumn("status", status)


_MANIFEST = "name string, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>"


def read_manifests(files: DataFrame) -> DataFrame:
    """``manifests(repo, name, deps map, scripts map)`` of the package.json at each root."""
    parsed = files.filter(F.col("file") == "package.json").select(
        "repo", F.from_json("content", _MANIFEST, {"mode": "PERMISSIVE"}).alias("m")
    )
    empty = F.create_map().cast("map<string,string>")
    runtime = F.coalesce("m.dependencies", empty)
    develop = F.coalesce("m.devDependencies", empty)
    shadowed = F.map_filter(runtime, lambda k, v: ~F.map_contains_key(develop, k))
    return parsed.select(
        "repo",
        F.col("m.name").alias("name"),
        F.map_concat(shadowed, develop).alias("deps"),
        F.col("m.scripts").alias("scripts"),
        F.col("m").isNotNull().alias("readable"),
    )


def detect_stack(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """``stack(repo, project, has_next, has_express, has_react)``; repos without manifest included.

    ``manifests`` are the files to read package.json from, where ``files`` has paths only.
    """

    def uses(name: str) -> Column:
        return F.coalesce(F.map_contains_key("deps", name) & (F.col("deps")[name] != ""), F.lit(False))

    manifest = read_manifests(files if manifests is None else manifests).select(
        "repo",
        F.col("name").alias("project"),
        uses("next").alias("n"),
        uses("express").alias("e"),
        uses("react").alias("r"),
    )
    config = files.groupBy("repo").agg(F.bool_or(F.col("file").isin(*NEXT_CONFIG_NAMES)).alias("c"))
    return config.join(manifest, "repo", "left").select(
        "repo",
        "project",
        (F.col("c") | F.coalesce("n", F.lit(False))).alias("has_next"),
        F.coalesce("e", F.lit(False)).alias("has_express"),
        F.coalesce("r", F.lit(False)).alias("has_react"),
    )


def to_lines(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numbered lines, 1-based; a narrow step that keeps the partitioning of ``files``."""
    return files.select(
        "repo", "file", *keep, F.posexplode(F.split("content", "\n", -1)).alias("_pos", "line")
    ).select("repo", "file", *keep, (F.col("_pos") + 1).alias("ln"), "line")


def unreadable_files(files: DataFrame) -> DataFrame:
    """Warning rows for files whose content could not be read."""
    return files.filter(F.col("content").isNull()).select(
        "repo", "file", F.lit(None).cast("string").alias("extractor"), F.lit("file could not be read").alias("error")
    )


def parent_folders(files: DataFrame) -> DataFrame:
    """Every folder that holds a file, at any depth."""
    steps = F.split(dir_name(F.col("file")), "/")
    return (
        files.filter(F.contains(F.col("file"), F.lit("/")))
        .select(
            "repo",
            F.explode(
                F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
            ).alias("folder"),
        )
        .distinct()
    )
