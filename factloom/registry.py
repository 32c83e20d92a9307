"""The extractors of a scan, and how users add their own.

An extractor is a function DataFrame -> DataFrame. Bucket extractors get the files of one bucket,
project extractors all files of the corpus. The corpus is read once and cut into what each built-in
extractor looks at (see :mod:`factloom.operators.markers`); their outputs are united.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import extract, findings, markers, packs
from factloom.operators.findings import FINDING
from factloom.operators.rules import RAW_FACT, Pack, extract_lines, merge, raw_facts
from factloom.sources.corpus import BUCKET_EXTENSIONS, assign_bucket, to_lines, unreadable_files

PROJECT = "project"
BUILTIN_BUCKETS = (*BUCKET_EXTENSIONS, "envFiles")
BUILTIN_EXTENSIONS = tuple(x for group in BUCKET_EXTENSIONS.values() for x in group)


@dataclass(frozen=True)
class Extractor:
    """``kind`` is "facts" or "findings"; ``takes`` is "files" or "lines".

    Built-in ones may take "parts", "paths" or "project" of the corpus cut up instead. An own extractor of
    the code bucket or of the project reads the corpus itself, once more.
    """

    name: str
    bucket: str
    kind: str
    extract: Callable[[DataFrame], DataFrame]
    extensions: tuple[str, ...] = ()
    takes: str = "files"


def _pack(pack: Pack) -> Callable[[DataFrame], DataFrame]:
    return lambda lines: extract_lines(lines, pack)


def _latex(lines: DataFrame) -> DataFrame:
    bib = F.lower("file").endswith(".bib")
    return extract_lines(lines.filter(~bib), packs.LATEX).unionByName(extract_lines(lines.filter(bib), packs.BIBTEX))


def _builtin() -> list[Extractor]:
    return [
        Extractor("file-facts", "files", "facts", markers.code_facts, takes="parts"),
        Extractor("shell-exec", "files", "findings", markers.code_shell, takes="parts"),
        Extractor("secrets-files", "files", "findings", markers.code_secrets, takes="parts"),
        *[Extractor(f"secrets-{b}", b, "findings", findings.secret_findings, takes="lines")
          for b in ("shellFiles", "configFiles", "markdownFiles", "envFiles")],
        Extractor("workflow", "configFiles", "findings", findings.workflow_findings),
        Extractor("shell", "shellFiles", "facts", _pack(packs.SHELL), takes="lines"),
        Extractor("config", "configFiles", "facts", extract.extract_config),
        Extractor("markdown", "markdownFiles", "facts", extract.extract_markdown, takes="lines"),
        Extractor("lua", "luaFiles", "facts", _pack(packs.LUA), takes="lines"),
        Extractor("notebook", "notebookFiles", "facts", extract.extract_notebook, (".ipynb",)),
        Extractor("python", "pythonFiles", "facts", _pack(packs.PYTHON), (".py",), "lines"),
        Extractor("latex", "latexFiles", "facts", _latex, (".tex", ".bib"), "lines"),
        Extractor("lean", "leanFiles", "facts", _pack(packs.LEAN), (".lean",), "lines"),
        Extractor("r-lang", "rFiles", "facts", extract.extract_r, (".r", ".rmd"), "lines"),
        Extractor("next-routes", PROJECT, "facts", extract.extract_next_routes, takes="paths"),
        Extractor("vue-components", PROJECT, "facts", extract.extract_vue, takes="project"),
        Extractor("dependencies", PROJECT, "findings",
                  lambda files: findings.dependency_findings(files.filter(F.col("file") == "package.json")), takes="project"),
    ]


def validate_extractor(extractor: Extractor) -> None:
    """Raise ValueError where a user extractor breaks the contract."""
    if not isinstance(extractor, Extractor):
        raise ValueError("an extractor must be an Extractor")
    name = extractor.name
    if not isinstance(name, str) or not name:
        raise ValueError("an extractor needs a name")
    if not isinstance(extractor.bucket, str) or not extractor.bucket:
        raise ValueError(f"extractor {name!r} needs a bucket")
    if extractor.kind not in ("facts", "findings"):
        raise ValueError(f"extractor {name!r}: kind must be 'facts' or 'findings'")
    if not callable(extractor.extract):
        raise ValueError(f"extractor {name!r} needs an extract function")
    if extractor.extensions and extractor.bucket in BUILTIN_BUCKETS:
        raise ValueError(f"extractor {name!r}: extensions need a new bucket name, not {extractor.bucket!r}")
    for ext in extractor.extensions:
        if not isinstance(ext, str) or not re.fullmatch(r"\.[A-Za-z0-9]+", ext):
            raise ValueError(f"extractor {name!r}: bad extension {ext!r}")
        if ext.lower() in BUILTIN_EXTENSIONS:
            raise ValueError(f"extractor {name!r}: {ext!r} is already handled by a built-in extractor")


class Registry:
    """A list of extractors in scan order."""

    def __init__(self) -> None:
        self._extractors = _builtin()

    def list(self) -> list[tuple[str, str, str]]:
        return [(e.name, e.bucket, e.kind) for e in self._extractors]

    def register(self, extractor: Extractor) -> Callable[[], None]:
        """Add an extractor; the returned function removes it again."""
        validate_extractor(extractor)
        if any(e.name == extractor.name for e in self._extractors):
            raise ValueError(f"extractor {extractor.name!r} is already registered")
        for ext in (x.lower() for x in extractor.extensions):
            for other in self._extractors:
                if other.bucket != extractor.bucket and ext in (x.lower() for x in other.extensions):
                    raise ValueError(f"extension {ext!r} is already claimed by {other.name!r}")
        self._extractors.append(extractor)

        def unregister() -> None:
            if extractor in self._extractors:
                self._extractors.remove(extractor)

        return unregister

    def extension_buckets(self) -> dict[str, str]:
        return {x.lower(): e.bucket for e in self._extractors for x in e.extensions}

    def text_endings(self) -> tuple[str, ...]:
        """Endings of files whose text a scan reads; others are only counted."""
        return (*BUILTIN_EXTENSIONS, *self.extension_buckets(), "package.json")

    def bucketed(self, files: DataFrame) -> DataFrame:
        return assign_bucket(files, self.extension_buckets())

    def split(self, files: DataFrame, skip: Iterable[str] = ()) -> markers.Parts:
        """Read ``files`` once and write what the extractors look at."""
        skip = set(skip)
        active = [e for e in self._extractors if e.name not in skip]
        bucketed = self.bucketed(files) if "bucket" not in files.columns else files
        return markers.split_corpus(bucketed, any(e.takes == "parts" for e in active), {e.bucket for e in active})

    def _source(self, extractor: Extractor, files: DataFrame, parts: markers.Parts) -> DataFrame | markers.Parts:
        if extractor.takes in ("parts", "paths", "project"):
            return parts if extractor.takes == "parts" else getattr(parts, extractor.takes)()
        if extractor.bucket == PROJECT:
            return files
        if extractor.bucket != markers.CODE:
            source = parts.bucket(extractor.bucket)
            return to_lines(source) if extractor.takes == "lines" else source
        bucketed = self.bucketed(files) if "bucket" not in files.columns else files
        source = bucketed.filter(F.col("content").isNotNull() & (F.col("bucket") == markers.CODE))
        if extractor.takes != "lines":
            return source
        # Facts are read from code that is lexed file by file, so that comments over several lines are known.
        return extract.code_lines(source) if extractor.kind == "facts" else to_lines(source)

    def run(
        self, files: DataFrame, skip: Iterable[str] = (), parts: markers.Parts | None = None
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(raw facts, raw findings, warnings) of ``files(repo, file, content)``.

        A file that cannot be read gives a warning and the scan goes on; an extractor whose plan
        cannot even be built gives a project-level warning. ``parts`` may come from :meth:`split`.
        """
        skip = set(skip)
        parts = parts or self.split(files, skip)
        facts, found, failures = [], [], []
        for order, extractor in enumerate(self._extractors):
            if extractor.name in skip:
                continue
            try:
                out = extractor.extract(self._source(extractor, files, parts))
                if extractor.kind == "facts":
                    missing = [c for c in ("repo", "type", "file", "line") if c not in out.columns]
                    if missing:
                        raise ValueError(f"missing columns {missing}")
                    facts.append(out if set(RAW_FACT) <= set(out.columns) else raw_facts(out, 1000 + order))
                else:
                    found.append(out.select(*FINDING))
            except Exception as error:  # noqa: BLE001 - one bad extractor must not end the scan
                failures.append((extractor.name, str(error).split("\n")[0][:300]))
        warnings = unreadable_files(parts.paths().filter(F.col("bucket").isNotNull()))
        if failures:
            repos = parts.paths().select("repo").distinct()
            each = F.explode(F.array(*[F.struct(F.lit(n).alias("extractor"), F.lit(e).alias("error")) for n, e in failures])).alias("f")
            extra = repos.select("repo", F.lit("(project-level)").alias("file"), each).select("repo", "file", "f.extractor", "f.error")
            warnings = warnings.unionByName(extra)
        spark = files.sparkSession
        no_facts = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in _RAW_TYPES.items()))
        no_findings = spark.createDataFrame([], ", ".join(f"{c} {_FINDING_TYPES.get(c, 'string')}" for c in FINDING))
        return (
            merge([f.select(*RAW_FACT) for f in facts]) if facts else no_facts,
            merge(found) if found else no_findings,
            warnings,
        )


_FINDING_TYPES = {"line": "long", "ext_ord": "int"}
_RAW_TYPES = {
    c: {"line": "long", "ext_ord": "int", "pos": "int", "extra": "map<string,string>"}.get(c, "string") for c in RAW_FACT
}


def guarded(function: Callable[[str, str], list[dict]], type_name: str) -> Callable[[DataFrame], DataFrame]:
    """Wrap a plain ``(file, content) -> [{line, name, target, ...}]`` function as an extractor.

    Runs in Arrow batches on the executors. A file on which the function raises becomes a row of
    type ``extractor_error`` (see :func:`split_errors`) and all others go on.
    """
    import pandas as pd

    fields = ("name", "target", "kind", "evidence", "confidence")

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    for hit in function(row.file, row.content):
                        rows.append((row.repo, type_name, row.file, hit.get("line"), *[hit.get(f) for f in fields]))
                except Exception as error:  # noqa: BLE001
                    rows.append((row.repo, "extractor_error", row.file, None, str(error), *[None] * 4))
            yield pd.DataFrame(rows, columns=["repo", "type", "file", "line", *fields]).astype({"line": "Int64"})

    schema = "repo string, type string, file string, line long, " + ", ".join(f"{f} string" for f in fields)
    return lambda files: files.select("repo", "file", "content").mapInPandas(run, schema)


def split_errors(facts: DataFrame, extractor: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, warnings) from a result that carries ``extractor_error`` rows."""
    failed = F.col("type") == "extractor_error"
    warnings = facts.filter(failed).select("repo", "file", F.lit(extractor).cast("string").alias("extractor"), F.col("name").alias("error"))
    return facts.filter(~failed), warnings


