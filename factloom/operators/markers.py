"""One pass over a corpus for all extractors of a scan.

Every file gives one row for its path, its whole text where an extractor reads whole files, and, for
code, one row for each line and extractor that looks at the line. All of it is one explode of tagged
markers without a shuffle, written once and partitioned by tag: the corpus is read a single time, code
texts are not copied, and the operators that keep state over lines run on the few lines they need.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import extract, findings, packs
from factloom.operators.rules import any_of, merge, pack_wants
from factloom.operators.scopes import changes_scope
from factloom.session import cut_lineage

CODE = "files"
PATHS, PROJECT_TEXTS = "paths", "project"
_BUCKET = "bucket-"


def _line_marks(line: Column, code: Column, bare: Column) -> dict[str, tuple[Column, bool, bool]]:
    """tag -> (does its extractor look at the line, does it need ``code``, does it need ``bare``)."""
    return {
        "imports": (pack_wants(packs.CODE_IMPORTS_AND_OPENERS, code), True, False),
        "hooks": (pack_wants(packs.CODE_HOOKS, code), True, False),
        "scopes": (changes_scope(code), False, True),
        "components": (extract.component_line(code), True, False),
        "routes": (pack_wants(packs.ROUTES, code), True, False),
        "secrets": (any_of(F.lower(line), findings.SECRET_HINTS), False, False),
        "shell": (findings.shell_exec_line(code), True, False),
    }


def _mark(tag: Column, line: Column | None = None, code: Column | None = None, bare: Column | None = None) -> Column:
    values = {"tag": tag, "line": line, "code": code, "bare": bare}
    return F.struct(*[(F.lit(None) if v is None else v).cast("string").alias(n) for n, v in values.items()])


@dataclass(frozen=True)
class Parts:
    """What one pass over the corpus leaves; every accessor reads its own part only."""

    marked: DataFrame

    def _of(self, tag: str) -> DataFrame:
        return self.marked.filter(F.col("tag") == tag)

    def paths(self) -> DataFrame:
        """``repo, file, bucket, content`` of all files; the content is empty, or null where it could not be read."""
        return self._of(PATHS).select("repo", "file", "bucket", F.col("line").alias("content"))

    def project(self) -> DataFrame:
        """Whole manifests and page components of all buckets."""
        return self._of(PROJECT_TEXTS).select("repo", "file", "bucket", F.col("line").alias("content"))

    def bucket(self, name: str) -> DataFrame:
        """Whole readable files of a bucket other than code."""
        return self._of(f"{_BUCKET}{name}").select("repo", "file", "bucket", F.col("line").alias("content"))

    def lines(self, tag: str) -> DataFrame:
        """Code lines that the extractor ``tag`` looks at."""
        needs = {"scopes": ("bare",), "secrets": ()}.get(tag, ("code",))
        return self._of(tag).select("repo", "file", "ln", "line", *needs)


def split_corpus(bucketed: DataFrame, code: bool = True, buckets: Iterable[str] | None = None) -> Parts:
    """Cut ``bucketed(repo, file, content, bucket)`` into :class:`Parts` in one narrow pass.

    ``code`` tells whether lines of code are wanted, ``buckets`` which buckets are wanted as whole texts
    (None: all). Files without a bucket leave their paths, and manifests their text, too.
    """
    content, bucket = F.col("content"), F.col("bucket")
    is_code = (bucket == CODE) & content.isNotNull() if code else F.lit(False)
    texts = extract.code_texts(bucketed.select("repo", "file", "bucket", "content"), is_code)
    # The head row carries the text once; the rows of lines carry their line only.
    head = F.struct(content.alias("line"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("bare"))
    none = F.array().cast("array<struct<line:string,code:string,bare:string>>")
    pieces = F.concat(F.array(head), F.when(is_code, extract.zipped_lines()).otherwise(none))
    rows = texts.select("repo", "file", "bucket", F.posexplode(pieces).alias("ln", "p"))
    line, text, bare = (F.col(f"p.{c}") for c in ("line", "code", "bare"))

    whole = bucket.isNotNull() & (bucket != CODE) & line.isNotNull()
    if buckets is not None:
        whole = whole & bucket.isin(*buckets)
    of_project = (F.col("file") == "package.json") | F.col("file").endswith(".vue")
    of_file = F.array(
        _mark(F.lit(PATHS), F.when(line.isNotNull(), F.lit(""))),
        F.when(whole, _mark(F.concat(F.lit(_BUCKET), bucket), line)),
        F.when(of_project, _mark(F.lit(PROJECT_TEXTS), line)),
    )
    of_line = F.array(*[
        F.when(wanted, _mark(F.lit(tag), line, text if needs_code else None, bare if needs_bare else None))
        for tag, (wanted, needs_code, needs_bare) in _line_marks(line, text, bare).items()
    ])
    # Empty places leave after the explode: a filter inside the array would keep the tests out of generated code.
    marks = F.when(F.col("ln") == 0, of_file).otherwise(of_line)
    marked = rows.select("repo", "file", "bucket", F.col("ln").cast("long").alias("ln"), F.explode(marks).alias("m")).filter("m IS NOT NULL")
    return Parts(cut_lineage(marked.select("repo", "file", "bucket", "ln", "m.tag", "m.line", "m.code", "m.bare"), "parts", "tag"))


def code_facts(parts: Parts) -> DataFrame:
    """All code facts, each extractor on its own lines; the same as :func:`extract.extract_code`."""
    return merge([
        extract.extract_imports(parts.lines("imports")), extract.extract_hooks(parts.lines("hooks")),
        extract.extract_calls(parts.lines("scopes"), stored=True), extract.extract_components(parts.lines("components")),
        extract.extract_routes(parts.lines("routes")),
    ])


def code_secrets(parts: Parts) -> DataFrame:
    return findings.secret_findings(parts.lines("secrets"))


def code_shell(parts: Parts) -> DataFrame:
    return findings.shell_exec_findings(parts.lines("shell"))
