"""Line packs on sources written from the part table, and the path-only extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import extract, findings, packs
from factloom.operators.rules import extract_lines
from factloom.queries import query
from factloom.sources import adapters as A
from factloom.sources import corpus


def _part_lines(spark, sf_dir, ext: str, *texts) -> DataFrame:
    """A file per brand with lines per part at ``partkey * 10 + 1 + i``."""
    part = A.table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), make(key, size).alias("line")) for i, make in enumerate(texts)])
    return part.select(
        F.lit(A.SHOP).alias("repo"), F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(ext)).alias("file"),
        F.col("p_partkey"), F.explode(rows).alias("r"),
    ).select("repo", "file", (F.col("p_partkey") * 10 + 1 + F.col("r.i")).alias("ln"), F.col("r.line").alias("line"))


def _t(template: str):
    """'... {k} ... {s}' -> text of part key and size."""

    def make(key: Column, size: Column) -> Column:
        pieces, rest = [], template
        while rest:
            at = min((rest.find(p) for p in ("{k}", "{s}") if p in rest), default=-1)
            if at < 0:
                pieces.append(F.lit(rest))
                break
            pieces += [F.lit(rest[:at]), key if rest[at:at + 3] == "{k}" else size]
            rest = rest[at + 3:]
        return F.concat(*pieces)

    return make


def _expected(ext: str, *rows: tuple[int, str, str, str]) -> str:
    """SQL of the expected facts: (line offset, type, name, target) with SQL expressions over k and s."""
    parts = [f"SELECT file, base + {i} AS line, '{kind}' AS type, {name} AS name, {target} AS target FROM p" for i, kind, name, target in rows]
    return (
        f"WITH p AS (SELECT 'src/' || replace(p_brand, '#', '') || '{ext}' AS file, p_partkey * 10 + 1 AS base, p_partkey AS k, p_size AS s FROM part) "
        + " UNION ALL ".join(parts)
    )


_SHOWN = ("file", "line", "type", "name", "target")


@query(
    "q56_shell_pack",
    _expected(
        ".sh", (0, "shell_function_def", "'step_' || k", "NULL"), (1, "shell_source", "NULL", "'./lib/' || s || '.sh'"),
        (2, "shell_package_manager_call", "'npm'", "NULL"), (5, "shell_command", "'run-' || s", "NULL"),
    ),
)
def shell_pack(spark, sf_dir):
    return extract_lines(shell_lines(spark, sf_dir), packs.SHELL).select(*_SHOWN)


def shell_lines(spark, sf_dir):
    return _part_lines(spark, sf_dir, ".sh", _t("function step_{k} {"), _t(". ./lib/{s}.sh"), _t("  npm install part{k}"),
                       _t("N={s} go"), _t("# echo {k}"), _t("run-{s} --part {k}"), _t("echo {k}"))


@query(
    "q57_python_pack",
    _expected(
        ".py", (0, "python_import", "'m' || k", "'m' || k"), (0, "python_import", "'os.path'", "'os.path'"),
        (1, "python_import", "'pkg.s' || s", "'pkg.s' || s"), (2, "python_function", "'f' || k", "NULL"),
        (3, "python_function", "'g' || s", "NULL"), (4, "python_class", "'C' || k", "NULL"), (5, "python_decorator", "'deco.d' || s", "NULL"),
    ),
)
def python_pack(spark, sf_dir):
    lines = _part_lines(spark, sf_dir, ".py", _t("import m{k} as x, os.path"), _t("from pkg.s{s} import y"), _t("def f{k}(a):"),
                        _t("    def g{s}(self):"), _t("class C{k}(Base):"), _t("@deco.d{s}(1)"), _t("# import z{k}"))
    return extract_lines(lines, packs.PYTHON).select(*_SHOWN)


@query(
    "q58_lua_pack",
    _expected(
        ".lua", (0, "lua_function_def", "'M.f' || k", "NULL"), (1, "lua_function_def", "'M.g' || k", "NULL"),
        (1, "lua_require", "NULL", "'dep.s' || s"), (2, "lua_require", "NULL", "'m' || k"),
    ),
)
def lua_pack(spark, sf_dir):
    lines = _part_lines(spark, sf_dir, ".lua", _t("function M.f{k}(a)"), _t('M.g{k} = function(x) return require("dep.s{s}") end'),
                        _t("local m = require 'm{k}'"), _t("-- require('no{k}')"))
    return extract_lines(lines, packs.LUA).select(*_SHOWN)


@query(
    "q59_latex_pack",
    _expected(
        ".tex", (0, "latex_environment", "'lemma'", "NULL"), (0, "latex_label", "'l:' || k", "NULL"), (1, "latex_citation", "'a' || k", "'a' || k"),
        (1, "latex_citation", "'b' || s", "'b' || s"), (2, "latex_section", "'Part ' || k", "NULL"), (3, "latex_package", "'p' || s", "'p' || s"),
        (3, "latex_package", "'q'", "'q'"), (4, "latex_include", "'ch' || k", "'ch' || k"),
    ),
)
def latex_pack(spark, sf_dir):
    lines = _part_lines(spark, sf_dir, ".tex", _t("\\begin{lemma}\\label{l:{k}}"), _t("as in \\citep[see]{a{k}, b{s}}"), _t("\\subsection*{Part {k}}"),
                        _t("\\usepackage[x]{p{s}, q}"), _t("\\input{ch{k}}"), _t("% \\label{no{k}}"), _t("\\begin{figure}"))
    return extract_lines(lines, packs.LATEX).select(*_SHOWN)


@query("q59_bibtex_pack", _expected(".bib", (0, "bib_entry", "'key' || k", "NULL")))
def bibtex_pack(spark, sf_dir):
    lines = _part_lines(spark, sf_dir, ".bib", _t("@Article{key{k}, title={x{s}}"), _t("  author = {n{k}}"))
    return extract_lines(lines, packs.BIBTEX).select(*_SHOWN)


@query(
    "q60_lean_pack",
    _expected(
        ".lean", (0, "lean_import", "'Lib.P' || k", "'Lib.P' || k"), (1, "lean_declaration", "'t' || k", "NULL"),
        (2, "lean_namespace", "'N' || s", "NULL"), (3, "lean_command", "'check'", "NULL"),
    ),
)
def lean_pack(spark, sf_dir):
    lines = _part_lines(spark, sf_dir, ".lean", _t("import Lib.P{k}"), _t("protected theorem t{k} : x"), _t("namespace N{s}"), _t("#check t{k}"), _t("-- def d{k}"))
    return extract_lines(lines, packs.LEAN).select(*_SHOWN)


@query(
    "q61_rmd_chunks",
    """
    WITH p AS (SELECT 'src/' || replace(p_brand, '#', '') || '.Rmd' AS file, p_partkey * 10 + 1 AS base, p_partkey AS k, p_size AS s FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY base) AS c FROM p)
    SELECT file, base + 1 AS line, 'rmd_chunk' AS type, CASE WHEN s > 25 THEN 'c' || k ELSE 'chunk_' || c END AS name, NULL AS target FROM n
    UNION ALL SELECT file, base + 2, 'r_library', 'lib' || s, 'lib' || s FROM p
    UNION ALL SELECT file, base + 3, 'r_function', 'f' || k, NULL FROM p
    UNION ALL SELECT file, base + 4, 'r_assignment', 'v' || k, NULL FROM p
    """,
)
def rmd_chunks(spark, sf_dir):
    def opening(key, size):
        return F.when(size.cast("int") > 25, F.concat(F.lit("```{r c"), key, F.lit("}"))).otherwise("```{r}")

    lines = _part_lines(spark, sf_dir, ".Rmd", _t("outside{k} <- 1"), opening, _t("library(lib{s})"), _t("f{k} <- function(x) x"), _t("v{k} <- {s}"), _t("```"))
    return extract.extract_r(lines).select(*_SHOWN)


@query(
    "q55_next_routes",
    """
    SELECT 'pages/n' || c_nationkey || '/[c' || c_custkey || '].tsx' AS file, 'next_page_route' AS type, '/n' || c_nationkey || '/:c' || c_custkey AS route_path FROM customer
    UNION ALL SELECT 'pages/api/' || n_nationkey || '/[...rest].js', 'next_api_route', '/api/' || n_nationkey || '/:rest*' FROM nation
    UNION ALL SELECT 'app/(shop)/s' || s_suppkey || '/[[...all]]/page.tsx', 'next_page_route', '/s' || s_suppkey || '/:all*?' FROM supplier
    """,
)
def next_routes(spark, sf_dir):
    def paths(name: str, *parts) -> DataFrame:
        return A.table(spark, sf_dir, name).select(
            F.lit(A.SHOP).alias("repo"), F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts]).alias("file")
        )

    files = (
        paths("customer", "=pages/n", "c_nationkey", "=/[c", "c_custkey", "=].tsx")
        .unionByName(paths("nation", "=pages/api/", "n_nationkey", "=/[...rest].js"))
        .unionByName(paths("nation", "=pages/_app.", "n_nationkey", "=.css"))
        .unionByName(paths("supplier", "=app/(shop)/s", "s_suppkey", "=/[[...all]]/page.tsx"))
        .unionByName(paths("supplier", "=app/s", "s_suppkey", "=/layout.tsx"))
    )
    return extract.extract_next_routes(files).select("file", "type", "route_path")


@query(
    "q54_vue_components",
    """
    SELECT 'ui/page_' || page_id || '.vue' AS file, CASE WHEN page_id % 3 = 0 THEN 'Page' || page_id ELSE 'page_' || page_id END AS name,
           CASE WHEN page_id % 3 = 0 THEN 2 + len(string_split(regexp_replace(html, '(?i)</?script[^>]*>', '', 'g'), chr(10))) ELSE 1 END::BIGINT AS line
    FROM pages
    """,
)
def vue_components(spark, sf_dir):
    """Templates from web pages: all of their text with the marks of scripts taken out, and a script block for every third."""
    pages = A.table(spark, sf_dir, "pages")
    head = F.regexp_replace("html", r"(?i)</?script[^>]*>", "")
    script = F.concat(F.lit("\n<script>\nexport default {\n  data() { return { name: 'no' } },\n  name: 'Page"), F.col("page_id").cast("string"), F.lit("',\n}\n</script>\n"))
    files = pages.select(
        F.lit(A.SHOP).alias("repo"), F.concat(F.lit("ui/page_"), F.col("page_id").cast("string"), F.lit(".vue")).alias("file"),
        F.concat(head, F.when(F.col("page_id") % 3 == 0, script).otherwise("")).alias("content"),
    )
    return extract.extract_vue(files).select("file", "name", "line")


@query(
    "q62_shell_exec",
    """
    WITH c AS (SELECT 'bin/c_' || c_custkey || '.js' AS file, c_mktsegment AS m, c_acctbal > 0 AS imported FROM customer)
    SELECT file, 2::BIGINT AS line, CASE m WHEN 'AUTOMOBILE' THEN 'high' WHEN 'BUILDING' THEN 'medium' WHEN 'FURNITURE' THEN 'low' WHEN 'HOUSEHOLD' THEN 'medium' END AS severity,
           CASE m WHEN 'AUTOMOBILE' THEN 'exec() called with dynamically-constructed command' WHEN 'BUILDING' THEN 'execSync() called with variable command (unverified source)'
             WHEN 'FURNITURE' THEN 'spawn() called with dynamically-constructed command (no shell invoked)' WHEN 'HOUSEHOLD' THEN 'spawn() called with variable command (unverified source)' END AS rule
    FROM c WHERE imported AND m <> 'MACHINERY'
    """,
)
def shell_exec(spark, sf_dir):
    customer = A.table(spark, sf_dir, "customer")
    first = F.when(F.col("c_acctbal") > 0, "const cp = require('child_process');").otherwise("const cp = fake();")
    second = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "cp.exec(`ls ${dir}`);").when(F.col("c_mktsegment") == "BUILDING", "execSync(cmd);")
        .when(F.col("c_mktsegment") == "FURNITURE", "spawn('a' + b, args);").when(F.col("c_mktsegment") == "HOUSEHOLD", "spawn(cmd, args, { shell: true });")
        .otherwise("spawn(cmd, args); exec('ls -l');")
    )
    files = customer.select(F.lit(A.SHOP).alias("repo"), F.concat(F.lit("bin/c_"), F.col("c_custkey").cast("string"), F.lit(".js")).alias("file"),
                            F.concat(first, F.lit("\n"), second).alias("content"))
    return findings.shell_exec_findings(corpus.to_lines(files)).select("file", "line", "severity", "rule")


@query(
    "q63_workflows",
    """
    WITH s AS (SELECT 's_' || s_suppkey AS repo, s_nationkey % 4 AS k, s_acctbal > 0 AS head FROM supplier)
    SELECT repo, 3::BIGINT AS line, 'high' AS severity FROM s WHERE k = 0
    UNION ALL SELECT repo, 3, 'medium' FROM s WHERE k = 1
    UNION ALL SELECT repo, 2, 'high' FROM s WHERE k = 2
    UNION ALL SELECT repo, 6, 'critical' FROM s WHERE k = 2 AND head
    """,
)
def workflows(spark, sf_dir):
    supplier = A.table(spark, sf_dir, "supplier")
    kind = F.col("s_nationkey") % 4
    trigger = F.when(kind == 2, "  pull_request_target:").otherwise("  push:")
    rights = F.when(kind == 0, "permissions: write-all").when(kind == 1, "permissions:\n  contents: write").otherwise("permissions:\n  contents: read")
    ref = F.when(F.col("s_acctbal") > 0, "    ref: ${{ github.event.pull_request.head.sha }}").otherwise("    fetch-depth: 1")
    content = F.concat_ws("\n", F.lit("on:"), trigger, rights, F.lit("  - uses: actions/checkout@v4"), ref)
    files = supplier.select(F.concat(F.lit("s_"), F.col("s_suppkey").cast("string")).alias("repo"), F.lit(".github/workflows/ci.yml").alias("file"), content.alias("content"))
    return findings.workflow_findings(files).select("repo", "line", "severity")


@query(
    "q64_ignored_paths",
    """
    SELECT lang, count(*) AS n FROM documents
    WHERE NOT (source = 'src1' AND lang = 'en') AND NOT (source = 'src2' AND CAST(doc_id AS VARCHAR) LIKE '1%') AND NOT (source = 'src3' AND doc_id = 3)
    GROUP BY lang
    """,
)
def ignored_paths(spark, sf_dir):
    files = A.document_files(spark, sf_dir).select("repo", "file")
    patterns = spark.createDataFrame([("src1", "./en/"), ("src2", "doc_1*.md"), ("src3", "doc_3.md")], "repo string, pattern string")
    kept = corpus.filter_ignored_by_repo(files, patterns)
    return kept.groupBy(F.substring_index("file", "/", 1).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
