"""Extractors: ``lines`` or ``files`` in, raw facts out.

Stateless packs run in one narrow pass. Extractors that need the state of earlier lines (fences,
chunks, enclosing definitions, tables of a config) filter down to the few lines that matter and use
the run-wise windows of :mod:`factloom.functions.runs`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import first_per, last_seen, running_sum
from factloom.functions.text import base_name, evidence, line_hash, path_confidence, strip
from factloom.operators import packs
from factloom.operators.packs import ORDER
from factloom.operators.rules import any_of, extract_lines, merge, raw_facts
from factloom.operators.scopes import bare_text, calls_with_caller, joined_heads
from factloom.operators.settings import key_line, setting_keys

FILE = ["repo", "file"]


# --- code ---------------------------------------------------------------------------------------

_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
#: Quoted text first, so that what looks like a comment in it stays; a tail after ``:`` is a URL.
_COMMENTED = rf"({_QUOTED})|/\*.*?\*/|(?<!:)//.*\z|/\*.*\z"
_PIECES = rf"(?s)({_QUOTED}|/\*.*?(?:\*/|\z)|(?<!:)//[^\n]*|[^\"'`/]+|.)"


def clean_code(lines: DataFrame) -> DataFrame:
    """Add ``code``: the line without // tails and block comments, quoted text left alone.

    A line by itself cannot show that it stands inside a block comment; :func:`code_lines` reads
    whole files and knows.
    """
    if "code" in lines.columns:
        return lines
    line = F.col("line")
    marked = F.contains(line, F.lit("//")) | F.contains(line, F.lit("/*"))
    return lines.withColumn("code", F.when(marked, F.regexp_replace(line, _COMMENTED, "$1")).otherwise(line))


def code_lines(files: DataFrame) -> DataFrame:
    """``repo, file, ln, line, code, bare`` of whole code files; narrow, as a file is one row.

    The text is cut into quoted pieces, comments and the rest; comments leave only their line ends,
    in ``bare`` quoted pieces too, and a list of parameters over several lines stands on its first.
    """
    texts = code_texts(files.select("repo", "file", "content"))
    return texts.select("repo", "file", F.posexplode(zipped_lines()).alias("_at", "_l")).select("repo", "file", (F.col("_at") + 1).alias("ln"), "_l.line", "_l.code", "_l.bare")


def zipped_lines() -> Column:
    """The lines of ``content``, ``code`` and ``bare`` side by side."""
    return F.arrays_zip(*[F.split(c, "\n", -1).alias(n) for c, n in (("content", "line"), ("code", "code"), ("bare", "bare"))])


def code_texts(files: DataFrame, where: Column | None = None) -> DataFrame:
    """Add ``code`` and ``bare`` of whole files; null where ``where`` does not hold."""
    content = F.col("content")
    pieces = F.transform(
        F.regexp_extract_all(content, F.lit(_PIECES), F.lit(1)),
        lambda p: F.when(F.startswith(p, F.lit("/*")), F.regexp_replace(p, r"[^\n]", "")).when(F.startswith(p, F.lit("//")), F.lit("")).otherwise(p),
    )
    code = F.when(F.contains(content, F.lit("//")) | F.contains(content, F.lit("/*")), F.array_join(pieces, "")).otherwise(content)
    return files.withColumn("code", code if where is None else F.when(where, code)).withColumn("bare", joined_heads(bare_text(F.col("code"))))


_OPENER = r"\A\s*(import|export)\b[^'\"]*\{[^}]*\z"
_CLOSER = r"\A\s*\}\s*from"


def extract_imports(lines: DataFrame) -> DataFrame:
    """ESM imports and require calls with a literal; a multi-line list counts at its closing line.

    Only lines that open or close a list need state: the last opening, however far back, tells
    ``import {`` from ``export {``. They alone are shuffled; all others are read in one narrow pass.
    """
    text, code = F.col("code" if "code" in lines.columns else "line"), F.col("code")
    columns = ["repo", "file", "ln", "line", "code"]
    closes = F.coalesce(code.rlike(_CLOSER), F.lit(False))
    braced = clean_code(lines.filter(any_of(text, ("{", "}")))).select(*columns, F.nullif(F.regexp_extract(code, _OPENER, 1), F.lit("")).alias("_opens"), closes.alias("_closes"))
    state = last_seen(braced.filter(F.col("_closes") | F.col("_opens").isNotNull()), FILE, "ln", {"_opener": F.col("_opens")})
    closing = state.filter(F.col("_closes") & ~F.coalesce(F.col("_opener") == "export", F.lit(False)))
    return merge([extract_lines(clean_code(lines), packs.CODE_IMPORTS, "code", where=~closes), extract_lines(closing, packs.CODE_IMPORTS, "code")])


def extract_hooks(lines: DataFrame) -> DataFrame:
    """First use of each ``useXxx`` per file."""
    facts = extract_lines(clean_code(lines), packs.CODE_HOOKS, "code")
    return first_per(facts, ["repo", "file", "name"], ["line", "pos"])


_DEF_FUNCTION = r"\A(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\("
_DEF_ARROW = r"\A(\s*)(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]*)?=>|[A-Za-z_$][\w$]*\s*=>)"
_DEF_METHOD = r"\A(\s+)(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::[^{]*)?\{\s*\z"
_DEF_CLASS = r"\A\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"


def _definition(line: Column) -> tuple[Column, Column]:
    """(is it a definition of any kind, its bare name)."""
    method = F.regexp_extract(line, _DEF_METHOD, 2)
    is_method = line.rlike(_DEF_METHOD) & ~method.isin(*packs.JS_NO_CALL)
    name = (
        F.when(line.rlike(_DEF_FUNCTION), F.regexp_extract(line, _DEF_FUNCTION, 2))
        .when(line.rlike(_DEF_ARROW), F.regexp_extract(line, _DEF_ARROW, 2))
        .when(is_method, method)
    )
    return is_method, name


def extract_calls(lines: DataFrame, stored: bool = False) -> DataFrame:
    """Identifier calls with the innermost function whose brackets enclose them (see :mod:`scopes`)."""
    calls = calls_with_caller(lines if stored else clean_code(lines), stored)
    line = F.col("line")
    return raw_facts(
        calls.withColumnRenamed("ln", "_ln"), ORDER["code"], type=F.lit("function_call"), line=F.col("_ln"), confidence=path_confidence(F.col("file")),
        evidence=evidence(line), line_hash=line_hash(line), pos=F.col("pos"),
    )


_COMPONENT = (
    r"\A\s*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s+([A-Z][\w$]*)\s*\("
    r"|(?:const|let|var)\s+([A-Z][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s+)?(?:function\b|\(|[A-Za-z_$][\w$]*\s*=>))"
)
_CLASS_COMPONENT = r"\A\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)\s+extends\s+(?:React\.)?Component(?![\w$.])"
# A tag that opens an element: not preceded by an identifier or '.', which would be a generic type.
_JSX = r"(?<![\w$.)\]])<(?:[A-Za-z][\w.:-]*(?:\s[^<>]*)?/?>|>|[A-Za-z][\w.:-]*\s*\z|[a-z][\w-]*\s+[\w-]+=)"


_CLOSES = r"\A\s*[})]"


def component_line(code: Column) -> Column:
    """Lines that :func:`extract_components` looks at: definitions, tags and closing brackets."""
    method, plain = _definition(code)
    return code.rlike(_CLOSES) | code.rlike(_COMPONENT) | code.rlike(_CLASS_COMPONENT) | method | plain.isNotNull() | code.rlike(_JSX)


def extract_components(lines: DataFrame) -> DataFrame:
    """Capitalised functions with a tag in their body, and ``extends (React.)Component`` classes.

    A tag belongs to the nearest capitalised function before it that is still open and indented less,
    else to the last definition at the margin; a definition line's own tag is its own. A function is
    closed by a line that starts with a bracket and is not indented deeper. Bodies may be of any length.
    """
    lines = clean_code(lines)
    line = F.col("code")
    name = F.nullif(F.concat(F.regexp_extract(line, _COMPONENT, 1), F.regexp_extract(line, _COMPONENT, 2)), F.lit(""))
    _, plain = _definition(line)
    any_name = F.coalesce(name, plain)
    marked = lines.select(
        "repo", "file", "ln", "line", name.alias("fn"), any_name.isNotNull().alias("defines"),
        F.nullif(F.regexp_extract(line, _CLASS_COMPONENT, 1), F.lit("")).alias("cls"),
        line.rlike(_JSX).alias("jsx"), F.length(F.regexp_extract(line, r"\A(\s*)", 1)).alias("indent"),
        line.rlike(_CLOSES).alias("closes"),
    ).filter(F.col("defines") | F.col("cls").isNotNull() | F.col("jsx") | F.col("closes"))
    here = F.struct("ln", "line", "fn", "indent")
    owned = last_seen(marked, FILE, "ln", {
        "near": F.when(F.col("defines"), here), "margin": F.when(F.col("defines") & (F.col("indent") == 0), here),
        "closed": F.when(F.col("closes") & ~F.col("jsx"), F.struct("ln", "indent")),
    }).filter("jsx")
    closed = F.coalesce((F.col("closed.ln") > F.col("near.ln")) & (F.col("closed.indent") <= F.col("near.indent")), F.lit(False))
    inside = F.col("near.fn").isNotNull() & (F.col("near.indent") < F.col("indent")) & ~closed
    owner = F.when((F.col("near.ln") == F.col("ln")) | inside, F.col("near")).when(F.col("margin.indent") < F.col("indent"), F.col("margin"))
    functions = owned.select("repo", "file", owner.alias("o")).filter("o.fn IS NOT NULL").select("repo", "file", "o.ln", "o.line", F.col("o.fn").alias("name")).distinct()
    found = functions.select("*", F.lit("function").alias("kind")).unionByName(
        marked.filter(F.col("cls").isNotNull()).select("repo", "file", "ln", "line", F.col("cls").alias("name"), F.lit("class").alias("kind"))
    )
    return raw_facts(
        found, ORDER["code"],
        type=F.lit("react_component"), line=F.col("ln"), evidence=evidence(F.col("line")), line_hash=line_hash(F.col("line")),
        confidence=path_confidence(F.col("file")), pos=F.lit(5_000_000),
    )


def extract_routes(lines: DataFrame) -> DataFrame:
    return extract_lines(clean_code(lines), packs.ROUTES, "code")


def extract_code(lines: DataFrame) -> DataFrame:
    """All code facts of ``lines`` of the code bucket."""
    code = clean_code(lines)
    return merge([
        extract_imports(code), extract_hooks(code), extract_calls(code), extract_components(code), extract_routes(code),
    ])


# --- routes and components from paths -----------------------------------------------------------

def _route_segments(parts: Column) -> Column:
    def one(s: Column) -> Column:
        return (
            F.when(s.rlike(r"\A\[\[\.\.\..*\]\]\z"), F.regexp_replace(s, r"\A\[\[\.\.\.(.*)\]\]\z", ":$1*?"))
            .when(s.rlike(r"\A\[\.\.\..*\]\z"), F.regexp_replace(s, r"\A\[\.\.\.(.*)\]\z", ":$1*"))
            .when(s.rlike(r"\A\[.*\]\z"), F.regexp_replace(s, r"\A\[(.*)\]\z", ":$1"))
            .otherwise(s)
        )

    return F.concat(F.lit("/"), F.array_join(F.transform(parts, one), "/"))


def _router_root(files: DataFrame, name: str) -> DataFrame:
    """Files below ``name/`` of each repo, or below ``src/name/`` where the former is absent."""
    top = F.col("file").startswith(f"{name}/")
    sub = F.col("file").startswith(f"src/{name}/")
    chosen = files.groupBy("repo").agg(F.bool_or(top).alias("has_top"))
    below = files.filter(top | sub).select("repo", "file").join(chosen, "repo")
    rest = F.when(F.col("has_top") & top, F.substring("file", len(name) + 2, 1_000_000)).when(
        ~F.col("has_top") & sub, F.substring("file", len(name) + 6, 1_000_000)
    )
    return below.select("repo", "file", rest.alias("rest")).filter(
        F.col("rest").isNotNull() & ~F.col("rest").rlike(r"(^|/)\.") & F.col("rest").rlike(r"\.(js|jsx|ts|tsx)\z")
    )


def extract_next_routes(files: DataFrame) -> DataFrame:
    """Page and API routes by file convention, from paths alone."""
    bare = F.regexp_replace("rest", r"\.[^./]*\z", "")
    leaf = base_name(bare)
    pages = _router_root(files, "pages").filter(~leaf.isin("_app", "_document", "_error", "middleware"))
    parts = F.filter(F.split(bare, "/"), lambda s: s != "index")
    page_routes = raw_facts(
        pages, ORDER["next"],
        type=F.when((bare == "api") | bare.startswith("api/"), "next_api_route").otherwise("next_page_route"),
        route_path=_route_segments(parts), line=F.lit(1), confidence=path_confidence(F.col("file")),
        evidence=F.concat(F.lit("file convention: pages/"), F.col("rest")),
        extra=F.create_map(F.lit("router"), F.lit("pages")),
    )
    app = _router_root(files, "app").filter(leaf.isin("page", "route"))
    steps = F.split(F.col("rest"), "/")
    folders = F.filter(F.slice(steps, F.lit(1), F.size(steps) - 1), lambda s: ~s.rlike(r"\A\(.*\)\z"))
    app_routes = raw_facts(
        app, ORDER["next"],
        type=F.when(leaf == "page", "next_page_route").otherwise("next_api_route"),
        route_path=_route_segments(folders), line=F.lit(1), confidence=path_confidence(F.col("file")),
        evidence=F.concat(F.lit("file convention: app/"), F.array_join(folders, "/"), F.lit("/"), F.element_at(steps, -1)),
        extra=F.create_map(F.lit("router"), F.lit("app")), pos=F.lit(1),
    )
    return page_routes.unionByName(app_routes)


def extract_vue(files: DataFrame) -> DataFrame:
    """One component per .vue file: explicit name in the default export, else the file name."""
    script_at = F.regexp_instr("content", F.lit(r"(?is)<script[^>]*>.*?</script>"))
    script = F.regexp_extract("content", r"(?is)<script[^>]*>(.*?)</script>", 1)
    # The default export's own keys: the pieces between braces that stand one brace deep, up to its end.
    opening = r"(?s)\A.*?export\s+default\s+(?:defineComponent\s*\(\s*)?\{"
    body = F.when(script.rlike(opening), F.regexp_replace(script, opening, "")).otherwise("")
    name_key = r"(?<![\w$.'\"])name\s*:\s*(?:\"([^\"]*)\"|'([^']*)')"

    def read(state: Column, piece: Column) -> Column:
        depth, known = state["depth"], state["name"]
        step = F.when(depth == 0, 0).when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        found = F.concat(F.regexp_extract(piece, name_key, 1), F.regexp_extract(piece, name_key, 2))
        return F.struct((depth + step).alias("depth"), F.when((depth == 1) & (known == ""), found).otherwise(known).alias("name"))

    pieces = F.regexp_extract_all(body, F.lit(r"([{}]|[^{}]+)"), F.lit(1))
    explicit = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit("").alias("name")), read, lambda state: state["name"])
    before = F.substring(F.col("content"), F.lit(1), script_at - 1)
    ln = F.when(script_at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 2).otherwise(1)
    vue = files.filter(F.col("file").endswith(".vue") & F.col("content").isNotNull()).select(
        "repo", "file", ln.alias("ln"), "content",
        F.coalesce(F.nullif(explicit, F.lit("")), F.regexp_replace(base_name(F.col("file")), r"\.vue\z", "")).alias("name"),
    )
    return raw_facts(
        vue, ORDER["vue"], type=F.lit("vue_component"), line=F.col("ln"), confidence=path_confidence(F.col("file")),
        evidence=evidence(F.coalesce(F.try_element_at(F.split("content", "\n", -1), F.col("ln").cast("int")), F.lit(""))),
    )


# --- documents ----------------------------------------------------------------------------------

def with_fences(lines: DataFrame, fence: str = packs.FENCE) -> DataFrame:
    """Add ``is_fence`` and ``fences_before`` (inclusive count), so odd means inside or opening."""
    marked = lines.withColumn("is_fence", F.col("line").rlike(fence))
    return running_sum(marked, FILE, "ln", F.col("is_fence").cast("int"), "fences_before")


def extract_code_blocks(lines: DataFrame, fence: str = packs.FENCE) -> DataFrame:
    """One fact per closed fenced block, at its opening line; an unclosed block gives none."""
    fences = lines.filter(F.col("line").rlike(fence))
    numbered = running_sum(fences, FILE, "ln", F.lit(1), "n").withColumn("pair", F.floor((F.col("n") + 1) / 2))
    blocks = numbered.groupBy(*FILE, "pair").agg(
        F.count(F.lit(1)).alias("ends"), F.min_by("line", "n").alias("text"), F.min("ln").alias("ln")
    )
    return raw_facts(
        blocks.filter("ends = 2"), ORDER["markdown"],
        type=F.lit("doc_code_block"), line=F.col("ln"), confidence=F.lit("high"), evidence=evidence(F.col("text")),
        extra=F.map_filter(
            F.create_map(F.lit("language"), F.nullif(F.regexp_extract("text", fence, 1), F.lit(""))), lambda k, v: v.isNotNull()
        ),
    )


def extract_markdown(lines: DataFrame) -> DataFrame:
    """Headings, links and instructions outside fences, and the fenced blocks."""
    state = with_fences(lines)
    open_text = state.filter(~F.col("is_fence") & (F.col("fences_before") % 2 == 0))
    facts = extract_lines(open_text, packs.MARKDOWN)
    named = facts.withColumn("name", F.when(F.col("type") == "doc_instruction", F.col("evidence")).otherwise(F.col("name")))
    return named.unionByName(extract_code_blocks(lines))


def extract_html(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Links and headings of web pages, as document facts."""
    return extract_lines(lines, packs.HTML, keep=keep)


def extract_r(lines: DataFrame) -> DataFrame:
    """R scripts as a whole; R Markdown inside its chunks only."""
    is_rmd = F.lower("file").endswith(".rmd")
    scripts = extract_lines(lines.filter(~is_rmd), packs.R_LANG)
    rmd = lines.filter(is_rmd & (strip(F.col("line")) != ""))
    line = F.col("line")
    is_open, is_close = line.rlike(packs.R_CHUNK_OPEN), line.rlike(packs.R_CHUNK_CLOSE)
    state = last_seen(
        rmd.select("repo", "file", "ln", "line"), FILE, "ln", {"state": F.when(is_open, "open").when(is_close, "close")}
    )
    body = state.filter((F.col("state") == "open") & ~is_open)
    opens = running_sum(rmd.filter(is_open).select("repo", "file", "ln", "line"), FILE, "ln", F.lit(1), "chunk")
    name = F.regexp_extract("line", packs.R_CHUNK_NAME, 1)
    chunks = raw_facts(
        opens, ORDER["r"], type=F.lit("rmd_chunk"), line=F.col("ln"), confidence=F.lit("high"), evidence=evidence(line), line_hash=line_hash(line),
        name=F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("chunk_"), F.col("chunk").cast("string"))),
        extra=F.create_map(F.lit("chunkIndex"), F.col("chunk").cast("string")),
    )
    return merge([scripts, chunks, extract_lines(body, packs.R_LANG)])


# --- structured files ---------------------------------------------------------------------------

def _value_type(kind: Column) -> Column:
    """JSON type names as a scripting language reports them."""
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT") | (kind == "VOID"), "object")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    )


_JSON_KEYS = "map<string,variant>"


def _json_keys(files: DataFrame) -> DataFrame:
    """``(repo, file, name, key, value_type, ord)`` for the keys of one and two levels of JSON files."""
    no_blocks = F.regexp_replace("content", r"(?s)/\*.*?\*/", "")
    no_comments = F.regexp_replace(no_blocks, r"(?m)(^|[^:])//.*$", "$1")
    text = F.when(F.col("file").endswith(".jsonc"), no_comments).otherwise(F.col("content"))
    doc = files.filter(F.col("file").rlike(r"\.jsonc?\z")).select("repo", "file", F.try_parse_json(text).alias("doc"))
    top = doc.filter(F.col("doc").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT")).select(
        "repo", "file", F.posexplode(F.expr(f"cast(doc as {_JSON_KEYS})")).alias("ord", "key", "value")
    ).withColumn("kind", F.coalesce(F.schema_of_variant("value"), F.lit("VOID")))
    first = top.select("repo", "file", F.col("key").alias("name"), "key", _value_type(F.col("kind")).alias("value_type"))
    second = top.filter(F.col("kind").startswith("OBJECT")).select(
        "repo", "file", F.col("key").alias("parent"), F.posexplode(F.expr(f"cast(value as {_JSON_KEYS})")).alias("_o", "key", "child")
    ).select(
        "repo", "file", F.concat_ws(".", "parent", "key").alias("name"), "key",
        _value_type(F.coalesce(F.schema_of_variant("child"), F.lit("VOID"))).alias("value_type"),
    )
    return first.unionByName(second)


def _key_lines(lines: DataFrame) -> DataFrame:
    """First line that names a key of a JSON file."""
    line = F.col("line")
    quoted = F.regexp_extract(line, r"\A\s*[\"']([^\"']*)[\"']\s*[:=]", 1)
    bare = F.regexp_extract(line, r"\A\s*([^\s\"'][^\"':=]*?)\s*[:=]", 1)
    keys = F.filter(F.array(quoted, bare), lambda k: k != "")
    rows = lines.select("repo", "file", "ln", evidence(line).alias("text"), F.explode(keys).alias("key"))
    best = rows.groupBy("repo", "file", "key").agg(F.min(F.struct("ln", "text")).alias("at"))
    return best.select("repo", "file", "key", F.col("at.ln").alias("ln"), F.col("at.text").alias("text"))


def _setting_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["repo", "file", "name", "key", "value_type", "ln", "source"]
    for batch in batches:
        out = []
        for repo, file, content in zip(batch["repo"], batch["file"], batch["content"]):
            lines, known = content.split("\n"), {}
            for name, key, kind in setting_keys(file, content):
                if key not in known:
                    known[key] = key_line(lines, key)
                ln = known[key]
                out.append((repo, file, name, key, kind, ln, "" if ln is None else lines[ln - 1]))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"ln": "Int64"})


def extract_config(files: DataFrame) -> DataFrame:
    """Keys of config files, one and two levels deep, each at the first line that names it.

    Files that do not parse give nothing. JSON is read in columns; YAML and TOML file by file, without
    a shuffle (see :mod:`settings`).
    """
    config = files.filter(F.col("content").isNotNull())
    json = config.filter(F.col("file").rlike(r"\.jsonc?\z"))
    lines = json.select("repo", "file", F.posexplode(F.split("content", "\n", -1)).alias("_p", "line")).select("repo", "file", (F.col("_p") + 1).alias("ln"), "line")
    found = _json_keys(json).join(_key_lines(lines), ["repo", "file", "key"], "left")
    others = config.filter(F.col("file").rlike(r"\.(ya?ml|toml)\z")).select("repo", "file", "content")
    others = others.mapInPandas(_setting_keys, "repo string, file string, name string, key string, value_type string, ln long, source string")
    found = found.select("repo", "file", "name", "value_type", F.col("ln").cast("long").alias("ln"), "text").unionByName(
        others.select("repo", "file", "name", "value_type", "ln", evidence(F.col("source")).alias("text"))
    )
    return raw_facts(
        found, ORDER["config"], type=F.lit("config_key"), line=F.col("ln"),
        confidence=F.when(F.col("ln").isNotNull(), "high").otherwise("medium"),
        evidence=F.coalesce("text", F.lit("")), extra=F.create_map(F.lit("valueType"), F.col("value_type")),
    )


# What a cell is for, by the first pattern it matches.
CELL_ROLES = (
    ("visualization", r"(?<!\w)plt\.|matplotlib|seaborn|plotly|bokeh"),
    ("model_training", r"(?<!\w)fit\(|\.train\(|model\.compile|torch\.optim|keras"),
    ("data_loading", r"(?<!\w)pd\.read_|load_dataset|np\.load"),
    ("imports", r"(?m)^\s*(?:import|from)\s"),
    ("exploration", r"(?<!\w)print\(|display\(|\.head\(|\.describe\("),
    ("function_definition", r"(?<!\w)def\s+\w+\s*\("),
)
OTHER_ROLE = "computation"


def _cell_role(source: Column) -> Column:
    text = F.lower(source)
    return F.coalesce(*[F.when(text.rlike(pattern), role) for role, pattern in CELL_ROLES], F.lit(OTHER_ROLE))


def extract_notebook(files: DataFrame) -> DataFrame:
    """Structure, code cells with their role, and imports of notebooks."""
    doc = files.filter(F.col("file").endswith(".ipynb")).select("repo", "file", F.try_parse_json("content").alias("nb"))
    doc = doc.filter(F.col("nb").isNotNull()).withColumn(
        "cells",
        F.coalesce(
            F.try_variant_get("nb", "$.cells", "array<variant>"),
            F.try_variant_get("nb", "$.worksheets[0].cells", "array<variant>"),
            F.array().cast("array<variant>"),
        ),
    )
    kind_of = lambda c: F.try_variant_get(c, "$.cell_type", "string")
    counts = doc.select(
        "repo", "file",
        F.size(F.filter("cells", lambda c: kind_of(c) == "code")).alias("n_code"),
        F.size(F.filter("cells", lambda c: kind_of(c) == "markdown")).alias("n_md"),
        F.try_variant_get("nb", "$.metadata.kernelspec.name", "string").alias("kernel"),
        F.coalesce(
            F.try_variant_get("nb", "$.metadata.kernelspec.language", "string"),
            F.try_variant_get("nb", "$.metadata.language_info.name", "string"),
        ).alias("language"),
    )
    structure = raw_facts(
        counts, ORDER["notebook"], type=F.lit("notebook_structure"), line=F.lit(1), confidence=F.lit("high"),
        name=F.regexp_replace(base_name(F.col("file")), r"\.ipynb\z", ""),
        evidence=F.concat(F.col("n_code").cast("string"), F.lit(" code cell(s), "), F.col("n_md").cast("string"), F.lit(" markdown cell(s)")),
        extra=F.map_filter(
            F.create_map(
                F.lit("codeCellCount"), F.col("n_code").cast("string"), F.lit("markdownCellCount"), F.col("n_md").cast("string"),
                F.lit("kernelName"), F.col("kernel"), F.lit("language"), F.col("language"),
            ),
            lambda k, v: v.isNotNull(),
        ),
    )
    cells = doc.select("repo", "file", F.posexplode("cells").alias("cell", "c")).select(
        "repo", "file", "cell", kind_of(F.col("c")).alias("kind"),
        F.coalesce(
            F.array_join(F.try_variant_get("c", "$.source", "array<string>"), ""),
            F.try_variant_get("c", "$.source", "string"), F.lit(""),
        ).alias("source"),
    ).withColumn("n_lines", F.size(F.split("source", "\n", -1)))
    placed = running_sum(cells, FILE, "cell", F.col("n_lines") + 1, "_end").withColumn(
        "offset", F.col("_end") - F.col("n_lines")
    )
    code = placed.filter((F.col("kind") == "code") & (strip(F.col("source")) != ""))
    cell_facts = raw_facts(
        code, ORDER["notebook"], type=F.lit("notebook_cell"), line=F.col("offset"), confidence=F.lit("high"),
        name=F.concat(F.lit("cell_"), (F.col("cell") + 1).cast("string")),
        evidence=evidence(F.split("source", "\n")[0]),
        extra=F.create_map(F.lit("cellIndex"), F.col("cell").cast("string"), F.lit("role"), _cell_role(F.col("source"))),
        pos=F.lit(1),
    )
    rows = code.select("repo", "file", "cell", "offset", F.posexplode(F.split("source", "\n", -1)).alias("i", "text"))
    plain, source_of = r"\A\s*import\s+([\w.,\s]+)", r"\A\s*from\s+([\w.]+)\s+import\s+"
    names = F.when(
        F.col("text").rlike(plain),
        F.transform(F.split(F.regexp_extract("text", plain, 1), ","), lambda n: strip(F.split(strip(n), " as ")[0])),
    ).when(F.col("text").rlike(source_of), F.array(F.regexp_extract("text", source_of, 1)))
    imports = rows.select("*", F.posexplode(F.filter(names, lambda n: n != "")).alias("j", "name"))
    import_facts = raw_facts(
        imports, ORDER["notebook"], type=F.lit("notebook_import"), line=F.col("offset") + F.col("i"),
        target=F.col("name"), confidence=F.lit("high"), evidence=evidence(F.col("text")),
        extra=F.create_map(F.lit("cellIndex"), F.col("cell").cast("string")), pos=F.lit(2) + F.col("j"),
    )
    return merge([structure, cell_facts, import_facts])
