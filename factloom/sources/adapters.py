"""Star-schema and text tables as corpora.

The tables hold no source trees, so each adapter states which lines of code or documents a row
stands for. All of them are projections or aggregates of whole tables; line numbers come from keys,
so no adapter numbers or collects the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.extract import extract_html, extract_imports, extract_routes
from factloom.operators.facts import normalize_facts
from factloom.operators.findings import KNOWN_PACKAGES
from factloom.session import cut_lineage

SHOP, WEB = "shop", "web"
METHOD_BY_SEGMENT = {"AUTOMOBILE": "get", "BUILDING": "post", "FURNITURE": "put", "HOUSEHOLD": "delete", "MACHINERY": "patch"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Test tables of one row group would be read by one task; only local sessions ask for a spread.
    parts = spark.conf.get("spark.factloom.textPartitions", None) if name in ("documents", "pages") else None
    return rows.repartition(int(parts)) if parts else rows


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def import_lines(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """A module per order that imports each part it holds, on line ``partkey + 2``.

    ``changed`` is a later version: returned items are gone, and orders with status F import an
    audit module on line 1.
    """
    items = table(spark, sf_dir, "lineitem")
    if changed:
        items = items.filter(F.col("l_returnflag") != "R")
    per_part = items.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("qty"))
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    lines = per_part.select(
        F.lit(SHOP).alias("repo"), _text("orders/o_", key, ".js").alias("file"), (part + 2).alias("ln"),
        _text("import p", part, ' from "../parts/p_', part, '.js"; // qty ', F.col("qty")).alias("line"),
    )
    if not changed:
        return lines
    audited = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return lines.unionByName(
        audited.select(
            F.lit(SHOP).alias("repo"), _text("orders/o_", F.col("o_orderkey"), ".js").alias("file"), F.lit(1).cast("long").alias("ln"),
            F.lit('import audit from "../audit/log.js";').alias("line"),
        )
    )


def files_of(lines: DataFrame) -> DataFrame:
    return lines.select("repo", "file").distinct()


def import_facts(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    return normalize_facts(extract_imports(import_lines(spark, sf_dir, changed)))


def stored_import_facts(spark: SparkSession, sf_dir: str, changed: bool = False, texts: bool = False) -> DataFrame:
    """The same as a stored table, as questions find it after a scan.

    Ids and what else follows from other columns are made by its readers, if they look at them.
    Snippets and line hashes are written only if ``texts`` asks for them.
    """
    raw = extract_imports(import_lines(spark, sf_dir, changed))
    return normalize_facts(cut_lineage(raw if texts else raw.drop("evidence", "line_hash"), "facts", compression="zstd"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per customer that imports the modules of its orders, on line ``orderkey + 2``."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.lit(SHOP).alias("repo"), _text("customers/c_", F.col("o_custkey"), ".js").alias("file"), (F.col("o_orderkey") + 2).alias("ln"),
        _text('const o = require("../orders/o_', F.col("o_orderkey"), '");').alias("line"),
    )


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test module per nation that imports the modules of its customers."""
    customer = table(spark, sf_dir, "customer")
    return customer.select(
        F.lit(SHOP).alias("repo"), _text("test/nation_", F.col("c_nationkey"), ".test.js").alias("file"),
        (F.col("c_custkey") + 2).alias("ln"), _text('import c from "../customers/c_', F.col("c_custkey"), '.js";').alias("line"),
    )


def route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router module per nation with a route per customer, on line ``custkey + 1``."""
    customer = table(spark, sf_dir, "customer")
    method = F.create_map(*[F.lit(x) for pair in METHOD_BY_SEGMENT.items() for x in pair])[F.col("c_mktsegment")]
    return customer.select(
        F.lit(SHOP).alias("repo"), _text("routes/nation_", F.col("c_nationkey"), ".js").alias("file"), (F.col("c_custkey") + 1).alias("ln"),
        _text("router.", F.coalesce(method, F.lit("all")), '("/c/', F.col("c_custkey"), '", handler', F.col("c_custkey"), ");").alias("line"),
    )


def route_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_facts(extract_routes(route_lines(spark, sf_dir)))


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per customer: a function per order (status F: a method of a class) with a call per item,
    a nested function, a call after it, one in a callback, and a call outside of all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    key, method = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    file = _text("svc/c_", F.col("o_custkey"), ".js").alias("file")
    place = lambda k: F.struct((key * 16 + k[0]).alias("ln"), k[1].alias("line"))
    around = [
        (0, F.when(method, _text("class Order", key, " {")).otherwise(_text("// order ", key))),
        (1, F.when(method, F.lit("  place(x) {")).otherwise(_text("function order", key, "(x) {"))),
        (9, _text("  function check", key, "(y) {")), (10, F.lit("    audit(y, '}');")), (11, F.lit("  }")), (12, F.lit("  total(x);")),
        (13, F.lit("  x.items.forEach((i) => { each(i); });")), (14, F.when(method, F.lit("} }")).otherwise(F.lit("}"))), (15, F.lit("register(1);")),
    ]
    frame = orders.select(F.lit(SHOP).alias("repo"), file, F.explode(F.array(*map(place, around))).alias("_l")).select("repo", "file", "_l.ln", "_l.line")
    calls = items.join(orders, F.col("l_orderkey") == key).select(
        F.lit(SHOP).alias("repo"), file, (key * 16 + 1 + F.col("l_linenumber")).alias("ln"), _text("  part", F.col("l_partkey"), "(x);").alias("line")
    )
    return frame.unionByName(calls)


def component_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per brand: a function per part with its tag ``p_size`` lines below, and hook calls."""
    part = table(spark, sf_dir, "part")
    file = _text("ui/", F.replace("p_brand", F.lit("#"), F.lit("")), ".jsx").alias("file")
    base = F.col("p_partkey") * 100 + 1
    heads = part.select(F.lit(SHOP).alias("repo"), file, base.alias("ln"), _text("export function Part", F.col("p_partkey"), "() {").alias("line"))
    hooks = part.select(
        F.lit(SHOP).alias("repo"), file, (base + F.lit(60)).alias("ln"), _text("  const v = useSize", F.col("p_size"), "();").alias("line")
    )
    tags = part.select(F.lit(SHOP).alias("repo"), file, (base + F.col("p_size")).alias("ln"), F.lit("  return <div>x</div>;").alias("line"))
    return heads.unionByName(hooks).unionByName(tags)


def fence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per brand: per part an opening fence, a link, a closing fence (missing for sizes
    above 40) and a heading."""
    part = table(spark, sf_dir, "part")
    file = _text("notes/", F.replace("p_brand", F.lit("#"), F.lit("")), ".md").alias("file")
    base = F.col("p_partkey") * 10 + 1
    rows = [(0, _text("```js")), (3, _text("[part](./p_", F.col("p_partkey"), ".md) must hold")), (7, _text("## Part ", F.col("p_partkey")))]
    out = part.filter(F.col("p_size") <= 40).select(F.lit(SHOP).alias("repo"), file, (base + 5).alias("ln"), F.lit("```").alias("line"))
    for offset, text in rows:
        out = out.unionByName(part.select(F.lit(SHOP).alias("repo"), file, (base + offset).alias("ln"), text.alias("line")))
    return out


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per supplier with a manifest: a misspelt popular package (which one by nation),
    express where the balance is positive, and a package of its own."""
    supplier = table(spark, sf_dir, "supplier")
    known = F.array(*[F.lit(k) for k in KNOWN_PACKAGES])
    popular = F.element_at(known, (F.col("s_nationkey") % len(KNOWN_PACKAGES) + 1).cast("int"))
    typo = F.substring(popular, F.lit(1), F.length(popular) - 1)
    own = F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    deps = F.concat_ws(
        ",\n    ", F.concat(F.lit('"'), typo, F.lit('": "1.0"')), F.when(F.col("s_acctbal") > 0, '"express": "4.0"'),
        F.concat(F.lit('"'), own, F.lit('": "1.0"')),
    )
    content = F.concat(F.lit('{\n  "name": "'), own, F.lit('",\n  "dependencies": {\n    '), deps, F.lit("\n  }\n}"))
    return supplier.select(_text("s_", F.col("s_suppkey")).alias("repo"), F.lit("package.json").alias("file"), content.alias("content"))


def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file per event: its properties as JSON, one key per line, next to its type."""
    events = table(spark, sf_dir, "events")
    content = F.concat(
        F.lit('{\n  "'), F.col("event_type"), F.lit('": '), F.col("value").cast("string"), F.lit(',\n  "props":\n  '), F.col("props"), F.lit("\n}")
    )
    return events.select(
        _text("u_", F.col("user_id")).alias("repo"), _text("events/e_", F.col("event_id"), ".json").alias("file"), content.alias("content")
    )


def setting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML and a TOML file per event, with texts over several lines, values in brackets and tables."""
    events = table(spark, sf_dir, "events")
    kind, value, event, user = (F.col(c).cast("string") for c in ("event_type", "value", "event_id", "user_id"))
    yaml = _text(
        "kind: ", kind, "\nrun: |\n  ", kind, ": text\n  total: 5\nvalue: ", value, " # measured\nuser: {id: ", user, ", tags: [a, b]}\nnote: 'first\n  second: ", event,
        "'\ndetails:\n  event: ", event, "\n  list:\n  - a: 1\n",
    )
    toml = _text("title = '''\nvalue = 1\n[not.table]\n'''\nvalue = ", value, "\n[server]\nport = ", user, '\ntags = [\n  "', kind, '",\n]\n[server.', kind, "]\nseen = true\n")
    both = F.explode(F.array(*[F.struct(F.lit(end).alias("end"), text.alias("content")) for end, text in ((".yaml", yaml), (".toml", toml))])).alias("_f")
    return events.select("user_id", "event_id", both).select(
        _text("u_", F.col("user_id")).alias("repo"), _text("settings/e_", F.col("event_id"), F.col("_f.end")).alias("file"), "_f.content"
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("repo"), _text(F.col("lang"), "/doc_", F.col("doc_id"), ".md").alias("file"), F.col("text").alias("content")
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by host and path; the page id keeps pages of one address apart."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.lit(WEB).alias("repo"),
        _text(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/page_", F.col("page_id"), ".html").alias("file"),
        F.col("html").alias("content"),
    )


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources.corpus import to_lines

    return normalize_facts(extract_html(to_lines(page_files(spark, sf_dir))))


def notebook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notebook per document: its text as a markdown cell, then code cells with imports and a plot."""
    docs = table(spark, sf_dir, "documents")
    cells = F.array(
        F.struct(F.lit("markdown").alias("cell_type"), F.col("text").alias("source")),
        F.struct(F.lit("code").alias("cell_type"), _text("import ", F.col("lang"), ", pandas as pd\nfrom ", F.col("source"), " import x\n").alias("source")),
        F.struct(F.lit("code").alias("cell_type"), _text("plt.plot(", F.col("n_chars"), ")").alias("source")),
    )
    return docs.select(
        F.col("source").alias("repo"), _text("nb/n_", F.col("doc_id"), ".ipynb").alias("file"),
        F.to_json(F.struct(cells.alias("cells"))).alias("content"),
    )


def handbook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handbook page per order with a line per part: a link to the part, a script, a path."""
    per_part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    part = F.col("l_partkey")
    return per_part.select(
        F.lit(SHOP).alias("repo"), _text("docs/o_", F.col("l_orderkey"), ".md").alias("file"), (part + 1).alias("ln"),
        _text("- [part](../parts/p_", part, ".md#top) with `npm run pack-", part % 100, "` see `parts/p_", part, ".md` and `npm test`").alias("line"),
    )


def handbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files the handbook talks about: pages of parts of size 25 and more."""
    part = table(spark, sf_dir, "part")
    return part.filter(F.col("p_size") >= 25).select(F.lit(SHOP).alias("repo"), _text("parts/p_", F.col("p_partkey"), ".md").alias("file"))


def handbook_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that exist: ``pack-<n>`` for n = nation keys; one row for the repository."""
    nation = table(spark, sf_dir, "nation")
    return nation.agg(
        F.map_from_entries(F.collect_set(F.struct(_text("pack-", F.col("n_nationkey")), F.lit("x")))).alias("scripts")
    ).select(F.lit(SHOP).alias("repo"), "scripts", F.lit(True).alias("readable"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about the change from ``import_lines`` to its later version, for every row.

    Per item: its import was removed. Per order: it imports the audit module now, and its file
    changed. Per part: nothing refers to it any more.
    """
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, prefix: str, kind: str, key: Column, **values: Column) -> DataFrame:
        have = {c: values.get(c, null) for c in ("target", "entity", "file", "route_path", "fact_type")}
        return df.select(
            _text(prefix, key).alias("claim_id"), F.lit(SHOP).alias("repo"), F.lit(kind).alias("type"), *[v.cast("string").alias(c) for c, v in have.items()]
        )

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey")
    order_file = _text("orders/o_", F.col("o_orderkey"), ".js")
    return (
        rows(items, "rm_", "import_removed", F.concat_ws("_", "l_orderkey", "l_partkey"),
             target=_text("../parts/p_", F.col("l_partkey"), ".js"), file=_text("orders/o_", F.col("l_orderkey"), ".js"))
        .unionByName(rows(orders, "add_", "import_added", F.col("o_orderkey"), target=F.lit("../audit/log.js"), file=order_file))
        .unionByName(rows(orders, "ch_", "file_changed", F.col("o_orderkey"), file=order_file))
        .unionByName(rows(part, "ref_", "no_remaining_references", F.col("p_partkey"), entity=_text("p_", F.col("p_partkey"), ".js")))
    )


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the web pages: every benchmark passage and every user turn."""
    bench = table(spark, sf_dir, "benchmark").select(_text("b", F.col("item_id")).alias("objective_id"), "text")
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        _text("c", F.col("conv_id"), "_", F.col("turn")).alias("objective_id"), "text"
    )
    return bench.unionByName(turns).select("objective_id", F.lit(WEB).alias("repo"), "text")


def worded_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order in one of five wordings, by its priority; limits from its price."""
    orders = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    words = F.floor(F.col("o_totalprice")).cast("long")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", _text("Why does order_", key, " fail with status ", status, "?"))
        .when(F.col("o_orderpriority") == "2-HIGH", _text("Give me exactly ", key % 9 + 1, " insights about orders/o_", key, ".js and cite evidence"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", _text("What uses parts.js in order-", key, "? Answer in under ", words, " words"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", _text("Overview: the top five major risks, maximum ", key % 20, " evidence, no file enumeration"))
        .otherwise(_text("hotspot analysis of the ", F.lower(status), "_queue and the architecture"))
    )
    return orders.select(_text("o", key).alias("objective_id"), F.lit(SHOP).alias("repo"), text.alias("text"))


def experience_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per event: errors failed, the rest succeeded; signups lack a valid outcome."""
    events = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "unknown").otherwise("success")
    return events.select(
        _text("u_", F.col("user_id")).alias("repo"), F.col("event_type").alias("task"), _text("value ", F.floor("value").cast("long")).alias("strategy"),
        outcome.alias("outcome"), _text("e", F.col("event_id")).alias("evidence_source"), "ts", "event_id",
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review per event, one ledger per user, numbered by event id; errors contradict their claim."""
    from factloom.functions.runs import number_rows

    events = table(spark, sf_dir, "events")
    numbered = number_rows(events, ["user_id"], [F.floor(F.col("event_id") / 4096)], [F.col("event_id")], "n")
    bad = F.col("event_type") == "error"
    result = F.struct(
        _text("handled ", F.col("event_type")).alias("claim"), F.when(bad, "contradicted").otherwise("supported").alias("verdict"),
        F.lit("checked").alias("reason"), F.array().cast("array<struct<file:string,line:int>>").alias("evidence"),
    )
    return numbered.select(
        F.col("user_id").alias("ledger"), (F.col("n") - 1).alias("seq"), _text("e", F.col("event_id")).alias("ts"), F.lit("HEAD").alias("base"),
        F.lit(None).cast("string").alias("head"), F.when(bad, "REJECT").otherwise("ACCEPT").alias("overall"),
        F.array(F.col("event_type")).alias("reasons"), F.lit(1).alias("changed_files"), F.array(result).alias("results"),
        "value", "event_type",
    )
