"""Scans end to end: sources, registry, derived nodes, snapshots."""

import os

import pytest
from helpers import files, rows
from pyspark.sql import functions as F
from test_extract import EXPRESS

from factloom.operators import derive, extract, graph, markers
from factloom.plans.scan import scan
from factloom.registry import Extractor, Registry, guarded, validate_extractor
from factloom.session import fresh_folder
from factloom.sources import corpus, snapshots

PACKAGE = {"package.json": '{"name": "sample", "dependencies": {"express": "4"}}'}


def test_read_corpus_keeps_env_files_and_skips_hidden_ones(spark, tmp_path):
    for name in ("src/app.js", "src/_app.js", ".env.local", ".hidden", ".git/config", "node_modules/x/i.js", "deep/a/b/c.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"one\ntwo \xff\n")
    os.symlink(tmp_path / "src/app.js", tmp_path / "link.js")
    got = corpus.read_corpus(spark, {"r": str(tmp_path)})
    assert rows(got, "repo", "file") == [("r", f) for f in (".env.local", "deep/a/b/c.md", "node_modules/x/i.js", "src/_app.js", "src/app.js")]
    assert corpus.filter_ignored(got).count() == 4
    assert "�" in got.filter("file = 'src/app.js'").first()["content"]
    assert rows(corpus.read_corpus(spark, {"r": str(tmp_path)}, "*.md"), "file") == [("deep/a/b/c.md",)]
    assert rows(corpus.read_corpus_binary(spark, str(tmp_path), "r", "*.md"), "file") == [("deep/a/b/c.md",)]


def test_ignore_patterns(spark):
    fs = files(spark, {f: "" for f in ("a/x.js", "a/b/x.js", "vendor/y.js", "gen/z.min.js", "src/vendor.js")})
    assert rows(corpus.filter_ignored(fs, ["vendor", "./a/b/", "*.min.js"]), "file") == [("a/x.js",), ("src/vendor.js",)]
    patterns = spark.createDataFrame([("r", "vendor"), ("r", "a/b"), ("r", "*.min.js"), ("other", "src")], "repo string, pattern string")
    assert rows(corpus.filter_ignored_by_repo(fs, patterns), "file") == [("a/x.js",), ("src/vendor.js",)]


def test_buckets_and_coverage(spark):
    fs = files(spark, {"app.js": "x", "main.go": "x", "README.md": "x"}).unionByName(files(spark, {"a.go": ""}, "empty"))
    stats = corpus.coverage_stats(corpus.assign_bucket(fs))
    assert rows(stats, "repo", "files_discovered", "files_supported", "files_skipped", "coverage_percent", "status") == [
        ("empty", 1, 0, 1, None, "no_supported_files"), ("r", 3, 2, 1, 100.0, "success")]
    names = files(spark, {f: "" for f in ("package.json", "tsconfig.json", ".env", ".env.prod", "x/a.bash", "N.IPYNB", "y.lua")})
    got = dict(rows(corpus.assign_bucket(names, {".ipynb": "nb"}), "file", "bucket"))
    assert got == {"package.json": None, "tsconfig.json": "configFiles", ".env": "envFiles", ".env.prod": "envFiles", "x/a.bash": "shellFiles", "N.IPYNB": "nb", "y.lua": "luaFiles"}


def test_scan_of_a_small_project(spark):
    s = scan(files(spark, {**EXPRESS, **PACKAGE, "doc.md": "[u](routes/users.js) [w](https://x)\n", "s.sh": "source ./lib.sh\n"}))
    assert s.facts.filter("type = 'express_route'").count() == 4
    assert rows(graph.list_components(s.facts), "name", "kind") == [("UserCard", "function")]
    summary = s.nodes.filter("type = 'architecture_summary'").first()
    assert "Express, React" in summary["description"] and summary["description"].startswith('"sample" — ') and summary["confidence"] == "high"
    kinds = {r["type"]: r["n_support"] for r in s.nodes.collect()}
    assert kinds == {"architecture_summary": 5, "api_surface": 4, "component_index": 1, "file_dependency": 1, "shell_dependency": 1, "doc_reference": 1}
    # Every supporting id is a fact of the scan.
    assert s.support.join(s.facts.select(F.col("id").alias("fact_id")), "fact_id", "left_anti").count() == 0
    assert s.meta.first()["status"] == "success" and s.findings.count() == 0 and s.warnings.count() == 0
    assert rows(graph.overview(s.nodes, s.meta), "repo", "status", "confidence") == [("r", "success", "high")]


def test_undeclared_framework_and_empty_repos(spark):
    s = scan(files(spark, {"server.js": EXPRESS["server.js"]}).unionByName(files(spark, {"a.go": "x"}, "go")))
    nodes = {(r["repo"], r["type"]): r["description"] for r in s.nodes.collect()}
    assert "Express" in nodes[("r", "architecture_summary")] and not any(repo == "go" for repo, _ in nodes)


def test_partial_scans_say_so(spark):
    s = scan(files(spark, {"a.js": "x();"}), incomplete=True)
    kinds = {r["type"]: r["confidence"] for r in s.nodes.collect()}
    assert kinds["scan_incomplete_notice"] == "high" and kinds["architecture_summary"] == "low" and s.meta.first()["status"] == "timeout"


def test_distinct_targets_keep_all_support(spark):
    s = scan(files(spark, {"a.js": 'import x from "./b";\nconst y = require("./b");\nimport z from "./c";\nimport q from "lib";\n'}))
    node = s.nodes.filter("type = 'file_dependency'").first()
    assert (node["n_targets"], node["n_support"]) == (2, 3)
    nested = derive.nested_targets(s.support.filter("type = 'file_dependency'")).first()
    assert nested["targets"] == ["./b", "./c"] and len(nested["based_on"]) == 3


def test_one_bad_file_or_extractor_does_not_end_a_scan(spark):
    fs = files(spark, {"good.txt": "k=v", "bad.txt": "boom", "a.js": 'import "./b"'}).unionByName(spark.createDataFrame([("r", "lost.js", None)], "repo string, file string, content string"))

    def parse(file, content):
        if content == "boom":
            raise ValueError("cannot read this")
        return [{"line": 1, "name": content.split("=")[0]}]

    def broken(lines):
        raise RuntimeError("no plan")

    registry = Registry()
    undo = registry.register(Extractor("notes", "textFiles", "facts", guarded(parse, "note"), (".txt",)))
    registry.register(Extractor("broken", "files", "facts", broken))
    s = scan(fs, registry=registry)
    assert rows(s.facts, "type", "file", "entity") == [("import", "a.js", "./b"), ("note", "good.txt", "k")]
    assert rows(s.warnings, "file", "error") == [("(project-level)", "no plan"), ("bad.txt", "cannot read this"), ("lost.js", "file could not be read")]
    assert s.meta.first()["files_failed"] == 3
    undo()
    assert ("notes", "textFiles", "facts") not in registry.list()


def test_registry_contract():
    fine = dict(name="n", bucket="newBucket", kind="facts", extract=lambda f: f)
    for change in ({"name": ""}, {"bucket": ""}, {"kind": "x"}, {"extract": None}, {"extensions": ("txt",)}, {"extensions": (".js",)}, {"bucket": "files", "extensions": (".txt",)}):
        with pytest.raises(ValueError):
            validate_extractor(Extractor(**{**fine, **change}))
    registry = Registry()
    with pytest.raises(ValueError):
        registry.register(Extractor("shell", "b", "facts", lambda f: f))
    with pytest.raises(ValueError):
        registry.register(Extractor("mine", "b", "facts", lambda f: f, (".py",)))


def test_snapshots_round_trip_and_missing_ones(spark):
    path = fresh_folder(spark, "snap")
    assert snapshots.read_snapshot(spark, path) is None
    s = scan(files(spark, {**EXPRESS, **PACKAGE}))
    snapshots.write_snapshot(s.tables(), path, "s1")
    snapshots.write_snapshot(s.tables(), path, "s2")
    snapshots.write_snapshot(s.tables(), path, "s2")
    back = snapshots.read_snapshot(spark, path)
    assert snapshots.latest_snapshot_id(spark, path) == "s2"
    assert rows(back["facts"], "id") == rows(s.facts, "id") and back["support"].count() == s.support.count()
    log = fresh_folder(spark, "log")
    spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string").write.text(log)
    assert [r["entry"] is None for r in snapshots.read_jsonl_log(spark, log, "a int").orderBy("raw").collect()] == [False, True]
    memory = snapshots.read_memory_documents(spark.createDataFrame([("r", "{broken"), ("s", '{"projectMemory": ["x"]}')], "repo string, content string"))
    assert rows(memory, "repo", "version", F.size("project_memory"), F.size("experience")) == [("r", 1, 0, 0), ("s", 1, 1, 0)]


def test_a_scan_reads_the_corpus_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    contents = {**EXPRESS, **PACKAGE, "doc.md": "# T\n", "run.sh": "ls\n", "P.vue": "<script>\nexport default {name: 'Q'}\n</script>\n",
                "exec.js": "const cp = require('child_process');\n/*\n cp.exec(`a ${b}`)\n*/\ncp.exec(`rm ${x}`);\n", "a.yml": "k: 1\n", "x.go": "x"}
    fs = files(spark, contents)
    s = scan(fs.mapInPandas(count, fs.schema))
    for table in s.tables().values():
        table.collect()
    assert read.value == len(contents)
    assert rows(s.findings, "file", "line") == [("exec.js", 5)]
    assert rows(s.facts.filter("type = 'vue_component'"), "entity") == [("Q",)]


def test_marked_lines_give_the_facts_of_whole_files(spark):
    text = ("import {\n  a,\n} from './a';\nexport {\n  b\n} from './b';\n// import './no'\nimport z, { y } from \"z\"\n" "const r = require('r'), q = require(\"q\")\n/* useIt()\nimport './c'\n*/\n"
            "class K extends React.Component {\n  render() {\n    return <div>{useThing(f(1))}</div>;\n  }\n}\n"
            "const Box = (p) =>\n  <p>{g(p)}</p>\n\nfunction Outer(\n  a,\n  b\n) {\n  const inner = () => { h(); };\n  return (\n    <Box />\n  );\n}\n"
            "app.get('/x', one);\nrouter.use('/y', two)\nconst s = 'app.get(\"/no\", x)'\n")
    fs = files(spark, {f"f{i}.tsx": text * i for i in (1, 150)}).withColumn("bucket", F.lit("files"))
    columns = ["file", "type", "line", "name", "target", "caller", "callee", "route_path", "evidence", "line_hash", "pos"]
    want = extract.extract_code(extract.code_lines(fs)).select(*columns)
    got = markers.code_facts(markers.split_corpus(fs)).select(*columns)
    assert want.count() > 1000 and rows(got, *columns) == rows(want, *columns)


def test_snapshots_commit_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "snap")

    def tables(*repos):
        facts = spark.createDataFrame([(r, i) for r in repos for i in range(3)], "repo string, id int")
        return {"facts": facts, "findings": facts.filter("id > 5"), "meta": facts.select("repo").distinct()}

    snapshots.write_snapshot(tables("1", "2"), path, "s1")
    # A second attempt without the repository 2 replaces the first as a whole; an attempt that fails is not seen.
    snapshots.write_snapshot(tables("1"), path, "s1")
    broken = {**tables("9"), "meta": spark.createDataFrame([("9",)], "repo string").select("repo", F.raise_error(F.lit("lost")).cast("int").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        snapshots.write_snapshot(broken, path, "s2")
    assert snapshots.latest_snapshot_id(spark, path) == "s1" and snapshots.superseded_attempts(spark, path).count() == 1
    back = snapshots.read_snapshot(spark, path)
    assert rows(back["facts"], "repo", "id", "snapshot_id") == [("1", i, "s1") for i in range(3)]
    assert back["findings"].count() == 0 and back["findings"].columns == ["repo", "id", "snapshot_id"]

    many = [f"r{i}" for i in range(200)]
    snapshots.write_snapshot(tables(*many), path, "s3")
    back = snapshots.read_snapshot(spark, path, repos=["r7"])
    assert rows(back["facts"], "repo", "id") == [("r7", i) for i in range(3)]
    assert snapshots.read_snapshot(spark, path, "s1")["meta"].count() == 1 and snapshots.read_snapshot(spark, path, "s0") is None
    files = snapshots.read_snapshot(spark, path)["facts"].inputFiles()
    assert len(files) <= snapshots.REPO_BUCKETS and len(back["facts"].inputFiles()) >= 1
    plan = back["facts"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(repo_bucket" in plan or "PartitionFilters: [isnotnull(repo_bucket" in plan

    os.remove(files[0].removeprefix("file://").replace("%3D", "="))
    for f in files[1:]:
        os.remove(f.removeprefix("file://").replace("%3D", "="))
    with pytest.warns(UserWarning, match="cannot be read"):
        assert snapshots.read_snapshot(spark, path) is None


def test_the_listing_skips_what_nobody_reads(spark, tmp_path):
    from factloom.sources.tree import SourceTree

    names = [f"flat/f{i:03}.js" for i in range(40)] + ["node_modules/x/i.js", "gen/deep/a.js", "gen/b.min.js", "big.bin", "package.json", ".env", "A.MD"]
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * 1000)
    os.chmod(tmp_path / "big.bin", 0)
    got = corpus.read_corpus(spark, {"r": str(tmp_path)}, ignore=["gen/deep", "*.min.js"], texts=Registry().text_endings())
    want = corpus.filter_ignored(corpus.read_corpus(spark, {"r": str(tmp_path)}), ["gen/deep", "*.min.js"])
    assert rows(got, "file") == rows(want, "file") and got.count() == 44
    assert rows(got.filter("content IS NULL"), "file") == [("big.bin",)]
    # A flat folder is cut by bytes into ranges of names that cover it once; a small tree is one piece.
    options = {"path": str(tmp_path), "splitBytes": str(50_000)}
    reader = SourceTree(options).reader(None)
    pieces = reader.partitions()
    assert 4 <= len(pieces) <= 7 and len(SourceTree({"path": str(tmp_path)}).reader(None).partitions()) == 1
    seen = [f for p in pieces for batch in reader.read(p) for f in batch.column("file").to_pylist()]
    assert sorted(seen) == sorted(names)


def test_many_folders_share_a_bounded_number_of_pieces(spark, tmp_path):
    from factloom.sources.tree import _PIECES, SourceTree

    texts = spark.range(3 * _PIECES).selectExpr("concat('d', id, '/deep/t.txt') AS file", "nullif(concat('text ', id), 'text 7') AS text")
    twice = texts.unionByName(texts.filter("file = 'd5/deep/t.txt'"))
    assert corpus.write_corpus(twice, str(tmp_path)) == 3 * _PIECES
    assert len(SourceTree({"path": str(tmp_path)}).reader(None).partitions()) <= 2 * _PIECES
    got = dict(rows(corpus.read_corpus(spark, {"r": str(tmp_path)}), "file", "content"))
    assert len(got) == 3 * _PIECES and got["d5/deep/t.txt"] == "text 5\ntext 5\n" and got["d7/deep/t.txt"] == "\n" and got["d9/deep/t.txt"] == "text 9\n"
