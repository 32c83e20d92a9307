"""Deltas, claims, dossiers, ledgers, memory, documentation."""

import json

import pytest
from helpers import files, lines, rows
from pyspark.sql import functions as F

from factloom.operators import documents as D
from factloom.operators import dossier as B
from factloom.operators import ledger as L
from factloom.operators import memory as M
from factloom.operators import review as R
from factloom.operators import verification as V
from factloom.operators.extract import extract_imports
from factloom.operators.facts import normalize_facts
from factloom.plans.review import review_change
from factloom.plans.scan import scan
from factloom.sources.corpus import read_manifests

FACT = "id string, repo string, type string, file string, line long, name string, target string, callee string, caller string, route_path string, evidence string, entity string, ext_ord int, pos int"
CLAIM = "claim_id string, repo string, type string, target string, entity string, file string, route_path string, fact_type string"


def facts(spark, *items):
    base = dict.fromkeys(("name", "target", "callee", "caller", "route_path", "evidence", "entity"))
    out = []
    for i, item in enumerate(items):
        row = {**base, "id": f"f{i}", "repo": "r", "type": "import", "file": "a.js", "line": 1, "ext_ord": 1, "pos": 0, **item}
        out.append(tuple(row[c.strip().split(" ")[0]] for c in FACT.split(",")))
    return spark.createDataFrame(out, FACT)


def test_delta_ignores_ids_and_lines_but_counts_duplicates(spark):
    call = {"type": "function_call", "callee": "f", "entity": "f"}
    before = facts(spark, {"id": "x1", "target": "a", "entity": "a"}, {**call, "caller": "m", "line": 3}, {**call, "caller": "m", "line": 9}, {"id": "h1", "type": "doc", "entity": "h1", "evidence": "same"})
    after = facts(spark, {"id": "x2", "target": "a", "entity": "a", "line": 40}, {**call, "caller": "m", "line": 5}, {**call, "caller": "other", "line": 5}, {"id": "h2", "type": "doc", "entity": "h2", "evidence": "same"})
    assert rows(V.delta(before, after), "side", "caller", "line") == [("added", "other", 5), ("removed", "m", 9)]
    assert rows(V.number_occurrences(before).filter("callee = 'f'"), "line", "occurrence") == [(3, 0), (9, 1)]


def test_drift_statuses(spark):
    old = normalize_facts(extract_imports(lines(spark, {"a.js": 'import "x"\nimport "y"\nimport "z"\n', "gone.js": 'import "g"\n'})))
    old = old.unionByName(facts(spark, {"id": "n", "line": None, "evidence": None}), allowMissingColumns=True)
    now = {"a.js": '  import "x"  \nimport "changed"'}
    got = V.verify_facts(old, files(spark, now), lines(spark, now))
    assert rows(got, "file", "line", "status") == [("a.js", None, "unverifiable"), ("a.js", 1, "confirmed"), ("a.js", 2, "stale"), ("a.js", 3, "line_gone"), ("gone.js", 1, "file_missing")]
    assert V.drift_summary(got).first().asDict() == {"confirmed": 1, "stale": 1, "file_missing": 1, "line_gone": 1, "unverifiable": 1, "total": 5}


def claims(spark, **items):
    fields = [c.strip().split(" ")[0] for c in CLAIM.split(",")]
    return spark.createDataFrame([tuple({"claim_id": k, "repo": "r", **v}.get(f) for f in fields) for k, v in items.items()], CLAIM)


def test_a_review_from_end_to_end(spark):
    before = {"a.js": 'import _ from "lodash";\nlegacyFn();\n', "b.js": 'import a from "./a";\n', "test/a.test.js": 'import a from "../a";\n', "c.js": 'import fs from "node:fs";\n'}
    after = {**before, "a.js": "const n = require(name);\n", "c.js": 'import fs from "node:fs";\nimport chalk from "chalk";\nconst s = "legacyFn";\n'}
    asked = claims(
        spark, removed={"type": "import_removed", "target": "lodash", "file": "a.js"}, kept={"type": "import_removed", "target": "node:fs"}, never={"type": "fact_removed", "entity": "zzz"},
        added={"type": "import_added", "target": " chalk "}, old={"type": "import_added", "target": "node:fs"}, absent={"type": "import_added", "target": "nope"},
        route={"type": "route_exists", "route_path": "/x"}, text={"type": "no_remaining_references", "entity": "legacyFn"}, clean={"type": "no_remaining_references", "entity": "lodash"},
        diff={"type": "file_changed", "file": "a.js"}, same={"type": "file_changed", "file": "b.js"}, test={"type": "test_fixed", "file": "t.js"}, odd={"type": "made_up"}, short={"type": "file_changed"},
    )
    r = review_change(scan(files(spark, before)), scan(files(spark, after)), asked)
    assert dict(rows(r.verdicts, "claim_id", "verdict")) == {
        "removed": "supported", "kept": "contradicted", "never": "unverifiable", "added": "supported", "old": "contradicted", "absent": "contradicted", "route": "unverifiable",
        "text": "unverifiable", "clean": "supported", "diff": "supported", "same": "contradicted", "test": "unverifiable", "odd": "unverifiable", "short": "unverifiable",
    }
    assert rows(r.changed, "file", "change") == [("a.js", "modified"), ("c.js", "modified")]
    assert rows(r.dependents, "file", "target", "is_test") == [("b.js", "a.js", False), ("test/a.test.js", "a.js", True)]
    assert rows(r.dynamic, "file", "line", "argument") == [("a.js", 1, "name")]
    assert r.overall.first()["level"] == "REJECT"


def test_levels(spark):
    verdicts = spark.createDataFrame([("bad", "contradicted"), ("ok", "supported"), ("open", "unverifiable"), ("gap", "supported")], "repo string, verdict string")
    gaps = spark.createDataFrame([("ok", 0, 0, 0), ("gap", 0, 0, 1), ("none", 0, 0, 0)], "repo string, unclaimed int, dependents int, coverage_gaps int")
    assert dict(rows(R.overall(verdicts, gaps), "repo", "level")) == {"bad": "REJECT", "ok": "ACCEPT", "open": "REVIEW", "gap": "REVIEW", "none": "REVIEW"}
    changes = facts(spark, {"entity": "x"}, {"entity": "y", "file": "b.js"}).withColumn("side", F.lit("added"))
    assert rows(R.unclaimed(changes, claims(spark, c={"entity": "x"}, d={"file": "z.js"})), "entity") == [("y",)]


def test_dossier(spark):
    src = {"a.js": 'import "./x";\nconst q = require(dyn);\n', "b.js": 'import "./a";\n', "test/a.test.js": 'import "../a";\n'}
    fs, ls = files(spark, src), lines(spark, src)
    own = normalize_facts(extract_imports(ls))
    asked = spark.createDataFrame([("r", "a.js"), ("r", "none.js")], "repo string, file string")
    got = {r["file"]: r for r in B.dossier(asked, fs, own, lines=ls).collect()}
    assert (got["a.js"]["n_imports"], got["a.js"]["n_source_dependents"], got["a.js"]["n_test_dependents"], got["a.js"]["error"]) == (1, 1, 1, None)
    assert any("dynamic" in n and " 2;" in n for n in got["a.js"]["notes"]) and got["none.js"]["error"].startswith("file not found")


def test_ledgers_chain_and_break(spark):
    schema = "ledger string, seq long, ts string, base string, head string, overall string, reasons array<string>, changed_files int, results array<struct<claim:string,verdict:string,reason:string,evidence:array<struct<file:string,line:int>>>>"
    result = [("a", "contradicted", "r", [("f.js", 1)])]
    reviews = spark.createDataFrame([("l", i, f"2024-01-0{i + 1}T00:00:00Z", "HEAD", None, "REJECT", ["x"], 1, result) for i in range(2)], schema)
    empty = spark.createDataFrame([], "ledger string, seq long, raw string")
    first = L.ledger_append(empty, reviews)
    both = first.unionByName(L.ledger_append(first, reviews))
    entries = [json.loads(r["raw"]) for r in both.orderBy("seq").collect()]
    assert [e["prev"] for e in entries] == ["genesis"] + [e["hash"] for e in entries[:-1]] and list(entries[0])[-2:] == ["prev", "hash"]
    assert L.ledger_verify(both).first().asDict() == {"ledger": "l", "entries": 4, "ok": True, "bad_index": None, "reason": None}
    for change, reason in (('"overall":"ACCEPT"', "entry altered"), ("{oops", "unreadable entry")):
        raw = F.regexp_replace("raw", '"overall":"REJECT"', change) if change[0] == '"' else F.lit(change)
        broken = both.withColumn("raw", F.when(F.col("seq") == 1, raw).otherwise(F.col("raw")))
        assert rows(L.ledger_verify(broken), "bad_index", "reason") == [(1, reason)]
    assert rows(L.ledger_verify(both.filter("seq <> 0").withColumn("seq", F.col("seq") - 1)), "bad_index", "reason") == [(0, "chain broken")]
    assert rows(L.ledger_history(both, 3), "seq", "contradicted") == [(1, 1), (2, 1), (3, 1)]
    none = spark.createDataFrame([], "id string")
    found = M.suggest_from_ledger(both, none)
    assert rows(found, "strategy") == [("claimed: a (contradicted by the code)",)] and M.suggest_from_ledger(both, found).count() == 0


def test_memory(spark):
    rules, refused = M.propose_rules(spark.createDataFrame([("r", "use x", None, "seen", 1), ("r", "use y", "style", None, 1), ("r", "  ", None, None, 1)], "repo string, rule string, category string, evidence_note string, ts long"))
    assert rows(rules, "rule", "category", "confidence", "status") == [("use x", "convention", 0.5, "proposed"), ("use y", "style", 0.3, "proposed")] and refused.count() == 1
    one = rules.filter("rule = 'use x'").first()["id"]
    events = spark.createDataFrame([(one, "rejected", 1), (one, "approved", 2), ("nope", "approved", 1)], "id string, status string, ts long")
    current, unknown = M.set_status(rules, events)
    assert rows(M.list_rules(current, "approved"), "rule") == [("use x",)] and rows(unknown, "id") == [("nope",)]
    runs = spark.createDataFrame([("r", "t", "s", o, None, 1) for o in ("success", "failure", "maybe")], "repo string, task string, strategy string, outcome string, evidence_source string, ts long")
    log, bad = M.log_experience(runs)
    assert M.list_experience(log, "failure").count() == 1 and bad.count() == 1


def test_documentation_checks(spark):
    src = {
        "README.md": "see [a](docs/a.md) and [b](docs/gone.md#x) [w](https://x.y) [top](#t)\n`npm run build` and `npm run nope` `npm test`\n`src/no.js` `src/yes.js` `other/no.js`\n```\n[in](fence.md)\nnpm run inside\n```\n",
        "docs/a.md": "[up](../README.md) [dir](../src)\n", "src/yes.js": "",
    }
    fs = files(spark, {**src, "package.json": '{"scripts": {"build": "x"}}'})
    got = rows(D.contradictions(lines(spark, src), fs, read_manifests(fs)), "kind", "file", "line")
    assert got == [("broken_link", "README.md", 1), ("missing_npm_script", "README.md", 2), ("missing_npm_script", "README.md", 2), ("missing_npm_script", "README.md", 6), ("missing_path", "README.md", 3)]


def test_brief(spark):
    rules = spark.createDataFrame([("r", f"id{i}", f"rule {i}", "approved" if i < 12 else "proposed", i) for i in range(14)], "repo string, id string, rule string, status string, ts long")
    shown, counts = B.brief_rules(rules)
    assert shown.count() == 10 and rows(counts, "more", "not_approved") == [(2, 2)]
    log = spark.createDataFrame([("r", 1, "t1", "s1", "failure"), ("r", 2, "t2", "s2", "success"), ("r", 3, "t3", "s3", "reverted")], "repo string, ts long, task string, strategy string, outcome string")
    tries = spark.createDataFrame([("r", 9, "t4", "s4", "approved"), ("r", 9, "t5", "s5", "proposed")], "repo string, ts long, task string, strategy string, status string")
    assert [r["task"] for r in B.brief_failures(log, tries)[0].orderBy("age").collect()] == ["t4", "t3", "t1"]


def test_closure_goes_to_the_end(spark):
    from factloom.operators.graph import transitive_impact

    edges = spark.createDataFrame([("r", f"f{i}", f"f{i + 1}.js") for i in range(9)], "repo string, target_key string, file string")
    targets = spark.createDataFrame([("r", "f0.js")], "repo string, target string")
    assert rows(transitive_impact(edges, targets), "file", "depth", "cut") == [(f"f{i}.js", i, False) for i in range(1, 10)]
    assert rows(transitive_impact(edges, targets, 7), "file", "depth", "cut") == [(f"f{i}.js", i, True) for i in range(1, 8)]
    assert {r.cut for r in transitive_impact(edges, targets, 9).collect()} == {False}


def test_drift_behind_the_snippet(spark):
    from factloom.operators.extract import extract_imports
    from factloom.operators.facts import normalize_facts
    from factloom.operators.verification import verify_facts
    from helpers import files, lines

    before = 'import a from "a"; ' + "x" * 200
    facts = normalize_facts(extract_imports(lines(spark, {"a.js": before, "b.js": before})))
    after = {"a.js": before + " changed", "b.js": "  " + before}
    found = verify_facts(facts, files(spark, after), lines(spark, after))
    assert rows(found, "file", "status") == [("a.js", "stale"), ("b.js", "confirmed")]
    old = verify_facts(facts.drop("line_hash"), files(spark, after), lines(spark, after))
    assert rows(old, "file", "status") == [("a.js", "confirmed"), ("b.js", "confirmed")]


def test_long_attempts_stay_apart(spark):
    from factloom.operators.memory import propose_attempts

    text = "t" * 400
    said = spark.createDataFrame([(text + end, "s" * 500, "manual", "e", None) for end in "abb"], "task string, strategy string, source string, evidence string, ts timestamp")
    found = propose_attempts(spark.createDataFrame([], "id string"), said).collect()
    assert sorted(r.task for r in found) == [text + "a", text + "b"] and len({r.id for r in found}) == 2


def test_quotes_behind_the_snippet_and_dropped_explanations(spark):
    from factloom.operators.grounding import ground_explanations, ground_statements

    said = spark.createDataFrame([("s", "t", ["f"], "the far end")], "statement_id string, text string, cites array<string>, quote string")
    known = spark.createDataFrame([("f", "short", "short and the far end")], "fact_id string, evidence string, text string")
    assert [r.kept for r in ground_statements(said, known).collect()] == [True]
    assert [r.kept for r in ground_statements(said, known.drop("text")).collect()] == [False]
    given = spark.createDataFrame([("p", i, f"e{i}", ["f" if i % 2 else "none"]) for i in range(20)] + [("q", 0, "e", ["none"])], "problem_id string, pos int, explanation string, fact_ids array<string>")
    picked = spark.createDataFrame([("p", "f")], "problem_id string, fact_id string")
    facts = spark.createDataFrame([("f", "r", "a.js", 1)], "id string, repo string, file string, line int")
    edges = spark.createDataFrame([("r", "a", "a.test.js", "import", "a", "d")], "repo string, target_key string, file string, via string, raw_target string, derived_id string")
    kept, _, _, counts = ground_explanations(given, picked, edges, facts)
    assert kept.count() == 10 and rows(counts, "problem_id", "n_given", "n_kept", "n_dropped") == [("p", 20, 10, 10), ("q", 1, 0, 1)]
    kept, _, _, counts = ground_explanations(given, picked, edges, facts, read_up_to=8, keep=3)
    assert kept.count() == 3 and rows(counts.filter("problem_id = 'p'"), "n_kept", "n_dropped") == [(3, 17)]


def test_broken_snapshots_warn(spark, tmp_path):
    from factloom.sources.snapshots import latest_snapshot_id, read_snapshot

    assert read_snapshot(spark, str(tmp_path / "none")) is None
    folder = tmp_path / "meta"
    folder.mkdir()
    (folder / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.warns(UserWarning, match="cannot be read"):
        assert latest_snapshot_id(spark, str(tmp_path)) is None
    with pytest.warns(UserWarning, match="cannot be read"):
        assert read_snapshot(spark, str(tmp_path)) is None


def test_the_verdict_extracts_each_version_once(spark, monkeypatch):
    from factloom.queries import review as Q

    made = []
    versions = {c: facts(spark, {"target": t, "entity": t}) for c, t in ((False, "x"), (True, "y"))}
    monkeypatch.setattr(Q.A, "stored_import_facts", lambda spark, sf_dir, changed=False: made.append(changed) or versions[changed])
    monkeypatch.setattr(Q.A, "claims", lambda spark, sf_dir: spark.createDataFrame([("c1", "shop", "import_removed", "x", None, None, None, None)], CLAIM))
    monkeypatch.setattr(Q.A, "import_lines", lambda spark, sf_dir, changed=False: spark.createDataFrame([("shop", "a.js", 1, "b" if changed else "a")], "repo string, file string, ln long, line string"))
    monkeypatch.setattr(Q, "_some_claims", lambda spark, sf_dir: spark.createDataFrame([("shop", None, None, None)], "repo string, target string, entity string, file string"))
    Q.overall(spark, "")
    assert sorted(made) == [False, True]


def test_claims_of_all_kinds_meet_facts_in_one_pass(spark):
    """With and without type and file side by side, a claim counts what it names and nothing twice."""
    before = facts(spark, *[{"target": "x", "entity": "x", "file": f, "type": t} for f in ("a.js", "b.js") for t in ("import", "doc_link")])
    asked = [("c1", "r", "fact_removed", None, "x", None, None, None), ("c2", "r", "fact_removed", None, "x", "a.js", None, None),
             ("c3", "r", "fact_removed", None, "x", None, None, "doc_link"), ("c4", "r", "import_removed", "x", None, "b.js", None, None)]
    empty = spark.createDataFrame([], "repo string, file string, ln long, line string")
    got = R.evaluate_claims(spark.createDataFrame(asked, CLAIM), before, before.limit(0), empty.select("repo", "file"), empty)
    assert rows(got, "claim_id", "verdict", "n_evidence") == [("c1", "supported", 4), ("c2", "supported", 2), ("c3", "supported", 2), ("c4", "supported", 1)]


def test_stored_imports_hold_what_readers_ask_for(spark, monkeypatch):
    from factloom.sources import adapters as A

    monkeypatch.setattr(A, "import_lines", lambda spark, sf_dir, changed=False: lines(spark, {"a.js": 'import x from "../lib.js";'}))
    plain, full = A.stored_import_facts(spark, ""), A.stored_import_facts(spark, "", texts=True)
    assert not {"evidence", "line_hash"} & {*plain.columns} and {"evidence", "line_hash"} <= {*full.columns}
    # Ids are made by readers: the written files have none.
    assert all('"id"' not in spark.read.parquet(*f.inputFiles()).schema.json() for f in (plain, full))
    assert rows(plain, "id", "entity") == rows(A.import_facts(spark, ""), "id", "entity")


def test_packed_ids_come_back(spark):
    from factloom.functions.text import packed_id, unpacked_id

    ids = ["import_" + "0a" * 16, "0a" * 16, "import_" + "0A" * 16, "é" * 40, "", None]
    packed = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("p", packed_id(F.col("id")))
    assert [r.u for r in packed.select(unpacked_id(F.col("p")).alias("u")).collect()] == ids
    assert packed.select("p.tail").first().tail == bytes([10] * 16) and packed.filter("p IS NULL").count() == 1


def test_drift_moves_ids_packed_and_no_snippets(spark):
    old = facts(spark, {"id": "import_" + "0b" * 16, "file": "a.js", "line": 1, "evidence": "x"}, {"id": "n", "file": "a.js", "line": 9, "evidence": "x"}, {"id": None, "file": "b.js", "line": 1, "evidence": "y"}, {"id": "u", "evidence": None})
    now = {"a.js": "x"}
    found = V.verify_facts(old, files(spark, now), lines(spark, now))
    assert {(r.id, r.status, r.current_evidence) for r in found.collect()} == {("import_" + "0b" * 16, "confirmed", "x"), ("n", "line_gone", None), (None, "file_missing", None), ("u", "unverifiable", "x")}
    plan = found.select("id", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "current_evidence" not in plan and "unhex" in plan


def test_explained_ids_read_the_facts_once_for_own_and_missing(spark):
    from factloom.operators.graph import explain

    have = facts(spark, {"id": "f1"}, {"id": "f2", "line": 2}, {"id": "f2", "line": 2}, {"id": None, "line": 7})
    held = [("d1", "f1"), ("d1", "f2"), ("d2", "gone"), ("f1", "f2"), (None, "f1")]
    support = spark.createDataFrame(held, "derived_id string, fact_id string")
    support = support.withColumn("ord", F.struct(F.lit(1).alias("ext_ord"), F.lit("a.js").alias("file"), F.lit(1).cast("long").alias("line"), F.lit(0).alias("pos")))
    asked = spark.createDataFrame([(i,) for i in ("f1", "f1", "f2", "d1", "d2", "no", None)], "id string")
    got = explain(asked, have, support)
    assert sorted((str(r.id), r.kind, str(r.fact_id), r.line) for r in got.collect()) == sorted([
        ("f1", "fact", "f1", 1), ("f1", "derived", "f2", 2), ("f1", "derived", "f2", 2), ("f2", "fact", "f2", 2), ("f2", "fact", "f2", 2),
        ("d1", "derived", "f1", 1), ("d1", "derived", "f2", 2), ("d1", "derived", "f2", 2), ("d2", "not_found", "None", None), ("no", "not_found", "None", None), ("None", "not_found", "None", None),
    ])
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_excerpts_tell_the_line_of_their_fact(spark):
    from factloom.operators.graph import source_excerpt

    shown = source_excerpt(facts(spark, {"line": 3, "file": "a.js"}), lines(spark, {"a.js": "a\nb\nc\nd"}), radius=1)
    assert rows(shown, "fact_id", "at", "ln", "hit") == [("f0", 3, 2, False), ("f0", 3, 3, True), ("f0", 3, 4, False)]


def test_few_shared_keys_move_no_facts(spark):
    """A key of both sides whose counts differ is joined from a table of its own, which is known to be small."""
    made = [{"id": f"i{i}", "target": "a", "entity": "a", "line": i} for i in range(3)]
    changes = V.delta(facts(spark, *made, {"id": "g", "entity": "gone"}), facts(spark, made[0], {"id": "n", "entity": "new"}))
    assert rows(changes, "side", "id") == [("added", "n"), ("removed", "g"), ("removed", "i1"), ("removed", "i2")]
    assert "shared-" in str(changes.inputFiles())
