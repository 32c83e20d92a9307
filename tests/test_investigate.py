"""Questions and answers."""

import math
import re

from helpers import rows
from pyspark.sql import functions as F

from factloom.operators import budget, grounding, investigate, synthesis
from factloom.operators.intent import parse_intent
from factloom.plans.answer import answer
from factloom.session import cut_lineage

FACT = "id string, repo string, type string, file string, line long, name string, target string, callee string, caller string, method string, route_path string, entity string, evidence string, confidence string, ext_ord int, pos int"
FIELDS = [c.strip().split(" ")[0] for c in FACT.split(",")]


def facts(spark, *items):
    base = {**dict.fromkeys(FIELDS), "repo": "r", "type": "import", "line": 1, "confidence": "high", "ext_ord": 1, "pos": 0}
    return spark.createDataFrame([tuple({**base, "id": f"f{i}", "line": i + 1, **item}[c] for c in FIELDS) for i, item in enumerate(items)], FACT)


def ask(spark, *texts):
    return spark.createDataFrame([(f"o{i}", "r", t) for i, t in enumerate(texts)], "objective_id string, repo string, text string")


def test_intents(spark):
    got = {r["text"]: r for r in parse_intent(ask(
        spark, "why does routing fail", "top five insights", "give me exactly 2 insights", "what depends on auth.js? max 3 evidence, under 50 words", "Find the riskiest module; no file enumeration", "the _db-layer_",
    )).collect()}
    shown = lambda t: (got[t]["task_type"], got[t]["entities"], got[t]["exact_count"])
    assert shown("why does routing fail") == ("bug-investigation", ["routing"], None)
    assert shown("top five insights") == ("architecture-overview", [], 5)
    assert shown("give me exactly 2 insights") == ("architecture-overview", [], 2)
    deep = got["what depends on auth.js? max 3 evidence, under 50 words"]
    assert (deep["task_type"], deep["max_evidence"], deep["max_words"]) == ("dependency-trace", 3, 50)
    assert got["Find the riskiest module; no file enumeration"]["no_file_enumeration"] and got["the _db-layer_"]["entities"] == ["db-layer"]


def test_word_forms(spark):
    df = spark.createDataFrame([("routing",), ("tests",), ("bus",), ("doing",), ("linking",)], "keyword string")
    got = {r["keyword"]: r["v"] for r in df.select("keyword", investigate.variants(F.col("keyword")).alias("v")).collect()}
    assert got == {"routing": ["routing", "route", "router"], "tests": ["tests", "test"], "bus": ["bus"], "doing": ["doing"], "linking": ["linking", "linke", "linker"]}


def test_pairs_of_questions_and_facts_are_distinct_without_a_shuffle(spark, monkeypatch):
    """A fact and a question that share several forms meet once; frequent forms are dealt over tasks; repeated rows stay."""
    monkeypatch.setattr(investigate, "FORM_HITS", 2)
    names = ["alpha beta", "beta gamma", "alpha", "gamma testing", "omega", "betas"]
    items = [{"id": f"f{i % 7}" if i < 9 else None, "file": f"{'tests' if i % 7 % 3 == 0 else 'src'}/{i % 7}.js", "line": i % 7, "name": names[i % 7 % 6]} for i in range(10)]
    words = [("o0", "r", "alpha"), ("o0", "r", "beta"), ("o1", "r", "betas"), ("o1", "r", "gamma"), ("o2", "r", "testing"), ("o3", "r", "nothing"), ("o4", "s", "alpha")]
    keywords = spark.createDataFrame(words, "objective_id string, repo string, keyword string")
    fs = cut_lineage(facts(spark, *items), "facts")
    raw, tiered = investigate.retrieve_raw(keywords, fs), investigate.retrieve_tiered(keywords, fs)
    forms = {"o0": ["alpha", "beta"], "o1": ["betas", "beta", "gamma"], "o2": ["testing", "teste", "tester"]}
    want = sorted((o, i["id"], i["file"]) for o, f in forms.items() for i in items if i["id"] and any(w in f"{i['file']} {i['name']}" for w in f))
    assert rows(raw, "objective_id", "id", "file") == want
    code = {o for o, _, file in want if file.startswith("src") and o != "o2"}
    assert rows(tiered, "objective_id", "id", "file") == [w for w in want if w[0] not in code or w[2].startswith("src")]
    for found in (raw, tiered):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Aggregate \[objective_id#\d+, id#", plan)


def test_unknown_terms_and_wide_retrieval_read_no_pairs_twice(spark):
    """Both give what the pairs give, repeated facts and facts without an id included, and shuffle no pairs."""
    items = [{"id": f"f{i % 5}" if i < 8 else None, "file": f"{'tests' if i % 5 == 0 else 'src'}/{'zeta' if i % 5 == 1 else i % 5}.js", "line": i % 5, "name": ["alpha", "beta", "gamma alpha", "Delta", "tests"][i % 5]} for i in range(10)]
    fs = cut_lineage(facts(spark, *items), "facts")
    t = investigate.answer_tables(ask(spark, "alpha nothing zeta", "beta alpha", "delta gamma", "testing alpha", "give a high level overview of everything", "src tests"), fs)
    plain = investigate.unknown_terms(t["keywords"], t["retrieved"])
    assert rows(t["unknowns"], "objective_id", "keyword") == rows(plain, "objective_id", "keyword") and plain.count()
    wide = investigate.widen_retrieval(t["keywords"], t["unknowns"], t["retrieved"], fs, t["overview"])
    want = investigate.widen_retrieval(t["keywords"], t["unknowns"], t["retrieved"], fs)
    key = F.coalesce("id", F.lit("none")).alias("key")
    assert rows(wide.select("objective_id", key, "file"), "objective_id", "key", "file") == rows(want.select("objective_id", key, "file"), "objective_id", "key", "file")
    assert "array_intersect" not in t["unknowns"]._jdf.queryExecution().optimizedPlan().toString()


def test_tiers_prefer_production_code(spark):
    fs = facts(spark, {"file": "lib/auth.js"}, {"file": "examples/auth-example.js"}, {"file": "billing.js"}, {"file": "test/auth.test.js"}, {"file": "docs/auth.md", "type": "doc_heading"})
    t = investigate.answer_tables(ask(spark, "how is auth done", "auth examples", "nothing matches zebra"), fs)
    assert rows(t["retrieved"].orderBy("file"), "objective_id", "file") == [
        ("o0", "lib/auth.js"), ("o1", "docs/auth.md"), ("o1", "examples/auth-example.js"), ("o1", "lib/auth.js"), ("o1", "test/auth.test.js")]
    wide = investigate.widen_retrieval(t["keywords"], t["unknowns"], t["retrieved"], fs).filter("objective_id = 'o0'")
    assert {r["file"] for r in wide.collect()} == {"lib/auth.js", "examples/auth-example.js", "test/auth.test.js", "docs/auth.md"}
    assert ("o2", "zebra") in rows(t["unknowns"], "objective_id", "keyword")
    modes = {r["objective_id"]: (r["mode"], r["uncertain"]) for r in t["triage"].collect()}
    assert modes["o2"] == ("deep", True)


def test_broad_keywords_are_dropped_unless_all_are(spark):
    fs = facts(spark, *[{"file": f"src/f{i}.js", "name": "common"} for i in range(30)], {"file": "src/rare.js"})
    words = lambda *ks: spark.createDataFrame([("o", "r", i, k) for i, k in enumerate(ks)], "objective_id string, repo string, pos int, keyword string")
    keep = lambda *ks: {r["keyword"] for r in investigate.discriminating_keywords(words(*ks), fs).collect()}
    assert keep("common", "rare") == {"rare"} and keep("common", "src") == {"common"} and keep("common") == {"common"}


def test_overview_and_its_insights(spark):
    fs = facts(
        spark, *[{"file": f"lib/core/m{i}.js", "target": "express", "evidence": 'require("express")'} for i in range(22)], {"file": "config/a.json", "type": "config_key", "name": "k"},
        {"file": "x.js", "type": "function_call"}, {"file": "docs/guide/a.md", "type": "doc_heading", "name": "T"}, {"file": "srv/http/r.js", "type": "express_route", "method": "GET", "route_path": "/h"},
    )
    a = answer(ask(spark, "top five insights"), fs)
    assert {r["file"].split("/")[0] for r in a.retrieved.collect()} == {"lib", "srv"}
    got = {r["insight"]: r for r in a.insights.collect()}
    assert got["srv/http"]["why_it_matters"] == "Serves GET /h."
    assert got["lib/core"]["why_it_matters"].startswith("Relies on the external package `express` (require(\"express\"))") and got["lib/core"]["n_hypotheses"] == 22
    assert a.citations.filter("rank = 1").count() == 5 and a.totals.first()["total_found"] == 2
    report = {r["section"]: r for r in a.budget.collect()}
    assert report["hypotheses"]["kept"] == 23 and report["total"]["tokens"] > 0


def test_scores_and_triage(spark):
    h = spark.createDataFrame([("o", "r", f"f{n}.js", n, d, (1, f"f{n}.js", 1, 0)) for n, d in ((1, 0), (25, 0), (24, 0), (5, 1))],
                              "objective_id string, repo string, file string, n_facts long, n_drifted long, first_seq struct<ext_ord:int,file:string,line:int,pos:int>")
    got = {r["n_facts"]: r for r in investigate.score_hypotheses(h).collect()}
    assert (got[25]["status"], got[24]["status"], got[5]["status"], got[5]["confidence"]) == ("confirmed", "supported", "eliminated", 0.0)
    assert math.isclose(got[1]["confidence"], 0.4)
    assert [r["n_facts"] for r in investigate.rank_hypotheses(investigate.score_hypotheses(h)).orderBy("rank").collect()] == [25, 24, 1, 5]

    def run(task, *confidences, unknown=0):
        rows_ = [("o", "r", f"f{i}.js", 1, c, (1, f"f{i}.js", 1, 0)) for i, c in enumerate(confidences)]
        s = spark.createDataFrame(rows_, "objective_id string, repo string, file string, n_facts long, confidence double, first_seq struct<ext_ord:int,file:string,line:int,pos:int>")
        intents = spark.createDataFrame([("o", task)], "objective_id string, task_type string")
        unk = spark.createDataFrame([("o", "k")] * unknown, "objective_id string, keyword string")
        return investigate.triage(intents, s, unk).first()["mode"]

    look = "entity-lookup"
    assert [run(look, .9), run(look, .4), run(look, .8, .75), run(look, .9, unknown=1), run("bug-investigation", .7), run("bug-investigation", .9)] == ["shallow", "deep", "deep", "deep", "deep", "shallow"]


def test_budget(spark):
    items = spark.createDataFrame([("o", "hypotheses", p, c) for p, c in ((1, 4), (2, 4), (3, 1))] + [("o", "facts", 1, 2)], "objective_id string, section string, pos long, cost long")
    base = spark.createDataFrame([("o", 1)], "objective_id string, used long")
    run = lambda n: {r["section"]: (r["tokens"], r["kept"], r["dropped"]) for r in budget.fit_budget(base, items, n)[1].collect()}
    roomy, tight = run(100), run(7)
    assert roomy["hypotheses"] == (9, 3, 0) and roomy["total"][0] == 12
    assert tight["hypotheses"] == (4, 1, 2) and tight["facts"] == (2, 1, 0) and run(0)["total"][0] == 1


def test_grounding(spark):
    evidence = spark.createDataFrame([("f1", "const  a =\n 1;"), ("f2", "x")], "fact_id string, evidence string")
    said = spark.createDataFrame(
        [("ok", "t", ["['f1', f2]"], "a = 1"), ("unknown", "t", ["f1;f9 f8"], None), ("quote", "t", ["f2"], "a = 1"), ("none", "t", [], None), ("empty", " ", ["f1"], None)],
        "statement_id string, text string, cites array<string>, quote string")
    assert dict(rows(grounding.ground_statements(said, evidence), "statement_id", "reason")) == {
        "ok": None, "unknown": "cites unknown evidence: f9, f8", "quote": "quote not found in cited evidence", "none": "no citation", "empty": "empty statement"}
    replies = spark.createDataFrame([(1, 'Sure!\n```json\n{"statements":[{"text":"a","cite":"f1, f2","quote":"q"},{"text":"b","ids":["f3"]}]}\n```'), (2, "no json"), (3, '{"x":1}')], "reply_id int, text string")
    assert rows(grounding.parse_statements(replies), "reply_id", "text", F.array_join("cites", "+"), "error") == [
        (1, "a", "f1, f2", None), (1, "b", "f3", None), (2, None, None, "no statements list"), (3, None, None, "no statements list")]


def test_labels_merge_areas(spark):
    h = spark.createDataFrame([("o", "r", f, n, 0, (1, f, 1, 0)) for f, n in (("docs/a/x.md", 1), ("docs/b/y.md", 9), ("manual/c/z.md", 2), ("lib/q.js", 3))],
                              "objective_id string, repo string, file string, n_facts long, n_drifted long, first_seq struct<ext_ord:int,file:string,line:int,pos:int>")
    scored = cut_lineage(investigate.score_hypotheses(h))
    got = {r["insight"]: (r["area"], r["n_hypotheses"]) for r in synthesis.label_areas(scored).collect()}
    assert got == {"Manuals": ("docs/b", 3), "lib/q.js": ("lib/q.js", 1)}


def test_memory_is_searched_once_for_each_keyword(spark, monkeypatch):
    texts = [(f"m{i}", "r" if i else "s", f"Use Redis cache {i}", "approved" if i != 2 else "proposed") for i in range(6)] * 2
    rules = spark.createDataFrame(texts, "id string, repo string, rule string, status string")
    words = spark.createDataFrame([(f"o{q}", "r", w) for q in range(40) for w in ("redis", "cache", f"{q}", "absent")], "objective_id string, repo string, keyword string")
    searched, join = [], investigate.contains_join
    monkeypatch.setattr(investigate, "contains_join", lambda t, terms, **k: searched.append(terms.count()) or join(t, terms, **k))
    monkeypatch.setattr(investigate, "FORM_HITS", 2)
    got = rows(investigate.relevant_memory(words, rules), "objective_id", "repo", "rule_id")
    assert searched == [43]
    assert got == sorted((f"o{q}", "r", f"m{i}") for q in range(40) for i in (1, 3, 4, 5))


def _asked(spark, large=None):
    """Random facts and word forms: repeated ids, nulls, files of one and of many facts."""
    import random

    rng = random.Random(7)
    said = []
    for i in range(300):
        file = None if i % 97 == 0 else "big.js" if large and i % 3 == 0 else f"d/f{rng.randrange(40)}.js"
        line = None if i % 53 == 0 else rng.randrange(50)
        said.append((f"f{i - i % 2 if i % 10 == 1 else i}", "r", file, 1, line, i % 7, rng.randrange(2), sorted(rng.sample(range(60), 1 + i % 4))))
    asks = [(f"q{k}", sorted(rng.sample(range(80), 1 + k % 5))) for k in range(50)] + [("none", [999])]
    facts = spark.createDataFrame(said, "id string, repo string, file string, ext_ord int, line long, pos int, _drifted int, _forms array<long>")
    return cut_lineage(facts, "said"), spark.createDataFrame(asks, "objective_id string, _forms array<long>")


def _in_pairs(said, asks):
    from pyspark.sql import functions as F

    pairs = asks.withColumnRenamed("_forms", "_asked").join(said, F.arrays_overlap("_asked", "_forms"))
    return pairs.groupBy("objective_id", "repo", "file").agg(
        F.count(F.lit(1)).alias("n_facts"), F.sum("_drifted").alias("n_drifted"), F.min(F.struct("ext_ord", "file", "line", "pos")).alias("first_seq")
    )


def test_questions_meet_files_without_pairs(spark, monkeypatch):
    from factloom.operators import meeting

    for large in (False, True):
        said, asks = _asked(spark, large)
        monkeypatch.setattr(meeting, "BLOCK", 64)
        monkeypatch.setattr(meeting, "UNFOLDED", 256)
        met = meeting.meet_files(said, asks)
        assert sorted(map(str, met.collect())) == sorted(map(str, _in_pairs(said, asks).select(met.columns).collect()))
    assert meeting.meet_files(said.limit(0), asks).collect() == []


def test_hypotheses_and_lookups_are_those_of_the_retrieval(spark):
    from factloom.operators import investigate
    from pyspark.sql import functions as F

    fs = cut_lineage(facts(spark, *[{"type": "import", "file": f"a/b{i % 3}.js", "line": i, "name": n, "target": n} for i, n in enumerate(["router", "parser", "rout", "x"] * 3)]), "facts")
    asked = spark.createDataFrame([("q1", "r", "why does router fail in parser"), ("q2", "r", "parsers routing"), ("q3", "r", "nothing here")], "objective_id string, repo string, text string")
    t = investigate.answer_tables(asked, fs)
    whole = investigate.score_hypotheses(investigate.form_hypotheses(t["retrieved"]))
    assert t["hypotheses"].count() and sorted(map(str, t["hypotheses"].collect())) == sorted(map(str, whole.select(t["hypotheses"].columns).collect()))
    # Hypotheses leave the meeting finished: the only rows grouped are those of overviews.
    assert "MapInArrow" in t["hypotheses"]._jdf.queryExecution().optimizedPlan().toString()
    some = whole.filter(F.col("file") != "a/b1.js")
    assert rows(t["retrieved_of"](some), "objective_id", "id") == rows(t["retrieved"].join(some, ["objective_id", "file"], "left_semi"), "objective_id", "id")


def test_few_terms_leave_texts_in_place(spark):
    from factloom.functions.matching import contains_join

    texts = spark.createDataFrame([(i, "a long text about routing") for i in range(3)], "n int, haystack string")
    found = contains_join(texts, spark.createDataFrame([("routing",), ("ab",), ("zz",)], "term string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found.select("n", "term")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert rows(found, "n", "term") == [(i, t) for i in range(3) for t in ("ab", "routing")]
