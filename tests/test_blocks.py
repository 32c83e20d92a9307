"""Skew-safe building blocks against brute force."""

import random

from helpers import rows
from pyspark.sql import functions as F

from factloom.functions import matching, runs, text


def _table(spark, seed=7):
    rnd = random.Random(seed)
    data = [(rnd.choice("ab"), i, rnd.randint(0, 1), rnd.choice([None, f"v{i}"])) for i in rnd.sample(range(400), 150)]
    return data, spark.createDataFrame(data, "k string, p long, x long, v string")


def test_running_sum_and_last_seen(spark):
    data, df = _table(spark)
    want_sum, want_last = set(), set()
    for k in "ab":
        total, last = 0, None
        for _, p, x, v in sorted(r for r in data if r[0] == k):
            total += x
            last = v or last
            want_sum.add((k, p, total))
            want_last.add((k, p, last))
    assert set(rows(runs.running_sum(df, ["k"], "p", F.col("x"), "s", width=16), "k", "p", "s")) == want_sum
    assert set(rows(runs.last_seen(df, ["k"], "p", {"l": F.col("v")}, width=16), "k", "p", "l")) == want_last


def test_numbering_and_tops(spark):
    data, df = _table(spark)
    ranks = {}
    for k in "ab":
        for i, r in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[2], r[1]))):
            ranks[(k, r[1])] = i + 1
    got = runs.number_rows(df, ["k"], [F.col("x"), F.floor(F.col("p") / 32)], [F.col("p")], "n")
    assert {(r["k"], r["p"]): r["n"] for r in got.collect()} == ranks
    asked = df.withColumn("asked", F.when(F.col("k") == "a", 7))
    top = runs.top_per_asked(asked, ["k"], [F.col("x"), F.col("p")], 3, "asked", [F.col("x")], "n")
    assert {(r["k"], r["p"]) for r in top.collect()} == {kp for kp, n in ranks.items() if n <= (7 if kp[0] == "a" else 3)}
    assert rows(runs.first_per(df, ["k"], ["x", "p"]), "k", "p") == sorted(kp for kp, n in ranks.items() if n == 1)


def test_contains_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc/.") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    terms = sorted({"".join(rnd.choice("abc/.") for _ in range(rnd.randint(1, 7))) for _ in range(60)})
    t = spark.createDataFrame(list(enumerate(texts)), "i int, haystack string")
    q = spark.createDataFrame([(x,) for x in terms], "term string")
    got = [tuple(r) for r in matching.contains_join(t, q, short_terms=True).select("i", "term").collect()]
    assert sorted(got) == sorted((i, x) for i, s in enumerate(texts) for x in terms if x in s)


def test_word_join_is_whole_word_and_literal(spark):
    t = spark.createDataFrame([(1, "call legacyFn(x)"), (2, "legacyFnX"), (3, 'a "legacy.fn"'), (4, "legacyxfn"), (5, "++ -- ++")], "i int, line string")
    q = spark.createDataFrame([("legacyFn",), ("legacy.fn",), ("--",)], "needle string")
    assert rows(matching.word_join(t, q), "i", "needle") == [(1, "legacyFn"), (3, "legacy.fn"), (5, "--")]


def test_plain_steps_up_need_no_loop_over_a_path(spark):
    cases = [
        ("a/b/c.js", "../d.js", "a/d.js"), ("a/b/c.js", "./../../d/e.js", "d/e.js"), ("a/c.js", "./d.js", "a/d.js"), ("c.js", "./..x/d", "..x/d"),
        ("a/c.js", "../../d.js", None), ("a//b/c.js", "../d.js", None), ("a/c.js", "../d//e", None), ("a/c.js", "../", None), ("a/c.js", "././d", None), ("a/../c.js", "./d", None), ("a/c.js", None, None),
    ]
    df = spark.createDataFrame(cases, "f string, t string, want string")
    got = df.select("t", text._stepped_up(text.dir_name(F.col("f")), F.col("t")).alias("got"), text.resolve_target(F.col("f"), F.col("t"), F.lit("doc_reference")).alias("all")).collect()
    assert [r["got"] for r in got] == [c[2] for c in cases]
    assert [r["all"] for r in got[4:]] == ["../d.js", "a/d.js", "d/e", "./", "a/d", "d", "a"]


def test_paths(spark):
    cases = [
        ("a/b.js", "./c", "a/c"), ("a/b.js", "../c.js", "c.js"), ("b.js", "./c//d/./e", "c/d/e"), ("b.js", "../up", "../up"), ("a/b.md", "/abs/x", "/abs/x"),
        ("a/b.js", "lib", "lib"), ("x/y/z.js", "../../q.json", "q.json"), ("a.js", "./", "./"),
    ]
    df = spark.createDataFrame(cases, "f string, t string, want string")
    got = df.select("f", "t", "want", text.resolve_target(F.col("f"), F.col("t"), F.lit("file_dependency")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    marks = spark.createDataFrame([(p,) for p in ("test/a.js", "a/tests/b.js", "x.test.ts", "__fixtures__/a", "src/testing.js", "spec/x")], "p string")
    got = {r["p"]: (r["c"], r["t"]) for r in marks.select("p", text.path_confidence(F.col("p")).alias("c"), text.is_test_file(F.col("p")).alias("t")).collect()}
    assert got == {"test/a.js": ("low", True), "a/tests/b.js": ("low", True), "x.test.ts": ("low", True), "__fixtures__/a": ("low", False),
                   "src/testing.js": ("high", False), "spec/x": ("low", False)}
    assert marks.limit(1).select(text.estimate_tokens(F.lit("12345")).alias("a"), text.estimate_tokens(F.lit(None).cast("string")).alias("b")).first() == (2, 0)
