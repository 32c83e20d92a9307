"""Language, quality and toxicity models, main text, host reputation and nearest neighbours."""

import itertools
import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from brute import SCHEMA, odd_documents

from factloom.llm import language as L
from factloom.llm import nearest as K
from factloom.llm import quality as Q
from factloom.llm import toxicity as T
from factloom.llm.common import has_letter, held_out
from factloom.llm.html_text import extract_pages, main_text
from factloom.llm.queries import URL_RULES
from factloom.llm.url_reputation import filter_urls, host_reputation

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def numeric_gradients(model, loss, names, draw, tries=12, step=1e-2):
    for name in names:
        w = model.weights[name]
        for _ in range(tries):
            at = tuple(int(draw.integers(0, n)) for n in w.shape)
            old = float(w[at])
            w[at] = old + step
            high = loss()
            w[at] = old - step
            low = loss()
            w[at] = old
            yield name, at, (high - low) / (2 * step)


def test_gradients_through_time():
    draw = np.random.default_rng(0)
    net = L.Network(["a", "b", "c"])
    x, mask, labels = draw.integers(0, 4, (7, 5)).astype(np.uint8), np.ones((7, 5), np.float32), np.array([0, 1, 2, 1, 0])
    loss = lambda: -float(net.log_probabilities(net.states(x))[:, labels, np.arange(5)].mean())
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    found = net.gradients(x, mask, labels)
    for name, at, want in numeric_gradients(net, loss, ["v", "b", "u0", "u1", "w0", "w1"], draw):
        at = at if name not in ("w0", "w1") else (at[0], at[1] % 4)
        if name in ("w0", "w1"):
            continue
        assert found[name][at] == pytest.approx(want, abs=2e-3)


def test_gradients_of_the_attention():
    draw = np.random.default_rng(1)
    model = Q.Attention()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, owner, labels = draw.random((6, Q.FEATURES)), np.array([0, 0, 1, 1, 1, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        h, _, _, logit = model.encode(x)
        total = 0.0
        for k in range(3):
            mine = owner == k
            share = np.exp(logit[mine]) / np.exp(logit[mine]).sum()
            p = 1 / (1 + np.exp(-((share[:, None] * h[mine]).sum(axis=0) @ model.weights["c"][:-1] + model.weights["c"][-1])))
            total -= labels[k] * np.log(p) + (1 - labels[k]) * np.log(1 - p)
        return total / 3

    found = model.gradients(x, owner, labels)
    for name, at, want in numeric_gradients(model, loss, list(model.weights), draw, step=1e-4):
        assert found[name][at] == pytest.approx(want, abs=1e-4)


def split(labelled):
    out = labelled.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    return labelled[~out], labelled[out]


@needs_tables
def test_held_out_accuracy():
    documents = pd.read_parquet(f"{SF_DIR}/documents.parquet")
    learn, rest = split(documents)
    found, scores = L.classify(L.train(list(zip(learn.text, learn.lang))), rest.text.tolist())
    assert (np.array(found) == rest.lang.to_numpy()).mean() > 0.98 and ((scores >= 0) & (scores <= 1)).all()
    learn, rest = split(documents.merge(pd.read_parquet(f"{SF_DIR}/labels.parquet"), on="doc_id"))
    good = Q.score_texts(Q.train(list(zip(learn.text, learn.quality))), rest.text.tolist()) >= Q.THRESHOLD
    assert (good == (rest.quality == 1)).mean() > 0.93
    toxic = T.train(list(zip(learn.text, learn.toxic))).score(rest.text.tolist()) >= T.THRESHOLD
    assert (toxic == (rest.toxic == 1)).mean() > 0.9


def test_models_on_odd_rows(spark):
    documents = spark.createDataFrame(odd_documents(), SCHEMA)
    rows = documents.collect()
    network = L.train([("the cat is on the mat and", "en"), ("der hund ist in dem haus und", "de")] * 20)
    found = L.identify(documents, network).collect()
    assert len(found) == len(rows) and found[0].key == "k"
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "de")) if letters else (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in L.identify(documents, None).collect()} == {"und"}
    model = Q.train([("good text here, and more. " * k, 1) for k in range(1, 30)] + [("BAD!! " * k, 0) for k in range(1, 30)])
    quality = Q.score_quality(documents, model).collect()
    assert len(quality) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in quality)
    assert {r.score for r in Q.score_quality(documents, Q.train([])).collect()} == {0.5}
    toxic = T.score_toxicity(documents, T.train([])).collect()
    assert len(toxic) == len(rows) and {(r.score, r.predicted) for r in toxic} == {(0.5, 1)}
    none = spark.createDataFrame([], SCHEMA)
    assert L.identify(none, network).count() == Q.score_quality(none, model).count() == T.score_toxicity(none, T.train([])).count() == 0
    assert L.learn(none) is None
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert isinstance(Q.learn(documents, labels), (Q.Attention, type(None))) and isinstance(T.learn(documents, labels), T.Model)
    ids = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids)


def test_quality_learns_from_whole_texts():
    same = "Plain words stand here, one after another. "
    texts = [(same * (900 + k) + "BAD!! $$ #77 " * (4000 if bad else 0), 1 - bad) for k in range(30) for bad in (0, 1)]
    assert all(len(t) > 512 * 64 for t, _ in texts)
    scores = Q.score_texts(Q.train(texts), [t for t, _ in texts])
    assert all((s > 0.8) if label else (s < 0.2) for s, (_, label) in zip(scores, texts))


def test_letters():
    assert [has_letter(t) for t in (None, "", "12 ²½ Ⅷ _-!", "x", "1é", "語", "²a")] == [False, False, False, True, True, True, True]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_find_what_distances_say():
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    terms = sorted({letters(draw.randint(3, 12)) for _ in range(40)})
    lexicon = T.Lexicon(dict.fromkeys(terms, 1.0))
    words = [letters(draw.randint(2, 13)) for _ in range(400)] + [t[:4] + letters(1) + t[5:] for t in terms] + [t[1:] for t in terms]
    for word in words:
        close = [(distance(word, t), t) for t in terms]
        close = [(d, t) for d, t in close if d <= T.max_distance(t)]
        want = (word, 0) if word in terms else (min(close)[1], min(close)[0]) if close else None
        assert lexicon.match(word) == want


def test_stems_and_context():
    lexicon = T.Lexicon({"horrible": 3.0, "grumpf*": 2.0})
    assert lexicon.match("grumpfelig") == ("grumpf*", 0) and lexicon.match("horrrible") == ("horrible", 1) and lexicon.match("table") is None
    plain = T.context_features(lexicon, "you are horrible")
    quoted = T.context_features(lexicon, 'the word "horrible" is old')
    assert plain[0] > 0 and plain[4] > 0 and plain[6] == 3.0 and quoted[3] > 0 and quoted[0] == quoted[6] == 0
    marks = T.learn_lexicon([("nasty you nasty", 1)] * 12 + [("kind words only", 0)] * 60)
    assert "nasty" in marks.weights or "nast*" in marks.weights or "nas*" in marks.weights
    assert "kind" not in marks.weights


def test_misspelled_inflected_and_short_terms():
    rows = [(f"{word} tag{i}", 1) for word in ("dummer", "dummes", "scum", "idiotisch", "idiotin") for i in range(30)]
    lexicon = T.learn_lexicon(rows + [(f"kind words only {i}", 0) for i in range(400)])
    assert {"dum*", "dummer", "dummes", "idiotisch", "scum"} <= set(lexicon.weights)
    for word, want in [("dunmer", "dummer"), ("dunmes", "dummes"), ("scun", "scum"), ("ediotisch", "idiotisch"), ("idjotin", "idiotin")]:
        assert lexicon.match(word) == (want, 1)
        assert T.context_features(lexicon, f"such a {word} here")[5] > 0
    assert lexicon.match("dummy") == ("dum*", 0) and lexicon.match("words") is None
    stem = T.Lexicon({"grumpf*": 2.0, "abc*": 1.0})
    for word in ("grumpfelig", "grunpfelig", "gumpfelig", "grumpelig", "xgrumpfelig", "grmfelig", "abd", "abcd", "gr"):
        close = min((distance_to_start(word, t[:-1]), t) for t in stem.weights)
        assert stem.match(word) == (close[::-1] if close[0] <= T.max_distance(close[1]) else None)


def distance_to_start(word, stem):
    return min(distance(word[:n], stem) for n in range(len(word) + 1))


PAGES = [
    ("<html><body><nav><a href='/'>Home</a><a>News</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>\n three.<br>four</p><p>Five&nbsp;six&#33;</p></article><footer>f</footer></body></html>", "T & U\nOne two three. four\nFive six!"),
    ("<body><div class='menu'><a>x</a></div><div id=main><p>Long enough text of the article, a first part.</p><p>And a second part, as long as that.</p></div><div class='sidebar'>side</div><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul>", "Long enough text of the article, a first part.\nAnd a second part, as long as that."),
    ("<article><p>a<p>b<div class='comments'><p>reader</p></div><form><input>send</form><script>x</script><style>y</style><!-- c --><p>c</article>", "a\nb\nc"),
    ("<p>only", "only"), ("plain text", "plain text"), ("", ""), (None, ""), ("<script>if (a < b) {}</script>", ""), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_main_text(spark):
    for page, want in PAGES:
        assert main_text(page) == want
    rows = [(i, f"u{i}", p, "t") for i, (p, _) in enumerate(PAGES)] + [(None, None, "<p>x", "t"), (0, "u0", PAGES[0][0], "t")]
    got = sorted((r.page_id is not None, r.page_id, r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    want = sorted([(True, i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(False, None, "x", 1), (True, 0, PAGES[0][1], len(PAGES[0][1]))])
    assert got == want
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_of_the_article_stay():
    text = "<h1>Title</h1><p>Long enough text of the article, a first part.</p><p>And a second part, as long as that.</p>"
    want = "Title\nLong enough text of the article, a first part.\nAnd a second part, as long as that."
    side = "<div class='sidebar'>side</div><div class='site-footer'>foot</div><div id='comments-area'>reader</div>"
    for names in ("class='content has-sidebar'", "id='page' class='no-sidebar'", "class='post with-comments'", "class='page-header-fixed'", "class='layout-sidebar'", "id=widget"):
        for wrapped in (text, f"<article>{text}</article>", f"<div class='entry'>{text}</div>"):
            assert main_text(f"<body><div {names}>{wrapped}{side}</div></body>") == want
            assert main_text(f"<body><main><div {names}>{wrapped}</div></main>{side}</body>") == want
    readers = "<div class='post-comments'>" + "<p>Readers write far more than the article has, and again.</p>" * 9 + "</div>"
    related = "<div class='related'>" + "<article><p>Another article that is praised here at length.</p></article>" * 9 + "</div>"
    for more in (readers, related, readers.replace("<p>", "<article><p>").replace("</p>", "</p></article>")):
        assert main_text(f"<body><div class='has-sidebar'><article>{text}</article></div>{more}</body>") == want
    assert main_text(f"<body><div class='post with-comments'>{text}</div>{readers}</body>") == want
    sources = "<ul><li><a>one source</a></li><li><a>two source</a></li><li><a>three source</a></li></ul>"
    assert main_text(f"<body><article>{text}{sources}</article></body>") == want + "\none source\ntwo source\nthree source"
    assert main_text(f"<body><div class='post'>{text}</div>{sources}</body>") == want
    deep = "<div class='sidebar'>" * 3000 + "deep" + "</div>" * 3000
    assert main_text(f"<body>{deep}</body>") == "deep"


def test_urls(spark):
    urls = ["http://A.Example.COM/en/71?x", "http://example.com/en/8", "https://b.net/de/1#a", "https://x.example.net/de/81", "http://q.org/es/", "no scheme", None, "x://", "http://notexample.com/en/7", "http://com/en/", "http://q.org?u=/es/", "a://b://c/d"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(0, urls[0], "h", "r"), (None, urls[1], "h", "r")]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(table, URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2] == ("b.net", "/de/1", "net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None) and got[8][2] == "com/en/" and got[9][:3] == ("com", "/en/", "com/en/")
    assert got[10][:3] == ("q.org", "", None) and got[11][:2] == ("b:", "//c/d") and got[None][3] == "block"
    assert filter_urls(table, URL_RULES).count() == len(rows) and filter_urls(table.limit(0), URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.a.com", 1)] * 40 + [("ok.b.com", 0)] * 40 + [("new.a.com", None), ("new.b.com", None), ("one.b.com", 1), (None, None)]
    found = {r.host: r for r in host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert found["bad.a.com"].share > 0.9 > 0.5 > found["ok.b.com"].share
    assert found["new.a.com"].share > found["new.b.com"].share and found["one.b.com"].share < 1
    assert all(r.lower <= r.share for r in found.values()) and found[""].n == 0


def test_nearest_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    draw = np.random.default_rng(2)
    vectors = {i: draw.normal(draw.normal(0, 1, 8) if i % 7 else 0, 0.6, 8).tolist() for i in range(600)}
    for i in range(300, 420):
        vectors[i] = vectors[300]
    odd = {1000: None, 1050: [0.0] * 8, 1100: [float("nan")] * 8, 1150: [None] * 8, 1200: [1.0, 2.0], 1250: [float("inf")] + [1.0] * 7, None: [1.0] * 8}
    rows = [(i, v, 1, 5) for i, v in {**vectors, **odd}.items()] + [(5, vectors[5], 1, 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, id int")
    from pyspark.sql import functions as F

    got = {}
    for r in K.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    hits = total = 0
    assert set(got) == {i for i in vectors if i % 50 == 0}
    for q, found in got.items():
        want = sorted((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q)[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and q not in {v for v, _ in found.values()}
        assert all(s == pytest.approx(float(unit[q] @ unit[v]), abs=1e-12) for v, s in found.values())
        order = [(-round(s, 12), v) for _, (v, s) in sorted(found.items())]
        assert order == sorted(order)
        hits += len({i for _, i in want} & {v for v, _ in found.values()})
        total += 5
    assert hits / total >= 0.9
    few = K.search(table.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]
    assert K.search(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_best_bins_come_first():
    draw = np.random.default_rng(3)
    points = draw.normal(0, 1, (3000, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = K.Tree(points)
    for p in points[:20]:
        walk = tree.leaves(p, tree.n_leaves)
        assert sorted(walk) == list(range(tree.n_leaves)) and walk[0] == tree.assign(p[None])[0]
    near = points[:100] @ points.T
    places = [tree.assign(points[np.argsort(-line)[1:6]]) for line in near]
    visits = [K.calibrate(tree, points[:100], places, r, r) for r in (0.5, 0.9, 0.99)]
    assert list(itertools.accumulate(visits, max)) == visits and visits[-1] <= tree.n_leaves
    met = [set(tree.leaves(p, visits[1])) for p in points[:100]]
    assert np.mean([len(set(own) - m) == 0 for own, m in zip(places, met)]) >= 0.9
    rows = np.zeros(tree.n_leaves, dtype=int)
    last = tree.leaves(points[0], tree.n_leaves)[-1]
    rows[last] = 6
    assert tree.leaves(points[0], 1, rows, 6)[-1] == last and K.calibrate(tree, points[:1], [np.zeros(0, int)]) == 1
    assert K.Tree(np.ones((500, 3)) / 3**0.5).n_leaves == 1


def test_learning_without_labels_and_with_repeated_ids(spark):
    from factloom.llm.common import labelled_sample

    documents = spark.createDataFrame([(i % 4, f"text {i} of an id") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(4)], "doc_id long, toxic int, quality int")
    assert labelled_sample(documents, labels, "toxic", 10).count() == 10
    assert labelled_sample(documents, labels.limit(0), "toxic", 10).count() == 0
    model = T.learn(documents, labels.limit(0))
    assert {(round(r.score, 9), r.predicted) for r in T.score_toxicity(documents, model).collect()} == {(0.5, 1)}
    assert {r.score for r in Q.score_quality(documents, Q.learn(documents, labels.limit(0))).collect()} == {0.5}
