"""Calls and the functions around them, by brackets, over runs of any length."""

import random

from helpers import files, lines, rows

from factloom.operators import extract, scopes
from factloom.operators.scopes import Frame, Stack

TEXT = """function outer(a = seed()) {
  one(a);
  function inner() { in1(); }
  two(a);
  const f = (x) => g1(x);
  const h = async x => {
    h1("}", '{', /[{(]/, `)`);
  };
  items.forEach((i) => { each(i); });
  items.map(i => mapper(i), other(i));
  if (check(a)) { three(a); }
  const slow =
    later(1);
}
  margin();
class A extends B {
  constructor() { init(); }
  run(x) {
    go(x);
    const k = function named() { deep(); };
  }
  handle = () => { prop(); };
  static async load() { fetchIt(); }
  #secret() { hidden(); }
}
const obj = {
  m() { inM(); },
  key: () => inKey(),
  k2: function () { inK2(); },
};
export default function Foo() { return bar(); }
const q = async ({ a, b }) =>
  soon(a)
    .then(b);
done();
const wide = (
  a,
  b
) => {
  inWide();
};
"""
CALLERS = {
    "seed": "outer", "one": "outer", "in1": "inner", "two": "outer", "g1": "f", "h1": "h", "each": None, "mapper": None, "other": "outer",
    "check": "outer", "three": "outer", "later": "outer", "margin": None, "init": "A.constructor", "go": "A.run", "deep": "k", "prop": None,
    "fetchIt": "A.load", "hidden": None, "inM": "m", "inKey": "key", "inK2": "k2", "bar": "Foo", "soon": "q", "done": None, "inWide": "wide",
}


def test_callers(spark):
    found = extract.extract_calls(extract.code_lines(files(spark, {"a.js": TEXT})))
    assert {r.callee: r.caller for r in found.collect()} == CALLERS
    at = {r.callee: r.line for r in found.collect()}
    assert (at["inWide"], at["later"], at["bar"]) == (40, 13, 31)


def test_runs_of_a_file_know_their_start(spark, monkeypatch):
    monkeypatch.setattr(scopes, "RUN_WIDTH", 3)
    found = extract.extract_calls(extract.code_lines(files(spark, {"a.js": TEXT, "b.js": "lone();\n"})))
    assert {r.callee: r.caller for r in found.collect()} == CALLERS | {"lone": None}


def test_effects_of_pieces_add_up():
    draw = random.Random(1)
    some = ["function f() {", "g(", "(a) => {", "x => h(x)", "}", ")", "];", "class K {", "m() {", "a(1), b(2);", "const z = y =>", ".then(c)", "w = [", "{"]
    for _ in range(300):
        text = [draw.choice(some) for _ in range(draw.randint(2, 25))]
        whole, cut = Stack(), sorted(draw.sample(range(1, len(text)), min(2, len(text) - 1)))
        now = Stack()
        for piece in (text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])):
            alone, before = Stack(), Stack(now.frames)
            calls = [before.read(x) for x in piece]
            assert calls == [whole.read(x) for x in piece]
            for x in piece:
                alone.read(x)
            now.follow("".join(alone.closed), alone.frames)
            assert now.frames == before.frames == whole.frames


def test_lines_without_a_file(spark):
    ls = lines(spark, {"a.js": "function a() {\n  function b() {\n    x();\n  }\n  y();\n}\n z();\n"})
    assert rows(extract.extract_calls(ls), "callee", "caller") == [("x", "b"), ("y", "a"), ("z", None)]
    assert extract.extract_calls(lines(spark, {"a.js": ""})).count() == 0
    assert Frame("{") == ("{", "", None)
