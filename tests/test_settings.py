"""Keys of YAML and TOML texts."""

import pytest
from hypothesis import given, settings, strategies as st

from factloom.operators.settings import key_line, setting_keys

YAML = '''# c
name: demo   # x
on: push
run: |
  foo: bar
  baz:
   - 1

jobs: {build: 1, test: [1, 2], "q k": {z: 1}}
steps:
- uses: a
  with: {x: 1}
- run: |
    key: not
nested:
  a: 1
  b:
    deep: x
  c: >-
    text: more
  d: [1,
    2]
  "e f": 'multi
    line: x'
  g: plain text
    goes on
  h:
  i: 2024-01-02
  url: http://x/y#z
base: &b
  p: 1
other:
  <<: *b
  q: true
empty:
last: "a: b" # c
'''
KEYS = {
    'name': 'string',
    'on': 'string',
    'run': 'string',
    'jobs': 'object',
    'jobs.build': 'number',
    'jobs.test': 'array',
    'jobs.q k': 'object',
    'steps': 'array',
    'nested': 'object',
    'nested.a': 'number',
    'nested.b': 'object',
    'nested.c': 'string',
    'nested.d': 'array',
    'nested.e f': 'string',
    'nested.g': 'string',
    'nested.h': 'object',
    'nested.i': 'object',
    'nested.url': 'string',
    'base': 'object',
    'base.p': 'number',
    'other': 'object',
    'other.p': 'number',
    'other.q': 'boolean',
    'empty': 'object',
    'last': 'string',
}


def test_yaml():
    assert {name: kind for name, _, kind in setting_keys("a.yaml", YAML)} == KEYS


@pytest.mark.parametrize("text", [
    "a: b: c\n", "a:\n\tb: 1\n", "a: [1, 2\n", "a: 1\na: 2\n", "x\ny: 1\n", "a: 1\n---\nb: 2\n", 'a: "x\n', "- a\n- b\n", "", "a: *none\n",
    "a: {b: 1} c\n", "a: [1,\n2]\n  b: 1\n",
])
def test_texts_that_do_not_parse_give_nothing(text):
    assert setting_keys("a.yml", text.replace("\\\n", "\n")) == []


def test_brackets_over_lines():
    assert setting_keys("a.yaml", "{a: 1, b: {c: 2}}") == [("a", "a", "number"), ("b", "b", "object"), ("b.c", "c", "number")]
    long = "a: [" + ",\n  ".join(str(k) for k in range(50_000)) + "]\nb: true\n"
    assert setting_keys("a.yaml", long) == [("a", "a", "array"), ("b", "b", "boolean")]
    assert setting_keys("a.yaml", "a: " + "[" * 100_000) == []


def test_toml():
    text = "title = \"\"\"\nkey = 1\n[not.table]\n\"\"\"\nz = 1\n[server]\nport = 80\nwhen = 2024-01-02\n[server.sub]\nx = true\n[[items]]\nn = 1\n"
    assert setting_keys("a.toml", text) == [
        ("title", "title", "string"), ("z", "z", "number"), ("server", "server", "object"), ("server.port", "port", "number"),
        ("server.when", "when", "object"), ("server.sub", "sub", "object"), ("items", "items", "array")]
    assert setting_keys("a.toml", "a = \n") == []
    assert (key_line(text.split("\n"), "server"), key_line(text.split("\n"), "sub"), key_line([], "x")) == (6, 9, None)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab:-[]{}#'\"|>&*! \n\t,", max_size=60))
def test_any_text_ends(text):
    setting_keys("a.yaml", text)
