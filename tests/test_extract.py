"""Extractors on small sources, each case with its expected facts."""

from helpers import files, lines, rows
from pyspark.sql import functions as F

from factloom.operators import extract, packs
from factloom.operators.facts import normalize_facts
from factloom.operators.rules import extract_lines

EXPRESS = {
    "server.js": 'const express = require("express");\nconst users = require("./routes/users");\n\nconst app = express();\n\n'
                 'app.get("/health", (req, res) => {\n  res.json({ ok: true });\n});\n\napp.use("/users", users);\napp.listen(3000);\n',
    "routes/users.js": 'const express = require("express");\nconst router = express.Router();\n'
                       'router.get("/", (req, res) => {\n  res.json([]);\n});\nrouter.post("/", (req, res) => {\n  res.json({});\n});\n'
                       'module.exports = router;\n',
    "components/UserCard.jsx": 'import React, { useState } from "react";\n\nexport function UserCard({ user }) {\n'
                               '  const [open, setOpen] = useState(false);\n  const again = useState(1);\n  return (\n    <div onClick={() => setOpen(!open)}>\n'
                               '      {user.name}\n    </div>\n  );\n}\n',
    "utils/generics.ts": 'export function Wrap(items: Array<Item>): Map<string, Item> {\n  return new Map<string, Item>();\n}\n',
}


def test_imports_and_routes(spark):
    ls = lines(spark, EXPRESS)
    facts = extract.extract_imports(ls)
    assert rows(facts, "file", "line", "target") == [
        ("components/UserCard.jsx", 1, "react"), ("routes/users.js", 1, "express"),
        ("server.js", 1, "express"), ("server.js", 2, "./routes/users"),
    ]
    assert rows(extract.extract_routes(ls), "file", "line", "method", "route_path") == [
        ("routes/users.js", 3, "GET", "/"), ("routes/users.js", 6, "POST", "/"),
        ("server.js", 6, "GET", "/health"), ("server.js", 10, "USE", "/users"),
    ]


def test_multi_line_imports_but_not_exports(spark):
    ls = lines(spark, {"a.js": 'import {\n  a,\n  b,\n} from "./b";\nexport {\n  c,\n} from "./c";\nimport "side";\n// import x from "no";\n'})
    assert rows(extract.extract_imports(ls), "line", "target") == [(4, "./b"), (8, "side")]


def test_settings_are_no_routes(spark):
    ls = lines(spark, {"a.js": "app.get('setting');\napp.use('x', f);\napp.get(`/t`, f);\nfoo.app.get('/n', f);\nrouter.all(\"/m\",\n"})
    assert rows(extract.extract_routes(ls), "line", "route_path") == [(3, "/t"), (5, "/m")]


def test_components_and_first_hook(spark):
    ls = lines(spark, {**EXPRESS, "c.jsx": "class Old extends React.Component {\n}\nconst Arrow = () => <p/>;\nfunction lower() { return <p/>; }\nfunction Far() {\n" + "\n" * 45 + "<b/>\n"})
    assert rows(extract.extract_components(ls), "file", "line", "name", "kind") == [
        ("c.jsx", 1, "Old", "class"), ("c.jsx", 3, "Arrow", "function"), ("components/UserCard.jsx", 3, "UserCard", "function"),
    ]
    assert rows(extract.extract_hooks(ls), "line", "name") == [(4, "useState")]


def test_a_tag_belongs_to_the_function_around_it(spark):
    text = "function Helper(a) {\n  return a;\n}\nfunction Real() {\n  const onClick = () => {\n    go();\n  };\n" + "  step();\n" * 90 + "  return (\n    <div/>\n  );\n}\nfunction last() {\n  return <p/>;\n}\n"
    assert rows(extract.extract_components(lines(spark, {"a.jsx": text})), "line", "name") == [(4, "Real")]


def test_comments_and_quotes(spark):
    text = (
        "/*\nimport g from 'ghost';\n gone(1);\n*/ import r from 'real';\nfoo(); // don't call bar()\nconst u = 'http://x/*y*/'; baz('// no');\n"
        "const t = `a // b\nimport not from 'text'`;\nqux(/* inner() */ 2); /* opens\n never(3);\n"
    )
    source = files(spark, {"a.js": text})
    found = extract.code_lines(source)
    assert rows(extract.extract_imports(found), "line", "target") == [(4, "real"), (8, "text")]
    assert rows(extract.extract_calls(found), "line", "callee") == [(5, "foo"), (6, "baz"), (9, "qux")]
    assert [r.line for r in found.orderBy("ln").collect()] == text.split("\n")
    assert rows(extract.extract_calls(lines(spark, {"a.js": "foo(); // don't call bar()\n"})), "callee") == [("foo",)]


def test_calls_know_their_caller(spark):
    ls = lines(spark, {"a.js": "function outer(a) {\n  inner(a);\n  const x = new Thing(1);\n}\nclass K {\n  run(a) {\n    if (a) { helper(a); }\n  }\n}\nconst f = (x) => {\n  g(x);\n};\ntop();\nobj.method(1);\n"})
    assert rows(extract.extract_calls(ls), "line", "caller", "callee") == [
        (2, "outer", "inner"), (7, "K.run", "helper"), (11, "f", "g"), (13, None, "top"),
    ]


def test_next_routes(spark):
    fs = files(spark, {p: "" for p in (
        "pages/index.js", "pages/blog/[id].tsx", "pages/docs/[...slug].js", "pages/opt/[[...all]].js", "pages/_app.js",
        "pages/api/users.js", "app/(shop)/cart/page.tsx", "app/api/x/route.ts", "app/layout.tsx", "pages/readme.md", "src/pages/no.js")})
    got = rows(extract.extract_next_routes(fs), "type", "route_path", "file")
    assert got == [
        ("next_api_route", "/api/users", "pages/api/users.js"), ("next_api_route", "/api/x", "app/api/x/route.ts"),
        ("next_page_route", "/", "pages/index.js"), ("next_page_route", "/blog/:id", "pages/blog/[id].tsx"),
        ("next_page_route", "/cart", "app/(shop)/cart/page.tsx"), ("next_page_route", "/docs/:slug*", "pages/docs/[...slug].js"),
        ("next_page_route", "/opt/:all*?", "pages/opt/[[...all]].js"),
    ]


def test_long_lists_keep_their_opener(spark):
    names = "".join(f"  n{i},\n" for i in range(9000))
    ls = lines(spark, {"a.js": "import {\n" + names + '} from "./b";\nexport {\n' + names + '} from "./c";\n'})
    assert rows(extract.extract_imports(ls), "target", "line") == [("./b", 9002)]


def test_vue_names_beside_deep_braces(spark):
    def page(depth, name):
        return "<script>\nexport default {\n  a: " + "{ b: " * depth + "{ name: 'no' }" + " }" * depth + f",\n  name: '{name}',\n}}\nconst c = {{ name: 'no' }}\n</script>\n"

    fs = files(spark, {"a.vue": page(2, "A"), "b.vue": page(8, "B"), "c.vue": page(60, "C"), "d.vue": page(60, "")})
    assert rows(extract.extract_vue(fs), "file", "name") == [("a.vue", "A"), ("b.vue", "B"), ("c.vue", "C"), ("d.vue", "d")]


def test_vue_names(spark):
    fs = files(spark, {
        "a/Card.vue": "<template>\n<p/>\n</template>\n<script>\nexport default {\n  data() { return {} },\n  name: 'MyCard',\n}\n</script>\n",
        "a/Plain.vue": "<template/>\n<script setup>\nconst name = 'x'\n</script>\n", "tests/T.vue": "<p/>",
    })
    assert rows(extract.extract_vue(fs), "file", "name", "line", "confidence") == [
        ("a/Card.vue", "MyCard", 5, "high"), ("a/Plain.vue", "Plain", 3, "high"), ("tests/T.vue", "T", 1, "low")]


def test_markdown(spark):
    ls = lines(spark, {"R.md": "# Title \nSee [a](./a.md) and [b](https://x/y).\n```js\n# not\n[no](no.md)\n```\nYou must do it\n```\nopen\n"})
    got = rows(extract.extract_markdown(ls), "type", "line", "name", "target")
    assert got == [
        ("doc_code_block", 3, None, None), ("doc_heading", 1, "Title", None), ("doc_instruction", 7, "You must do it", None),
        ("doc_link", 2, "a", "./a.md"), ("doc_link", 2, "b", "https://x/y"),
    ]


def test_shell(spark):
    ls = lines(spark, {"s.sh": "#!/bin/bash\nfunction go {\nstop() {\nsource ./lib.sh\n. env.sh\nX=1 ls\nnpm install\nls -l\necho hi\n"})
    assert rows(extract_lines(ls, packs.SHELL), "line", "type", "name", "target", "confidence") == [
        (2, "shell_function_def", "go", None, "high"), (3, "shell_function_def", "stop", None, "high"),
        (4, "shell_source", None, "./lib.sh", "high"), (5, "shell_source", None, "env.sh", "high"),
        (7, "shell_package_manager_call", "npm", None, "high"), (8, "shell_command", "ls", None, "low"),
    ]


def test_lua_python_lean(spark):
    assert rows(extract_lines(lines(spark, {"a.lua": "-- c\nlocal function f(a)\nM.g = function(x) return require('m.n') end\n"}), packs.LUA), "line", "name", "target") == [
        (2, "f", None), (3, None, "m.n"), (3, "M.g", None)]
    assert rows(extract_lines(lines(spark, {"a.py": "import os, numpy as np\nfrom a.b import c\ndef f(x):\n    def m(self):\nclass K:\n@deco.x\n# import no\n"}), packs.PYTHON), "line", "type", "name", "kind") == [
        (1, "python_import", "numpy", None), (1, "python_import", "os", None), (2, "python_import", "a.b", None),
        (3, "python_function", "f", "function"), (4, "python_function", "m", "method"), (5, "python_class", "K", None), (6, "python_decorator", "deco.x", None)]
    assert rows(extract_lines(lines(spark, {"a.lean": "import A.B\nprivate noncomputable def d (x)\nnamespace N\n#check d\n-- no\n"}), packs.LEAN), "line", "type", "name", "kind") == [
        (1, "lean_import", "A.B", None), (2, "lean_declaration", "d", "definition"), (3, "lean_namespace", "N", None), (4, "lean_command", "check", None)]


def test_latex_and_bib(spark):
    ls = lines(spark, {"a.tex": "\\begin{theorem}\\label{t:1} by \\cite{a, b} and \\citep[p.1]{c}\n% \\label{no}\n\\subsection*{Intro }\n\\usepackage[x]{p,q}\n\\input{ch1}\n\\begin{figure}\n"})
    assert rows(extract_lines(ls, packs.LATEX), "line", "type", "name", "kind") == [
        (1, "latex_citation", "a", None), (1, "latex_citation", "b", None), (1, "latex_citation", "c", None),
        (1, "latex_environment", "theorem", None), (1, "latex_label", "t:1", None), (3, "latex_section", "Intro", "subsection"),
        (4, "latex_package", "p", None), (4, "latex_package", "q", None), (5, "latex_include", "ch1", None)]
    assert rows(extract_lines(lines(spark, {"a.bib": "@Article{ key1 , title=x}\n"}), packs.BIBTEX).withColumn("e", F.col("extra")["entryType"]), "name", "e") == [("key1", "article")]


def test_r_and_rmd(spark):
    ls = lines(spark, {"a.R": "library(dplyr)\nf <- function(x) 1\nx <- 2\n# y <- 3\n",
                       "b.Rmd": "text x <- 1\n```{r setup, echo=F}\nlibrary('ggplot2')\n```\ny <- 2\n```{r}\nz <- 3\n"})
    assert rows(extract.extract_r(ls), "file", "line", "type", "name") == [
        ("a.R", 1, "r_library", "dplyr"), ("a.R", 2, "r_function", "f"), ("a.R", 3, "r_assignment", "x"),
        ("b.Rmd", 2, "rmd_chunk", "setup"), ("b.Rmd", 3, "r_library", "ggplot2"), ("b.Rmd", 6, "rmd_chunk", "chunk_2"), ("b.Rmd", 7, "r_assignment", "z")]


def test_config_keys(spark):
    fs = files(spark, {
        "a.json": '{\n  "name": "x",\n  "opts": {\n    "deep": [1],\n    "n": null\n  },\n  "on": true\n}', "bad.json": "{oops",
        "b.jsonc": '{\n  // note\n  "k": 1 /* c */\n}',
        "c.yaml": "version: 2\nservices:\n  web:\n    image: x\n  db: y\nlist:\n  - a: 1\n  - b\n",
        "p.toml": "[build-system]\nrequires = [\"x\"]\n[project]\nname = \"p\"\n[project.scripts]\nrun = \"a:b\"\n",
    })
    got = rows(extract.extract_config(fs).withColumn("vt", F.col("extra")["valueType"]), "file", "name", "line", "vt", "confidence")
    assert got == [
        ("a.json", "name", 2, "string", "high"), ("a.json", "on", 7, "boolean", "high"), ("a.json", "opts", 3, "object", "high"),
        ("a.json", "opts.deep", 4, "array", "high"), ("a.json", "opts.n", 5, "object", "high"), ("b.jsonc", "k", 3, "number", "high"),
        ("c.yaml", "list", 6, "array", "high"), ("c.yaml", "services", 2, "object", "high"), ("c.yaml", "services.db", 5, "string", "high"),
        ("c.yaml", "services.web", 3, "object", "high"), ("c.yaml", "version", 1, "number", "high"),
        ("p.toml", "build-system", 1, "object", "high"), ("p.toml", "build-system.requires", 2, "array", "high"),
        ("p.toml", "project", 3, "object", "high"), ("p.toml", "project.name", 4, "string", "high"), ("p.toml", "project.scripts", 5, "object", "high"),
    ]


def test_notebook(spark):
    nb = '{"cells":[{"cell_type":"markdown","source":["# T\\n","x"]},{"cell_type":"code","source":["import numpy as np, os\\n","np.load(1)"]},{"cell_type":"code","source":""},{"cell_type":"code","source":"def f(x):\\n  return x"}],"metadata":{"kernelspec":{"name":"python3","language":"python"}}}'
    got = rows(extract.extract_notebook(files(spark, {"n/a.ipynb": nb, "bad.ipynb": "{"})).withColumn("role", F.col("extra")["role"]), "type", "line", "name", "role")
    assert got == [
        ("notebook_cell", 4, "cell_2", "data_loading"), ("notebook_cell", 9, "cell_4", "function_definition"),
        ("notebook_import", 4, "numpy", None), ("notebook_import", 4, "os", None), ("notebook_structure", 1, "a", None)]


def test_normalized_facts_have_stable_ids(spark):
    ls = lines(spark, EXPRESS)
    one = normalize_facts(extract.extract_code(ls))
    two = normalize_facts(extract.extract_code(ls.repartition(3)))
    assert rows(one, "id") == rows(two, "id")
    assert one.select("id").distinct().count() == one.count()
    entity = {r["type"]: r["entity"] for r in one.filter("file = 'server.js'").collect()}
    assert entity["express_route"] in ("/health", "/users") and entity["import"] in ("express", "./routes/users")


def test_imports_shuffle_only_lines_with_lists(spark):
    """Lines that neither open nor close a list are read in one narrow pass, their text cleaned once."""
    rows = [("r", "a.js", 1, 'import a from "./a.js"; // one'), ("r", "a.js", 2, "export {"), ("r", "a.js", 9000, '} from "./b.js";'), ("r", "a.js", 9001, "import {"),
            ("r", "a.js", 20000, '} from "./c.js"; // two'), ("r", "b.js", None, 'const d = require("./d.js");'), ("r", "b.js", 3, None)]
    lines = spark.createDataFrame(rows, "repo string, file string, ln long, line string")
    found = extract.extract_imports(lines)
    assert sorted((r["file"], r["line"], r["target"]) for r in found.collect() if r["line"]) == [("a.js", 1, "./a.js"), ("a.js", 20000, "./c.js")]
    assert [r["target"] for r in found.collect() if r["line"] is None] == ["./d.js"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" in plan and "Generate explode(" not in plan[plan.rindex("Window ["):]
    narrow = extract_lines(extract.clean_code(lines), packs.CODE_IMPORTS, "code")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp_replace" in line for line in narrow.splitlines())
