"""The rule packs, one per kind of source. Patterns describe the fixed formats they read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.operators.rules import Pack, Rule, group

BLANK = r"\A\s*\z"

# Order of extractors in a scan.
ORDER = {
    "code": 10, "routes": 11, "shell": 20, "config": 30, "markdown": 40, "lua": 50, "notebook": 60,
    "python": 70, "latex": 80, "lean": 90, "r": 100, "next": 110, "vue": 120, "html": 130,
}

# Words of the shell that are no commands, and the package managers.
SHELL_WORDS = (
    "if", "then", "else", "elif", "fi", "for", "while", "do", "done", "case", "esac", "function",
    "return", "exit", "echo", "export", "local", "readonly", "set", "unset", "shift", "trap",
)
PACKAGE_MANAGERS = (
    "apt", "apt-get", "yum", "dnf", "brew", "npm", "pip", "pip3", "pacman", "yarn", "pnpm", "cargo", "gem",
)
# LaTeX environments that are kept.
MATH_ENVIRONMENTS = (
    "theorem", "lemma", "definition", "proof", "proposition", "corollary", "remark", "example",
    "conjecture", "axiom", "claim", "notation", "algorithm", "equation", "align", "gather",
)
# What a Lean keyword declares.
LEAN_KINDS = {
    "theorem": "theorem", "lemma": "lemma", "def": "definition", "abbrev": "definition",
    "class": "class", "structure": "structure", "instance": "instance",
}
# Route methods and receivers.
ROUTE_METHODS = "get|post|put|delete|patch|use|all"
ROUTE_RECEIVERS = "app|router"


def _comma_items(g, number: int, cut: str | None = None) -> Column:
    items = F.transform(F.split(g(number), ","), strip)
    if cut:
        items = F.transform(items, lambda x: strip(F.element_at(F.split(x, cut), 1)))
    return F.filter(items, lambda x: x != "")


SHELL = Pack(
    "shell", ORDER["shell"],
    slots=((
        Rule("shell_function_def", r"\A\s*function\s+([a-zA-Z_][a-zA-Z0-9_-]*)\s*\{?", {"name": group(1)}),
        Rule("shell_function_def", r"\A\s*(?:function\s+)?([a-zA-Z_][a-zA-Z0-9_-]*)\s*\(\)\s*\{?", {"name": group(1)}),
        Rule("shell_source", r"\A\s*(?:source|\.)\s+[\"']?([^\s\"']+)[\"']?", {"target": group(1)}),
        Rule(
            "shell_command", r"\A\s*([a-zA-Z_][a-zA-Z0-9_./-]*)", {"name": group(1)},
            when=lambda g, line: ~line.rlike(r"\A\s*[a-zA-Z_][a-zA-Z0-9_]*=") & ~g(1).isin(*SHELL_WORDS),
            type_of=lambda g: F.when(g(1).isin(*PACKAGE_MANAGERS), "shell_package_manager_call").otherwise("shell_command"),
            confidence=lambda g: F.when(g(1).isin(*PACKAGE_MANAGERS), "high").otherwise("low"),
        ),
    ),),
    skip=rf"\A\s*#|{BLANK}",
)

MARKDOWN = Pack(
    "markdown", ORDER["markdown"],
    slots=(
        (Rule("doc_heading", r"\A(#{1,6})\s+(.+)\z", {"name": lambda g: strip(g(2))},
              extra={"level": lambda g: F.length(g(1))}),),
        (Rule("doc_link", r"\[([^\]]+)\]\(([^)]+)\)", {"name": group(1), "target": group(2)}, groups=2, each=True),),
        (Rule(
            "doc_instruction",
            r"(?i)(?<![A-Za-z0-9_])(must|should|never|always|do not|don't|required|only ever)(?![A-Za-z0-9_])",
            {}, confidence="medium",
        ),),
    ),
)
FENCE = r"\A```(\w*)\s*\z"

LUA = Pack(
    "lua", ORDER["lua"],
    slots=(
        (
            Rule("lua_function_def", r"\A\s*(?:local\s+)?function\s+([a-zA-Z_][a-zA-Z0-9_.:]*)\s*\(", {"name": group(1)}),
            Rule("lua_function_def", r"\A\s*(?:local\s+)?([a-zA-Z_][a-zA-Z0-9_.:]*)\s*=\s*function\s*\(", {"name": group(1)}),
        ),
        (Rule("lua_require", r"require\s*\(?\s*[\"']([^\"']+)[\"']\s*\)?", {"target": group(1)}),),
    ),
    skip=rf"\A\s*--|{BLANK}",
)

PYTHON = Pack(
    "python", ORDER["python"],
    slots=((
        Rule("python_import", r"\Aimport\s+([\w.,\s]+)", many=lambda g: _comma_items(g, 1, r"\s+as\s+"),
             many_fields=("name", "target")),
        Rule("python_import", r"\Afrom\s+([\w.]+)\s+import\s+", {"name": group(1), "target": group(1)}),
        Rule("python_function", r"\A(\s*)def\s+(\w+)\s*\(",
             {"name": group(2), "kind": lambda g: F.when(F.length(g(1)) > 0, "method").otherwise("function")}),
        Rule("python_class", r"\Aclass\s+(\w+)", {"name": group(1)}),
        Rule("python_decorator", r"\A@([\w.]+)", {"name": group(1)}, confidence="medium"),
    ),),
    skip=rf"\A\s*#|{BLANK}",
)

LATEX = Pack(
    "latex", ORDER["latex"], needs=("\\",),
    slots=(
        (Rule("latex_environment", r"\\begin\{(\w+)\}", {"name": lambda g: F.lower(g(1))},
              when=lambda g, line: F.lower(g(1)).isin(*MATH_ENVIRONMENTS)),),
        (Rule("latex_label", r"\\label\{([^}]+)\}", {"name": group(1)}),),
        (Rule("latex_citation", r"\\cite(?:\w*)?(?:\[.*?\])?\{([^}]+)\}", each=True,
              many=lambda g: _comma_items(g, 1), many_fields=("name", "target")),),
        (Rule("latex_section", r"\\(subsubsection|subsection|section)\*?\{([^}]+)\}",
              {"name": lambda g: strip(g(2)), "kind": group(1)}),),
        (Rule("latex_include", r"\\(?:input|include)\{([^}]+)\}", {"name": group(1), "target": group(1)}),),
        (Rule("latex_package", r"\\usepackage(?:\[.*?\])?\{([^}]+)\}",
              many=lambda g: _comma_items(g, 1), many_fields=("name", "target")),),
    ),
    skip=rf"\A\s*%|{BLANK}",
)
BIBTEX = Pack(
    "bibtex", ORDER["latex"],
    slots=((Rule("bib_entry", r"\A@(\w+)\s*\{\s*([^,]+)", {"name": lambda g: strip(g(2))},
                 extra={"entryType": lambda g: F.lower(g(1))}),),),
    skip=rf"\A\s*%|{BLANK}",
)


def _lean_kind(g) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in LEAN_KINDS.items() for x in pair])
    return kinds[g(1)]


LEAN = Pack(
    "lean", ORDER["lean"],
    slots=((
        Rule("lean_import", r"\Aimport\s+([\w.]+)", {"name": group(1), "target": group(1)}),
        Rule("lean_declaration",
             r"\A(?:private\s+|protected\s+)?(?:noncomputable\s+)?(theorem|lemma|def|abbrev|class|structure|instance)\s+(\w+)",
             {"name": group(2), "kind": _lean_kind}),
        Rule("lean_namespace", r"\Anamespace\s+(\w+)", {"name": group(1)}),
        Rule("lean_command", r"\A#(check|eval|print|reduce|norm_num)(?!\w)", {"name": group(1)}, confidence="medium"),
    ),),
    skip=rf"\A\s*--|{BLANK}",
)

R_LANG = Pack(
    "r", ORDER["r"],
    slots=((
        Rule("r_library", r"(?:\A|\s)(?:library|require)\s*\(\s*[\"']?([\w.]+)[\"']?\s*\)",
             {"name": group(1), "target": group(1)}),
        Rule("r_function", r"\A(\w+)\s*<-\s*function\s*\(", {"name": group(1)}),
        Rule("r_assignment", r"\A(\w+)\s*<-\s*(?!function\s*\()(.+)", {"name": group(1)}, confidence="medium"),
    ),),
    skip=rf"\A\s*#|{BLANK}",
)
R_CHUNK_OPEN = r"(?i)\A```\{r"
R_CHUNK_CLOSE = r"\A```\s*\z"
R_CHUNK_NAME = r"(?i)```\{r\s*,?\s*([^,}\s]+)"

# JavaScript / TypeScript. A line loses its // tail and inline block comments before matching.
JS_IMPORT = r"\A\s*(?:import\s+(?:[^'\"();]*?\s*from\s*)?|\}\s*from\s*)[\"']([^\"']+)[\"']"
JS_REQUIRE = r"(?<![\w$.])require\s*\(\s*[\"']([^\"']+)[\"']\s*[),]"
JS_HOOK = r"(?<![\w$.])(use[A-Z][\w$]*)\s*\("
JS_CALL = r"(?<![\w$.#@])(?<!function\s)(?<!function\s\*\s)(?<!new\s)([A-Za-z_$][\w$]*)\s*\("
# Words followed by a bracket that are no calls.
JS_NO_CALL = (
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "import", "super", "await",
    "new", "delete", "void", "in", "of", "do", "else", "case", "yield", "throw", "instanceof", "with",
    "require", "async",
)
CODE_IMPORTS = Pack(
    "imports", ORDER["code"],
    needs=("import", "require", "from"),
    slots=(
        (Rule("import", JS_IMPORT, {"target": group(1)}, confidence="path"),),
        (Rule("import", JS_REQUIRE, {"target": group(1)}, each=True, confidence="path"),),
    ),
    skip=r"\A\s*(//|/?\*)",
)
CODE_IMPORTS_AND_OPENERS = Pack(
    "imports", ORDER["code"],
    slots=(*CODE_IMPORTS.slots, (Rule("_opener", r"\A\s*(?:import|export)\b[^'\"]*\{[^}]*\z"),)),
    skip=CODE_IMPORTS.skip, needs=("import", "require", "from", "export"),
)
CODE_HOOKS = Pack(
    "hooks", ORDER["code"], needs=("use",),
    slots=((Rule("hook_usage", JS_HOOK, {"name": group(1)}, each=True, confidence="path"),),),
    skip=r"\A\s*(//|/?\*)",
)
CODE_CALLS = Pack(
    "calls", ORDER["code"], needs=("(",),
    slots=((Rule(
        "function_call", JS_CALL, {"callee": group(1)}, each=True, confidence="path",
        when=lambda g, line: ~g(1).isin(*JS_NO_CALL) & ~g(1).rlike(r"\Ause[A-Z]"),
    ),),),
    skip=r"\A\s*(//|/?\*)",
)
ROUTES = Pack(
    "routes", ORDER["routes"], needs=("app", "router"),
    slots=((Rule(
        "express_route",
        rf"(?<![\w$.])({ROUTE_RECEIVERS})\s*\.\s*({ROUTE_METHODS})\s*\(\s*(?:\"([^\"]*)\"|'([^']*)'|`([^`$]*)`)\s*,\s*(?:[^)\s]|\z)",
        {"method": lambda g: F.upper(g(2)),
         "route_path": lambda g: F.concat(g(3), g(4), g(5))},
        extra={"receiver": group(1)}, groups=5, each=True, confidence="path",
        when=lambda g, line: (g(2) != "use") | F.concat(g(3), g(4), g(5)).startswith("/"),
    ),),),
    skip=r"\A\s*(//|/?\*)",
)

HTML = Pack(
    "html", ORDER["html"], needs=("<",),
    slots=(
        (Rule("doc_link", r"(?i)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)", {"target": group(1), "name": lambda g: strip(g(2))},
              groups=2, each=True),),
        (Rule("doc_heading", r"(?i)<h([1-6])[^>]*>([^<]*)", {"name": lambda g: strip(g(2))}, extra={"level": group(1)},
              groups=2, each=True),),
    ),
)
