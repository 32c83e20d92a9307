"""Security findings: secrets, shell execution, CI permissions, look-alike dependencies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.runs import first_per, top_per
from factloom.functions.text import EVIDENCE_CHARS, base_name, content_id, evidence, path_confidence, strip
from factloom.operators.extract import clean_code
from factloom.operators.rules import any_of

FINDING = ("id", "repo", "category", "rule", "severity", "file", "line", "evidence", "confidence", "ext_ord")


def _finding(df: DataFrame, prefix: str, **values: Column) -> DataFrame:
    rows = df.select(
        "repo", "file", *[values[n].cast({"line": "long", "ext_ord": "int"}.get(n, "string")).alias(n) for n in
                          ("category", "rule", "severity", "line", "evidence", "confidence", "ext_ord")]
    )
    ident = content_id(prefix, F.col("repo"), F.col("category"), F.col("rule"), F.col("file"), F.col("line"))
    return rows.withColumn("id", ident).select(*FINDING)


@dataclass(frozen=True)
class SecretRule:
    rule: str
    pattern: str  # group 1 = what comes before the secret, group 2 = the secret
    severity: str = "high"


# Credential formats, as their issuers document them.
SECRET_RULES = (
    SecretRule("AWS Access Key ID", r"()(?<![A-Z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Z0-9])"),
    SecretRule("AWS Secret Access Key", r"(?i)(aws_?secret_?(?:access_?)?key\s*[\"']?\s*[:=]\s*[\"']?)([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])"),
    SecretRule("GitHub Token", r"()(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,})"),
    SecretRule("Private Key", r"()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", "critical"),
    SecretRule("Slack Token", r"()(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})"),
    SecretRule("Google API Key", r"()(?<![A-Za-z0-9_-])(AIza[A-Za-z0-9_-]{35})"),
    SecretRule("Stripe Secret Key", r"()(?<![A-Za-z0-9_])(sk_live_[A-Za-z0-9]{16,})"),
    SecretRule("Generic Token Assignment", r"(?i)((?:token|secret|api_?key|passw(?:or)?d)\s*[\"']?\s*[:=]\s*[\"'])([A-Za-z0-9_\-/+=.]{16,})(?=[\"'])"),
)


# One of these occurs in every line that a built-in rule matches (compared in lower case).
SECRET_HINTS = (
    "akia", "asia", "aws", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "private key", "xox", "aiza", "sk_live_",
    "token", "secret", "api_key", "apikey", "passwd", "password",
)


def secret_findings(lines: DataFrame, rules: Sequence[SecretRule] = SECRET_RULES) -> DataFrame:
    """Lines holding a credential; the evidence has every known credential masked out.

    One narrow pass: a byte search for hints first, then each rule that matches gives one row.
    """
    line = F.col("line")
    if rules is SECRET_RULES:
        lines = lines.filter(any_of(F.lower(line), SECRET_HINTS))
    masked = line
    for rule in rules:
        masked = F.regexp_replace(masked, rule.pattern, "$1[REDACTED]")
    hits = F.filter(
        F.array(*[
            F.when(line.rlike(r.pattern), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity")))
            for r in rules
        ]),
        lambda h: h.isNotNull(),
    )
    found = lines.select("repo", "file", "ln", "line", F.explode(hits).alias("h"))
    return _finding(
        found, "secret", category=F.lit("secret_exposure"), rule=F.col("h.rule"), severity=F.col("h.severity"),
        line=F.col("ln"), evidence=evidence(masked), confidence=path_confidence(F.col("file")), ext_ord=F.lit(12),
    )


_CHILD_PROCESS = r"[\"'](?:node:)?child_process[\"']"
_EXEC_CALL = r"(?<![\w$])(execSync|execFile|exec|spawn)\s*\(\s*([^\s)].*)\z"


def shell_exec_line(code: Column) -> Column:
    """Lines that :func:`shell_exec_findings` looks at: imports of the module, and calls."""
    call = any_of(code, ("exec", "spawn")) & code.rlike(_EXEC_CALL)
    return F.contains(code, F.lit("child_process")) | call


def shell_exec_findings(lines: DataFrame) -> DataFrame:
    """Shell execution graded by how the command is built and whether a shell runs it.

    exec and execSync always run one, spawn and execFile only with ``shell: true``. Static commands
    give nothing, nor do plain variables where no shell runs. Only files importing child_process.
    """
    lines = clean_code(lines)
    line = F.col("code")
    importers = (
        lines.filter(line.rlike(_CHILD_PROCESS) & line.rlike(r"(?<![\w$])(require\s*\(|import\b|from\s)"))
        .select("repo", "file").distinct()
    )
    calls = lines.filter(line.rlike(_EXEC_CALL) & ~line.rlike(r"\A\s*(//|/?\*)|\A\s*(?:async\s+)?function\s")).select(
        "repo", "file", "ln", "line",
        F.regexp_extract(line, _EXEC_CALL, 1).alias("callee"),
        F.regexp_extract(line, _EXEC_CALL, 2).alias("rest"),
    ).join(importers, ["repo", "file"], "left_semi")
    rest = F.col("rest")
    template = r"\A`((?:[^`\\]|\\.)*)`"
    text = r"\A(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')"
    after_text = strip(F.regexp_replace(rest, text, ""))
    both_static = after_text.rlike(r"\A\+\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')\s*([,)]|\z)")
    expression = F.regexp_extract(rest, r"\A((?:[^,()\"'`]|\([^()]*\)|\"[^\"]*\"|'[^']*'|`[^`]*`)*)", 1)
    built = (
        F.when(rest.rlike(template), F.when(
            F.contains(F.regexp_extract(rest, template, 1), F.lit("${")) | strip(F.regexp_replace(rest, template, "")).startswith("+"),
            "interpolated").otherwise("static"))
        .when(rest.startswith("`"), F.when(F.contains(rest, F.lit("${")), "interpolated").otherwise("static"))
        .when(rest.rlike(text), F.when(after_text.startswith("+"), F.when(both_static, "static").otherwise("interpolated")).otherwise("static"))
        .when(F.contains(expression, F.lit("+")), "interpolated")
        .otherwise("identifier")
    )
    shell = F.col("callee").isin("exec", "execSync") | rest.rlike(r"(?<![\w$])shell\s*:\s*true(?![\w$])")
    graded = calls.withColumn("built", built).withColumn("shell", shell).withColumn(
        "severity",
        F.when(F.col("built") == "static", F.lit(None))
        .when(F.col("shell") & (F.col("built") == "interpolated"), "high")
        .when(F.col("shell"), "medium")
        .when(F.col("built") == "interpolated", "low"),
    ).filter(F.col("severity").isNotNull())
    wording = (
        F.when(F.col("severity") == "high", "dynamically-constructed command")
        .when(F.col("severity") == "medium", "variable command (unverified source)")
        .otherwise("dynamically-constructed command (no shell invoked)")
    )
    return _finding(
        graded, "shellexec", category=F.lit("dangerous_shell_exec"),
        rule=F.concat(F.col("callee"), F.lit("() called with "), wording), severity=F.col("severity"), line=F.col("ln"),
        evidence=evidence(F.col("line")), confidence=F.when(F.col("severity") == "high", "medium").otherwise("low"),
        ext_ord=F.lit(11),
    )


# CI rules with their severities.
_WRITE_ALL = r"(?i)permissions:\s*write-all"
# The block below ``permissions:`` ends with the first line that is not indented deeper.
_CONTENTS_WRITE = (
    r"(?im)(?:^([ \t]*)permissions:[ \t]*(?:#[^\n]*)?\r?\n(?:[ \t]*\r?\n|\1[ \t]++(?!contents:\s*write)[^\n]*\n)*+\1[ \t]+contents:\s*write"
    r"|permissions:[ \t]*\{[^}]*?contents:\s*write)"
)
_PR_TARGET = r"(?m)^\s*pull_request_target\s*:"
_HEAD_REF = r"(?i)ref:\s*\$\{\{\s*github\.event\.pull_request\.head\.(sha|ref)[^\n]*"
# The lines of the same step: up to the next item of the list.
_HEAD_CHECKOUT = r"(?i)uses:\s*actions/checkout@[^\n]*\n(?:(?![ \t]*-[ \t])[^\n]*\n)*?(?![ \t]*-[ \t])[^\n]*ref:\s*\$\{\{\s*github\.event\.pull_request\.head"
WORKFLOW_RULES = (
    ("Workflow grants write-all permissions", _WRITE_ALL, "high"),
    ("Workflow grants broad contents:write permission", _CONTENTS_WRITE, "medium"),
    ("pull_request_target used (runs with base-repo secrets on fork PRs)", _PR_TARGET, "high"),
    ("Workflow checks out PR head ref while triggered by pull_request_target", None, "critical"),
)


def workflow_findings(files: DataFrame) -> DataFrame:
    """Risky permissions and triggers of CI workflows."""
    content = F.col("content")
    flows = files.filter(F.concat(F.lit("/"), F.col("file")).rlike(r"\.github/workflows/[^/]+\.ya?ml\z") & content.isNotNull())

    def at(pattern: str) -> Column:
        before = F.substring(content, F.lit(1), F.regexp_instr(content, F.lit(pattern)) - 1)
        return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1

    rows = []
    for rule, pattern, severity in WORKFLOW_RULES:
        if pattern is None:
            hit = content.rlike(_PR_TARGET) & (content.rlike(_HEAD_REF) | content.rlike(_HEAD_CHECKOUT))
            ln = F.when(content.rlike(_HEAD_REF), at(_HEAD_REF)).otherwise(1)
        else:
            hit, ln = content.rlike(pattern), at(pattern)
        rows.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), ln.alias("ln"))))
    found = flows.select("repo", "file", "content", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("h"))
    text = strip(F.try_element_at(F.split("content", "\n", -1), F.col("h.ln").cast("int")))
    cut = F.when(F.length(text) > EVIDENCE_CHARS, F.concat(F.substring(text, 1, EVIDENCE_CHARS), F.lit("..."))).otherwise(text)
    return _finding(
        found, "workflow", category=F.lit("ci_permission_risk"), rule=F.col("h.rule"), severity=F.col("h.severity"),
        line=F.col("h.ln"), evidence=cut, confidence=F.lit("medium"), ext_ord=F.lit(31),
    )


# Popular packages in the order they are tried.
KNOWN_PACKAGES = (
    "react", "express", "lodash", "axios", "chalk", "commander", "webpack", "eslint", "typescript", "jest",
    "babel", "vue", "next", "redux", "moment", "request", "async", "underscore",
)


def resembles(name: Column, known: Sequence[str] = KNOWN_PACKAGES, skip_known: bool = False) -> Column:
    """First known package at edit distance one or two, null where there is none.

    A fixed list is compared inside the row, so no join and no pairs. ``skip_known`` spares names
    that are themselves on the list.
    """
    chain = F.when(name.isin(*known), F.lit(None)) if skip_known else F.when(F.lit(False), F.lit(None).cast("string"))
    for package in known:
        if len(package) >= 4:
            # Lengths more than two apart cannot be within distance two; the threshold stops early.
            near = F.length(name).between(len(package) - 2, len(package) + 2)
            chain = chain.when(near & (name != package) & (F.levenshtein(name, F.lit(package), 2) >= 0), package)
    return chain


def dependency_findings(files: DataFrame, known: Sequence[str] = KNOWN_PACKAGES, skip_known: bool = False) -> DataFrame:
    """Manifest dependencies whose name closely resembles a popular package."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    empty = F.create_map().cast("map<string,string>")
    names = F.array_union(
        F.map_keys(F.coalesce("m.dependencies", empty)), F.map_keys(F.coalesce("m.devDependencies", empty))
    )
    manifests = files.filter(base_name(F.col("file")) == "package.json").select(
        "repo", "file", "content", F.from_json("content", schema).alias("m")
    )
    deps = manifests.select("repo", "file", "content", F.explode(names).alias("dep"))
    hits = deps.withColumn("like", resembles(F.col("dep"), known, skip_known)).filter(F.col("like").isNotNull())
    at = F.instr("content", F.concat(F.lit('"'), F.col("dep"), F.lit('"')))
    before = F.substring(F.col("content"), F.lit(1), at - 1)
    ln = F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(1)
    hits = hits.withColumn("ln", ln)
    return _finding(
        hits, "depcheck", category=F.lit("dependency_risk"),
        rule=F.concat(F.lit('Dependency name "'), F.col("dep"), F.lit('" closely resembles popular package "'), F.col("like"), F.lit('"')),
        severity=F.lit("medium"), line=F.col("ln"),
        evidence=strip(F.try_element_at(F.split("content", "\n", -1), F.col("ln").cast("int"))), confidence=F.lit("low"), ext_ord=F.lit(140),
    )


def dedup_findings(findings: DataFrame) -> DataFrame:
    """First finding per (category, rule, file, line) of a repo, in extractor order."""
    return first_per(findings, ["repo", "category", "rule", "file", "line"], ["ext_ord", "id"]).select(*findings.columns)


def filter_findings(findings: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    out = findings
    if severity:
        out = out.filter(F.col("severity") == severity)
    if category:
        out = out.filter(F.col("category") == category)
    return out


# Severities from worst to least.
SEVERITIES = ("critical", "high", "medium", "low")


def severity_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and in total, one row per repo, over all findings."""
    return findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total")
    )


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by category and severity with subtotals (null = all)."""
    return findings.rollup("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def worst_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k worst critical or high findings of each repo."""
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return top_per(
        findings.filter(F.col("severity").isin("critical", "high")), ["repo"], [rank, F.col("ext_ord"), F.col("file"), F.col("line"), F.col("rule")], k, "rank"
    )
