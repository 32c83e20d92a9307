"""URL filtering by empirical-Bayes reputation of hosts. DataFrame functions only.

Page outcomes that a rule labels (block or allow) are counted per host, registered domain (the last
two labels of a host) and suffix (the last label). The share of blocked pages is shrunk through
beta-binomial priors from the top down: all pages -> suffix -> domain -> host. The strength of each
prior is the method-of-moments estimate over the groups of its level. A page without a rule is
blocked where the lower posterior bound of its host's share reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1000
Z = 1.6448536269514722
THRESHOLD = 0.5
MIN_STRENGTH, MAX_STRENGTH = 0.5, 10_000.0


class Rule(NamedTuple):
    """``host`` without a leading dot, ``path`` with its leading slash, ``verdict`` block or allow."""

    host: str
    path: str
    verdict: str


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits; ties go to the later string; else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into one expression")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean share and prior strength over groups of ``(bad, n)``: four sums reach the driver."""
    share = F.col("bad") / F.col("n")
    row = groups.filter("n > 0").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(share * F.col("bad")).alias("spread"),
    ).first()
    if not row.n:
        return 0.5, MIN_STRENGTH
    mean = (row.bad + 1) / (row.n + 2)
    within = mean * (1 - mean)
    between = row.spread - 2 * mean * row.bad + mean * mean * row.n - within * (row.groups - 1)
    size = row.n - row.squares / row.n - (row.groups - 1)
    ratio = between / (within * size) if size > 0 else 0.0
    return mean, min(max(1 / ratio - 1, MIN_STRENGTH), MAX_STRENGTH) if ratio > 0 else MAX_STRENGTH


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, share, lower`` from ``outcomes(host, bad)``: one row per host.

    ``bad`` is 1 (blocked), 0 (allowed) or null (unlabelled). ``share`` is the posterior mean of a
    host's blocked share, ``lower`` its lower bound. Null hosts count as the empty host.
    """
    domain = F.substring_index("host", ".", -2)
    suffix = F.substring_index("host", ".", -1)
    host = F.coalesce("host", F.lit("")).alias("host")
    hosts = outcomes.select(host, F.col("bad").cast("long").alias("bad")).groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    mean, k = _strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("bad") + F.lit(k * mean)) / (F.col("n") + F.lit(k))).alias("_suffix_share"))
    _, k = _strength(domains)
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + F.lit(k) * F.col("_suffix_share")) / (F.col("n") + F.lit(k))).alias("_domain_share"))
    _, k = _strength(hosts)
    share = (F.col("bad") + F.lit(k) * F.col("_domain_share")) / (F.col("n") + F.lit(k))
    judged = hosts.join(domains, "domain").select("host", "n", "bad", share.alias("share"), (F.col("n") + F.lit(k)).alias("_weight"))
    deviation = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("_weight") + 1))
    return judged.select("host", "n", "bad", "share", (F.col("share") - F.lit(Z) * deviation).alias("lower"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, share`` per row of ``pages(page_id, url)``.

    A url without ``://`` or null has an empty host and path; such pages share the empty host, which
    has no outcomes and so stays at the overall share. Repeated rows are judged and counted once
    each; an empty table gives no rows; other columns of ``pages`` are not read. The host table is
    joined by host; a host with a large share of all pages is split by adaptive skew joins.
    """
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rows = rows.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    outcomes = rows.select("host", F.when(F.col("_fit.verdict") == "block", 1).when(F.col("_fit.verdict") == "allow", 0).alias("bad"))
    known = host_reputation(outcomes).select("host", "share", "lower")
    by_host = F.when(F.col("lower") >= threshold, "block").otherwise("allow")
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), by_host).alias("verdict"), "share",
    )
