"""URL filters: longest-rule verdicts, and block decisions that spread over redirect and canonical-link equivalence.

A rule (host, path, action) fits its host and all subdomains of it, if the path starts with the rule's. The longest (host and
path together) wins; then the longer host, then allow. A url without a fitting rule takes its group's decision: groups are the
connected components over redirect and canonical edges; an explicit allow in the group comes before a block in it; else allow.

Scale: rules meet distinct (host, path) pairs by an equi-join on host suffixes, reduced to the best rule per pair before the
join back. Components are found by ``components``; urls without edges take no part.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and no edges, and is allowed;
repeated rows are judged alike; empty tables give empty ones; other columns, also clashing ones, are dropped.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node: fragment dropped, scheme and host lower-cased; null without ``://``."""
    at = F.position(F.lit("://"), url)
    scheme = F.lower(url.substr(F.lit(1), at - 1))
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(at > 0, F.concat(scheme, F.lit("://"), host_of(url), F.when(tail == "", "/").otherwise(tail)))


def resolve(base: Column, href: Column) -> Column:
    """An absolute, ``//host`` or ``/path`` reference as an absolute url; null for others, which name no host or root."""
    scheme = base.substr(F.lit(1), F.position(F.lit("://"), base) - 1)
    return F.when(href.contains("://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(scheme, F.lit("://"), host_of(base), href))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): from each page to its canonical link and to its refresh target, as nodes."""
    at = pages.select(F.col(f"`{url}`").alias("u"), F.col(f"`{html}`").alias("h")).filter("position('://', u) > 0")
    found = at.select("u", F.explode(F.array(*[F.regexp_extract("h", p, 1) for p in (CANONICAL, REFRESH)])).alias("href")).filter("href != ''")
    return found.select(node_of(F.col("u")).alias("a"), node_of(resolve(F.col("u"), F.col("href"))).alias("b")).filter("b IS NOT NULL AND a != b").distinct()


def best_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for the distinct ``pairs`` (host, path) that a rule (host, path, action) fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    open_ = pairs.filter("host != ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    fit = open_.join(r, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.when(F.col("action") == "allow", 1).otherwise(0))
    best = fit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank).alias("x"))
    return best.select("host", "path", "x.rule", "x.action")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, group), one row a page. ``edges`` (a, b) are nodes as ``node_of`` makes them."""
    p = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("_u")).withColumns({"host": host_of(F.col("_u")), "path": path_of(F.col("_u")), "node": node_of(F.col("_u"))}).drop("_u")
    ruled = best_rules(p.select("host", "path").distinct(), rules)
    groups = components(edges)
    known = groups.select("node", "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    actions = known.join(best_rules(known.select("host", "path").distinct(), rules), ["host", "path"])
    decided = actions.groupBy("root").agg(F.when(F.max(F.col("action") == "allow"), "allow").otherwise("block").alias("decision"))
    spread = groups.join(decided, "root", "left").select("node", F.col("root").alias("group"), "decision")
    out = p.join(ruled, ["host", "path"], "left").join(spread, "node", "left")
    return out.select(key, "host", "path", "rule", F.coalesce("action", "decision", F.lit("allow")).alias("verdict"), "group")
