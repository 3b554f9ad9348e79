"""op9: URL filters over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import urls as U

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return U.judge(pages, rules, U.page_edges(pages))


_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
_HOST = "coalesce(translate(regexp_extract({r}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_REST = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"


def _host(u: str) -> str:
    return _HOST.format(r="(" + _REST.format(u=u) + ")")


def _path(u: str) -> str:
    return "coalesce(regexp_extract((" + _REST.format(u=u) + "), '^[^/?#]*([^?#]*)', 1), '')"


def _node(u: str) -> str:
    tail = "regexp_extract((" + _REST.format(u=u) + "), '^[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN strpos({u}, '://') > 0 THEN lower(substr({u}, 1, strpos({u}, '://') - 1)) || '://' || {_host(u)} || CASE WHEN {tail} = '' THEN '/' ELSE {tail} END END"


ORACLE = rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_RULES}) AS t(rule_host, rule_path, action)),
links AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS href FROM pages WHERE strpos(url, '://') > 0),
full_links AS (SELECT url, CASE WHEN strpos(href, '://') > 0 THEN href WHEN starts_with(href, '//') THEN substr(url, 1, strpos(url, '://') - 1) || ':' || href
  WHEN starts_with(href, '/') THEN substr(url, 1, strpos(url, '://') - 1) || '://' || {_host("url")} || href END AS target FROM links WHERE href != ''),
one AS (SELECT DISTINCT {_node("url")} AS a, {_node("target")} AS b FROM full_links WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM one WHERE a != b UNION SELECT b, a FROM one WHERE a != b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT node, min(other) AS grp FROM reach GROUP BY node),
fit AS (SELECT n.node, r.rule_host || r.rule_path AS rule, action, row_number() OVER (PARTITION BY n.node ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, action) AS k
  FROM (SELECT node, {_host("node")} AS host, {_path("node")} AS path FROM (SELECT node FROM comp UNION SELECT {_node("url")} FROM pages WHERE strpos(url, '://') > 0)) n
  JOIN rules r ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)),
decided AS (SELECT grp, CASE WHEN max((action = 'allow')::INT) = 1 THEN 'allow' ELSE 'block' END AS decision FROM comp JOIN fit USING (node) WHERE k = 1 GROUP BY grp)
SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, rule, coalesce(action, decision, 'allow') AS verdict, comp.grp AS "group"
FROM pages LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON f.node = {_node("url")} LEFT JOIN comp ON comp.node = {_node("url")} LEFT JOIN decided USING (grp)
"""
