"""Code-map queries over the fixture trees, and the rows that they must give.

The supplied tables hold no Python source, so these read the trees of ``fixtures``, whole, whatever folder is passed. The expected
rows (``expected.json``) were made by the engine and then reviewed by hand, most closely ranking, calls, declared entries, runs and
rejections, so they guard against changes more than they prove the rules; they become SQL as VALUES.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import notes, probes, resolution
from graphloom.plans.codemap import CodeMap
from graphloom.plans.fixtures import FILES, REPLIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED = Path(__file__).with_name("expected.json")

_maps: dict[str, CodeMap] = {}


def fixture_map(spark: SparkSession) -> CodeMap:
    """The map of all fixtures, parsed once a session."""
    key = spark.sparkContext.applicationId
    if key not in _maps:
        _maps.clear()
        _maps[key] = CodeMap.from_files(spark, FILES)
    return _maps[key]


def _query(name: str):
    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(fixture_map(spark))
        return f

    return add


def _lists(*names: str) -> list:
    return [F.array_join(n, ",").alias(n) for n in names]


@_query("m01_modules")
def _(m):
    return m.parsed.select("tree", "path", "module", "module_ordinal", "is_package", "doc", "header_comment", "parse_error")


@_query("m02_functions")
def _(m):
    return m.functions.select("tree", "node_id", "cls", "lineno", "end_lineno", *_lists("args", "returns_keys", "decorators"), "returns", "doc", "is_async", "n_stmts", "n_branches", "n_loops", "n_ternaries", "n_strings", "loc")


@_query("m03_imports")
def _(m):
    return resolution.owned_imports(m.parsed)


@_query("m04_shapes")
def _(m):
    c = resolution.classes(m.parsed).select("tree", "module", "name", "kind", F.array_join("bases", ",").alias("bases"), F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["name"], x["shape"])), ",").alias("shape"), F.array_join("methods", ",").alias("methods"))
    return c.union(resolution.constants(m.parsed).select("tree", "module", "name", F.lit("constant"), F.lit(""), "shape", F.lit("")))


@_query("m05_calls")
def _(m):
    return m.calls.select("tree", "module", "caller", "call_ordinal", "dotted", "root", "attr", "lineno", "kind", "target", "label")


@_query("m06_edges")
def _(m):
    return m.edges


@_query("m07_externals")
def _(m):
    return m.externals


@_query("m08_ranking")
def _(m):
    return m.scored.select("tree", "node_id", "fan_in", "fan_out", "tier", "reach", "entry_rank", "depth", F.round("score", 6).alias("score"), "role")


@_query("m09_rows")
def _(m):
    return m.rows()


@_query("m10_pages")
def _(m):
    return m.page(kind="app", max_lines=12).select("tree", F.posexplode(F.split("markdown", "\n")).alias("line", "text"))


@_query("m11_profile")
def _(m):
    p = probes.profile(m)
    return p.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes])


@_query("m12_named_runs")
def _(m):
    return probes.named_runs(m).withColumn("coverage", F.round("coverage", 6))


@_query("m13_declared")
def _(m):
    return m.projects.select("tree", "readme", F.posexplode_outer("declared").alias("at", "target"))


@_query("m14_rejections")
def _(m):
    r = m.sources.sparkSession.createDataFrame(REPLIES, "reply int, text string, n_loops int, n_branches int")
    return r.select("reply", notes.rejection(F.col("text"), F.col("n_loops"), F.col("n_branches")).alias("reason"), notes.trimmed(F.col("text"), notes.MOST_CHARS).alias("kept"))


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def values_sql(columns: list[list[str]], rows: list[list]) -> str:
    """SELECT over VALUES of typed ``columns`` ((name, type))."""
    listed = ",\n".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    names = ", ".join(f'"c{k}"' for k in range(len(columns)))
    return "SELECT " + ", ".join(f'CAST("c{k}" AS {_TYPES[t]}) AS "{n}"' for k, (n, t) in enumerate(columns)) + f" FROM (VALUES\n{listed}) AS t({names})"


ORACLES: dict[str, str] = {n: values_sql(x["columns"], x["rows"]) for n, x in (json.loads(EXPECTED.read_text(encoding="utf-8")) if EXPECTED.exists() else {}).items()}
