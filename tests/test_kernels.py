"""Kernels against brute force: nulls, ties, repeated rows, empty tables, clashing columns, separators that mean something to a regex."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import kernels as K
from graphloom.operators import walks


def brute_reach(edges, depth, sources=None):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for source in sources if sources is not None else {n for e in edges for n in e}:
        seen, front = {source}, {source}
        out.add((source, source, 0))
        for hop in range(1, depth + 1):
            front = {b for a in front for b in after.get(a, ())} - seen
            seen |= front
            out |= {(source, n, hop) for n in front}
    return out


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(7)
    return [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(80)] + [(k, k + 1) for k in range(1000, 1012)] + [(5, 5), (5, 6), (5, 6)]


def test_reach(spark, graph):
    e = spark.createDataFrame(graph, "src long, dst long")
    for parts in (16,):
        got = [tuple(r) for r in K.reach_all(e, 6, parts).select("source", "node", "hops").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_reach(graph, 6)
    some = [1, 5, 1000, 77]
    got = [tuple(r) for r in K.bounded_reach(e, spark.createDataFrame([(x,) for x in [*some, 5]], "node long"), 6).select("source", "node", "hops").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_reach(graph, 6, some)
    assert K.bounded_reach(e, spark.createDataFrame([(None,)], "node long"), 6).count() == 0


def test_reach_in_blocks_and_by_rounds(spark, graph, monkeypatch):
    e = spark.createDataFrame([*graph, (None, 3), (4, None)], "src long, dst long")
    nodes = sorted({n for edge in graph for n in edge})
    s = spark.createDataFrame([(n,) for n in nodes], "node int")
    want = brute_reach(graph, 6)
    monkeypatch.setattr(walks, "_TOGETHER", 5)
    monkeypatch.setattr(walks, "_PAIRS", 7)
    for block, held in ((7, 1 << 23), (7, 40), (7, 0), (1000, 1 << 23)):
        got = [tuple(r) for r in K.bounded_reach(e, s, 6, block, held).select("source", "node", "hops").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    names = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in graph], "src string, dst string")
    got = {tuple(r) for r in K.bounded_reach(names, s.selectExpr("concat('n', node) AS node"), 2, 7).collect()}
    assert got == {(f"n{a}", f"n{b}", h) for a, b, h in brute_reach(graph, 2)}


def test_reach_writes_edges_not_pairs(spark, monkeypatch):
    rows, write = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name: rows.append((d := write(df, name)).count()) or d)
    n = 3000
    edges = [(k, k + d) for k in range(n) for d in (1, 50) if k + d < n]
    found = K.bounded_reach(spark.createDataFrame(edges, "src long, dst long"), spark.range(n).withColumnRenamed("id", "node"), 6)
    assert found.count() > 20 * n > 2 * sum(rows)


def test_least_hops(spark, graph):
    e = spark.createDataFrame(graph, "src long, dst long")
    got = {r["node"]: r["hops"] for r in K.least_hops(e, spark.createDataFrame([(1,), (1000,)], "node long")).collect()}
    want = {}
    for _, n, h in brute_reach(graph, 99, [1, 1000]):
        want[n] = min(h, want.get(n, h))
    assert got == want


def test_topological_levels(spark):
    nodes = ["a", "b", "c", "d", "e", "x", "y"]
    needs = [("b", "a"), ("c", "b"), ("d", "d"), ("e", "missing"), ("x", "y"), ("y", "x"), ("c", "x"), (None, "a")]
    got = {r["node"]: r["level"] for r in K.topological_levels(spark.createDataFrame([(n,) for n in [*nodes, "a"]], "node string"), spark.createDataFrame(needs, "node string, need string")).collect()}
    # a, d and e are free; then b; then all wait and c, the least, is placed; then x and y still wait for each other
    assert got == {"a": 0, "d": 0, "e": 0, "b": 1, "c": 2, "x": 3, "y": 4}
    assert K.topological_levels(spark.createDataFrame([], "node string"), spark.createDataFrame([], "node string, need string")).count() == 0


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, write = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    nodes = spark.range(30).select(F.col("id").alias("node")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    got = {r["node"]: r["level"] for r in K.topological_levels(nodes, nodes.select("node", F.expr("node div 3").alias("need"))).collect()}
    assert got == {n: 0 if n == 0 else 1 if n < 3 else 2 if n < 9 else 3 if n < 27 else 4 for n in range(30)}
    e = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {tuple(r) for r in K.least_hops(e, spark.createDataFrame([(5,)], "node long")).collect()} == {(5, 0), (6, 1), (7, 2), (8, 3)}
    assert len(plans) > 15 and not any("Broadcast" in p for p in plans)


def test_prefixes_and_suffixes_by_any_separator(spark):
    d = spark.createDataFrame([("pkg.a.b",), ("pkg.c",), ("other",), (None,), ("pkg.a.b",)], "name string")
    p = spark.createDataFrame([("pkg.a",), ("pkg",), ("pk",)], "prefix string")
    got = sorted((r["name"] or "", r["prefix"]) for r in K.longest_prefix(d, "name", p, ".").collect())
    assert got == [("", None), ("other", None), ("pkg.a.b", "pkg.a"), ("pkg.a.b", "pkg.a"), ("pkg.c", "pkg")]
    v = spark.createDataFrame([("a.x.y",), ("b.x.y",), ("x.y",), ("z",)], "name string")
    assert {r["name"]: r["suffix"] for r in K.shortest_unique_suffix(v, "name", ".").collect()} == {"a.x.y": "a.x.y", "b.x.y": "b.x.y", "x.y": "x.y", "z": "z"}
    keyed = spark.createDataFrame([(1, "p.q"), (2, "p.q")], "tree int, name string")
    only = spark.createDataFrame([(1, "p")], "tree int, prefix string")
    assert {r["tree"]: r["prefix"] for r in K.longest_prefix(keyed, "name", only, ".", ["tree"]).collect()} == {1: "p", 2: None}


def test_first_interval(spark):
    rng = random.Random(3)
    spans = [(rng.randint(0, 2), b := rng.randint(0, 60), b + rng.randint(0, 15)) for _ in range(40)]
    points = [(k, rng.randint(0, 2), rng.randint(0, 80)) for k in range(120)] + [(5, 1, 30), (6, 1, None)]
    got = K.first_interval(spark.createDataFrame(points, "id int, g int, at int"), spark.createDataFrame(spans, "g int, b int, e int"), ["g"], "at", "b", "e").collect()
    want = []
    for i, g, at in points:
        held = [b for h, b, e in spans if h == g and at is not None and b <= at <= e]
        want += [(i, g, at, min(held))] if held else []
    assert sorted(map(tuple, got)) == sorted(want)


def test_islands(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.randint(-50, 300), rng.choice("abc")) for _ in range(150)] + [(1, None, "a")]
    d = spark.createDataFrame(rows, "g int, at int, kind string")
    want = {}
    for g in (1, 2, None):
        at, island = None, 0
        for x in sorted(r[1] for r in rows if r[0] == g and r[1] is not None):
            island += at is not None and x - at > 3
            at = x
            want.setdefault((g, island), []).append(x)
    for width in (1, 4):
        got = K.island_summaries(d, ["g"], F.col("at"), 3, width, {"n": (F.count("*"), F.sum("_n"))}).collect()
        assert {(r["g"], r["island"]): (r["begin"], r["end"], r["n"]) for r in got} == {k: (min(v), max(v), len(v)) for k, v in want.items()}
    plain = K.islands(d.filter("at IS NOT NULL"), ["g"], F.col("at"), [F.col("at"), F.col("kind")], 3).groupBy("g", "island").count().collect()
    assert {(r["g"], r["island"]): r["count"] for r in plain} == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("values", [[3], [1, 1, 1, 1], list(range(100)), [5, 5, 5, 1, 9, 9, None, 2], [0.5 * (k % 7) for k in range(50)]])
def test_kth_smallest(spark, values):
    d = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    ranked = sorted(v for v in values if v is not None)
    for parts in (2, 64):
        assert K.kth_smallest(d, "x", 3, parts).first()["cutoff"] == ranked[max(len(ranked) // 3, 1) - 1]
    assert K.kth_smallest(d.limit(0), "x").first()["cutoff"] is None


def test_greedy_cover(spark):
    sets = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (3, "a"), (4, "d"), (None, "z"), (1, "a")]
    d = spark.createDataFrame(sets, "k int, i string")
    assert [tuple(r) for r in K.greedy_cover(d, "k", "i", 4).orderBy("place").collect()] == [(0, 2, 3), (1, 1, 1)]
    assert [tuple(r) for r in K.greedy_cover(d, "k", "i", 4, F.lit(4)).orderBy("place").collect()] == [(0, 4, 1), (1, 1, 2), (2, 2, 1)]
    assert K.greedy_cover(d.limit(0), "k", "i", 4).count() == 0


def test_score_leaves_other_columns_alone(spark):
    d = spark.createDataFrame([(1, 2, 0, 7), (1, 4, 0, 8), (2, 9, 3, None)], "g int, a int, b int, _lo_a int")
    got = {r["a"]: (round(r["score"], 6), r["_lo_a"]) for r in K.weighted_score(d, {"a": 0.5, "b": 0.5}, keys=["g"]).collect()}
    assert got == {2: (0.0, 7), 4: (0.5, 8), 9: (0.0, None)}
    assert {round(r["score"], 6) for r in K.weighted_score(d, {"a": 1.0}).collect()} == {0.0, round(2 / 7, 6), 1.0}


def test_small_kernels(spark):
    d = spark.createDataFrame([(1, "x", 3, 0), (2, "x", 3, 5), (3, None, 1, 5), (4, None, 2, 5)], "id int, k string, v int, _n int")
    assert {r["id"] for r in K.dedupe_by_rank(d, ["k"], [F.desc("v"), F.desc("id")]).collect()} == {2, 4}
    assert {r["id"] for r in K.budgeted_prefix(d, ["k"], [F.col("id")], "v", 3).collect()} == {1, 3, 4}
    got = K.top_with_skip(d, ["k"], [F.col("id")], 1, F.col("_n") > 0).collect()
    assert {(r["id"], r["place"], r["_n"]) for r in got} == {(1, 1, 0), (2, 2, 5), (3, 1, 5), (4, 2, 5)}
    e = K.distinct_edges(spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "a int, b int"), "a", "b")
    assert {tuple(r) for r in K.fans(e).collect()} == {(1, 0, 1), (2, 1, 1), (3, 1, 0)}
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, i int")
    assert [r["k"] for r in K.subset_of(s, "k", "i", spark.createDataFrame([(1,)], "i int")).collect()] == ["b"]
