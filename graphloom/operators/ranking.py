"""Score functions and give them roles: ways in, depth from them, weighted score, trivial, skim and spine.

All of it is per tree. Only the two graph walks leave the JVM: reach and depth are searched by one worker a tree, in memory,
from the tree's edges (for graphs that don't fit a worker, ``kernels.reach_all`` and ``kernels.least_hops`` do the same by rounds
of joins).
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import kernels as K
from graphloom.operators.store import written

#: Decorators by which a framework calls a function, and those that make it no way in.
ENTRY_DECORATORS = "route get post put patch delete command group task callback main handler entry_point".split()
INNER_DECORATORS = "fixture property cached_property setter deleter".split()
WIRING = tuple(f"__{n}__" for n in "eq init new post_init repr str".split())
WEIGHTS = {"effective_branches": 0.45, "loc": 0.25, "fan_in": 0.15, "fan_out": 0.15}
TRIVIAL_LOC, TRIVIAL_BRANCHES, SPINE = 8, 2, 3
#: Tiers from this one on are read off the graph and count as one; depth to which reach is counted.
INFERRED, REACH_DEPTH = 3, 6


def decorator_tails(decorators: Column) -> Column:
    return F.transform(decorators, lambda d: F.substring_index(d, ".", -1))


def effective_branches() -> Column:
    """A conditional expression is half a decision."""
    return F.col("n_branches") - F.col("n_ternaries") * F.lit(0.5)


def presentation_factor() -> Column:
    """Less for functions that are mostly text."""
    dense = F.col("n_strings") >= F.lit(0.5) * F.col("loc")
    return F.when((F.col("loc") < 4) | (F.col("n_strings") < 3), 1.0).when(dense, 0.65).otherwise(0.8)


def constructor_factor() -> Column:
    return F.when(F.col("name").isin(*WIRING), 0.6).otherwise(1.0)


def is_trivial() -> Column:
    """Short, leaf, hardly branching, and private or of two statements."""
    private = F.col("name").startswith("_")
    return (F.col("fan_out") == 0) & (F.col("n_branches") <= TRIVIAL_BRANCHES) & (F.col("loc") <= TRIVIAL_LOC) & (private | (F.col("n_stmts") <= 2))


def with_fans(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds fan_in and fan_out: distinct callers and callees."""
    into = edges.groupBy("tree", F.col("dst").alias("node_id")).agg(F.count("*").cast("int").alias("fan_in"))
    out = edges.groupBy("tree", F.col("src").alias("node_id")).agg(F.count("*").cast("int").alias("fan_out"))
    f = functions.join(into, ["tree", "node_id"], "left").join(out, ["tree", "node_id"], "left")
    return f.withColumns({"fan_in": F.coalesce("fan_in", F.lit(0)), "fan_out": F.coalesce("fan_out", F.lit(0))})


def declared_functions(projects: DataFrame, modules: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(tree, node_id) of declared targets ``module:function``: by exact name, else where the module imports the name from, else
    in the first module of which one name ends with the other's parts."""
    d = projects.select("tree", F.posexplode("declared").alias("at", "target"))
    name = F.trim(F.substring_index(F.when(F.col("target").contains(":"), F.expr("substring(target, instr(target, ':') + 1)")).otherwise(""), ".", 1))
    d = d.select("tree", "at", F.trim(F.substring_index("target", ":", 1)).alias("module"), F.when(name == "", "main").otherwise(name).alias("func"))
    nodes = functions.select("tree", "node_id")
    exact = d.select("tree", "at", F.concat_ws("::", "module", "func").alias("node_id"), F.lit(0).cast("long").alias("rank"))
    bound = d.join(imports.withColumnRenamed("name", "func"), ["tree", "module", "func"])
    origin = F.regexp_extract("origin", r"^(.*)\.[^.]*$", 1)
    again = bound.select("tree", "at", F.concat_ws("::", origin, F.substring_index("origin", ".", -1)).alias("node_id"), F.lit(1).cast("long"))
    ends = lambda c: F.expr(f"transform(sequence(1, size(split({c}, '\\\\.'))), i -> substring_index({c}, '.', -i))")
    m = modules.select("tree", F.col("module").alias("full"), "module_ordinal")
    longer = m.select("tree", "full", "module_ordinal", F.explode(ends("full")).alias("module")).join(d, ["tree", "module"])
    shorter = d.select("tree", "at", "func", F.explode(ends("module")).alias("full")).join(m, ["tree", "full"])
    near = longer.select("tree", "at", "func", "full", "module_ordinal").union(shorter.select("tree", "at", "func", "full", "module_ordinal"))
    near = near.select("tree", "at", F.concat_ws("::", "full", "func").alias("node_id"), (F.col("module_ordinal") + 2).cast("long"))
    hit = exact.union(again).union(near).join(nodes, ["tree", "node_id"])
    return hit.groupBy("tree", "at").agg(F.min_by("node_id", "rank").alias("node_id")).select("tree", "node_id").distinct()


def ways_in(functions: DataFrame, declared: DataFrame, guarded: DataFrame) -> DataFrame:
    """(tree, node_id, tier): 0 declared, 1 called by a main guard, 2 by a framework, 3 named main, 4 and 5 functions and methods
    that nothing calls. The first tier that names a function counts."""
    tails = decorator_tails(F.col("decorators"))
    has = lambda names: F.arrays_overlap(tails, F.array(*map(F.lit, names)))
    inner = has(INNER_DECORATORS)
    free = (F.col("fan_in") == 0) & ~F.col("name").startswith("_") & ~F.col("name").startswith("test_")
    tier = F.when(inner, None).when(has(ENTRY_DECORATORS), 2).when((F.col("name") == "main") & F.col("cls").isNull(), 3).when(free & F.col("cls").isNull(), 4).when(free, 5)
    stated = declared.select("tree", "node_id", F.lit(0).alias("tier")).union(guarded.select("tree", F.col("target").alias("node_id"), F.lit(1)))
    seen = functions.select("tree", "node_id", tier.alias("tier")).filter("tier IS NOT NULL")
    return stated.union(seen).groupBy("tree", "node_id").agg(F.min("tier").alias("tier"))


def _walk_tree(left: pa.Table, right: pa.Table) -> pa.Table:
    """Reach of each entry and depth of every function that entries lead to, for one tree."""
    after: dict[str, list[str]] = {}
    for a, b in zip(left.column("src").to_pylist(), left.column("dst").to_pylist()):
        after.setdefault(a, []).append(b)
    entries = right.column("node_id").to_pylist()
    depth = dict.fromkeys(entries, 0)
    queue = deque(entries)
    while queue:
        at = queue.popleft()
        for n in after.get(at, ()):
            if n not in depth:
                depth[n] = depth[at] + 1
                queue.append(n)
    reach = {}
    for e in entries:
        seen = front = {e}
        for _ in range(REACH_DEPTH):
            front = {n for at in front for n in after.get(at, ())} - seen
            if not front:
                break
            seen = seen | front
        reach[e] = len(seen)
    tree = (right if right.num_rows else left).column("tree")[:1].to_pylist() * len(depth)
    return pa.table({"tree": pa.array(tree, pa.string()), "node_id": pa.array(list(depth), pa.string()), "depth": pa.array(list(depth.values()), pa.int32()), "reach": pa.array([reach.get(n) for n in depth], pa.int32())})


def walks(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(tree, node_id, depth, reach): calls from the nearest entry, and for entries how many functions they lead to within 6."""
    return edges.select("tree", "src", "dst").groupBy("tree").cogroup(entries.select("tree", "node_id").groupBy("tree")).applyInArrow(_walk_tree, "tree string, node_id string, depth int, reach int")


def annotate(functions: DataFrame, edges: DataFrame, declared: DataFrame, guarded: DataFrame) -> DataFrame:
    """``functions`` with fan_in, fan_out, tier, reach, entry_rank, depth, effective_branches, score and role.

    Ways in go by tier, the inferred ones as one tier by reach. Roles: functions that aren't ways in are trivial or, among the
    least third by score, branchless ones skim; the spine is the first of two leading ways in that isn't trivial and the best
    reachable ones, three in all, none of which but the first two may be branchless.
    """
    f = written(with_fans(functions, edges), "fans")  # read for the ways in and again for the rest
    ways = ways_in(f, declared, guarded)
    found = walks(edges, ways)
    f = f.join(ways, ["tree", "node_id"], "left").join(found, ["tree", "node_id"], "left")
    f = f.repartition("tree")  # once; every window below is by tree, or by tree and more
    leading = Window.partitionBy("tree", F.col("tier").isNull()).orderBy(F.least("tier", F.lit(INFERRED)), F.desc("reach"), "node_id")
    f = f.withColumn("entry_rank", F.when(F.col("tier").isNotNull(), F.row_number().over(leading) - 1))
    f = K.weighted_score(f.withColumn("effective_branches", effective_branches()), WEIGHTS, keys=["tree"])
    f = f.withColumn("score", F.col("score") * presentation_factor() * constructor_factor())
    is_entry = F.col("tier").isNotNull()
    f = f.withColumns({"_small": is_trivial(), "_trivial": ~is_entry & is_trivial()})
    by_score = Window.partitionBy("tree", "_trivial").orderBy("score", "node_id")
    alike = Window.partitionBy("tree", "_trivial")
    f = f.withColumns({"_nth": F.row_number().over(by_score), "_third": F.greatest(F.floor(F.count("*").over(alike) / 3), F.lit(1))})
    cutoff = F.max(F.when(F.col("_nth") == F.col("_third"), F.col("score"))).over(alike)
    f = f.withColumn("_skim", ~is_entry & (F.col("n_branches") == 0) & (F.col("score") <= cutoff))
    # the spine
    whole = Window.partitionBy("tree")
    first = F.min(F.when((F.col("entry_rank") < 2) & ~F.col("_small"), F.col("entry_rank"))).over(whole)
    f = f.withColumn("_first", F.coalesce(F.col("entry_rank") == first, F.lit(False)))
    f = f.withColumns({"_open": F.col("depth").isNotNull() & ~F.col("_trivial") & ~F.col("_first"), "_taken": F.max(F.col("_first").cast("int")).over(whole)})
    best = Window.partitionBy("tree", "_open").orderBy(F.desc("score"), "module", "lineno", "func_ordinal")
    f = f.withColumn("_place", F.when(F.col("_open"), F.row_number().over(best)))
    free = F.lit(SPINE - 1) - F.col("_taken")
    last = F.min(F.when((F.col("_place") > free) & (F.col("n_branches") > 0), F.col("_place"))).over(whole)
    f = f.withColumn("_spine", F.coalesce(F.col("_first") | (F.col("_place") <= free) | (F.col("_place") == last), F.lit(False)))
    top = Window.partitionBy("tree").orderBy(F.desc("score"), "func_ordinal")
    f = f.withColumns({"_any": F.max(F.col("_spine").cast("int")).over(whole), "_best": F.row_number().over(top)})
    spine = F.col("_spine") | ((F.col("_any") == 0) & (F.col("_best") == 1))
    role = F.when(spine, "spine").when(F.col("_trivial"), "trivial").when(F.col("_skim"), "skim").otherwise("keep")
    return f.withColumn("role", role).drop(*[c for c in f.columns if c.startswith("_")])
