"""Relational kernels with columns as parameters. Each is one declarative plan; order is always made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.operators.store import forget, written
from graphloom.operators.walks import walk

_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def dedupe_by_rank(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of equal keys; end ``order`` with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def distinct_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def fans(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of distinct edges (src, dst), for nodes of either end."""
    both = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")).join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out")), "node", "full")
    return both.select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def weighted_score(df: DataFrame, weights: dict[str, float], name: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Adds the weighted sum of columns normalised to their least and greatest values (of the same ``keys``); equal values count 0.

    Without keys the extremes are one aggregated row, joined by broadcast. Null values and weights add nothing.
    """
    keys = keys or []
    lows, highs = ([f"__{n}_{k}" for k in range(len(weights))] for n in ("lo", "hi"))
    ends = df.groupBy(*keys).agg(*[f(c).alias(a) for names, f in ((lows, F.min), (highs, F.max)) for c, a in zip(weights, names)])
    d = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))
    total = F.lit(0.0)
    for (c, w), lo, hi in zip(weights.items(), lows, highs):
        total = total + F.lit(w) * F.coalesce(F.try_divide((F.col(c) - F.col(lo)).cast("double"), (F.col(hi) - F.col(lo)).cast("double")), F.lit(0.0))
    return d.withColumn(name, total).drop(*lows, *highs)


def budgeted_prefix(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Longest leading run whose running cost is within the budget, for costs that aren't negative."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_BEFORE)
    return df.withColumn("__run", F.sum(cost).over(w)).filter(F.col("__run") <= budget).drop("__run")


def kth_smallest(df: DataFrame, column: str, divisor: int = 3, parts: int = 64) -> DataFrame:
    """One row ``cutoff``: the k-th smallest value of a number column, k a divisor-th of its rows, 1 at least. Nulls don't count.

    Values are counted first. A sketch of the distribution cuts them into ``parts`` ranges, whose totals (one row each) say which
    range holds the k-th value; only that range is ordered, so no task sees more than about a ``parts``-th of the values.
    """
    values = df.filter(F.col(column).isNotNull())
    counts = values.groupBy(column).agg(F.count("*").alias("n"))
    cuts = values.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 100 * parts).alias("_cuts"))
    d = counts.crossJoin(F.broadcast(cuts)).select(column, "n", F.size(F.filter("_cuts", lambda c: c < F.col(column))).alias("_part"))
    sums = d.groupBy("_part").agg(F.sum("n").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(*_BEFORE)  # one row a part
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.greatest(F.floor(F.sum("_n").over(whole) / divisor), F.lit(1))
    place = sums.select("_part", k.alias("_k"), F.sum("_n").over(upto).alias("_upto"), "_n").filter("_upto >= _k AND _upto - _n < _k").select("_part", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_k"))
    one = d.join(F.broadcast(place), "_part")
    w = Window.orderBy(column).rowsBetween(*_BEFORE)
    return one.withColumn("_upto", F.sum("n").over(w)).filter("_upto >= _k").agg(F.min(column).alias("cutoff"))


def top_with_skip(df: DataFrame, keys: list[str], order: list[Column], free: int, keep: Column) -> DataFrame:
    """The first ``free`` rows of each group, then the first later one where ``keep`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__n", F.row_number().over(w)).withColumn("__ok", (F.col("__n") > free) & keep)
    first = F.min(F.when(F.col("__ok"), F.col("__n"))).over(Window.partitionBy(*keys))
    return d.withColumn("__f", first).filter((F.col("__n") <= free) | (F.col("__n") == F.col("__f"))).withColumnRenamed("__n", "place").drop("__ok", "__f")


def islands(df: DataFrame, keys: list[str], at: Column, order: list[Column], gap: float) -> DataFrame:
    """Adds ``island``, a number within the group that grows wherever ``at`` is more than ``gap`` past the row before. Null keys
    are a group; a null place begins no island."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__at", at).withColumn("__new", F.when(F.col("__at") - F.lag("__at").over(w) > gap, 1).otherwise(0))
    return d.withColumn("island", F.sum("__new").over(w.rowsBetween(*_BEFORE))).drop("__at", "__new")


def island_summaries(df: DataFrame, keys: list[str], at: Column, gap: int, width: int, aggregates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(keys, island, begin, end, aggregates) of runs of rows with at most ``gap`` between neighbours, for hot groups.

    Rows are first summed up by cells of ``width`` <= gap + 1 of ``at``, all of whose rows are neighbours, with no sort; then
    neighbouring cells are joined. ``aggregates``: name -> (partial over rows, final over the partial named ``_<name>``).
    """
    cell = F.floor(at / width)
    parts = df.filter(at.isNotNull()).groupBy(*keys, cell.alias("_cell")).agg(F.min(at).alias("_begin"), F.max(at).alias("_end"), *[p.alias(f"_{n}") for n, (p, _) in aggregates.items()])
    w = Window.partitionBy(*keys).orderBy("_cell")
    d = parts.withColumn("_new", F.when(F.col("_begin") - F.lag("_end").over(w) > gap, 1).otherwise(0))
    d = d.withColumn("island", F.sum("_new").over(w.rowsBetween(*_BEFORE)))
    return d.groupBy(*keys, "island").agg(F.min("_begin").alias("begin"), F.max("_end").alias("end"), *[f.alias(n) for n, (_, f) in aggregates.items()])


def _parts(column: str, sep: str) -> Column:
    return F.split(F.col(column), "\\Q" + sep + "\\E")


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame, sep: str = "/", keys: list[str] | None = None) -> DataFrame:
    """Adds ``prefix``: the longest of ``prefixes`` (keys and prefix) that is the column's value or leads it up to a separator.

    Prefixes of each distinct value are exploded and met by an equi-join, never by a theta join. Null values have none.
    """
    keys = keys or []
    parts = _parts(column, sep)
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i * 0 + 1, i), sep))
    cand = df.select(*keys, column).filter(F.col(column).isNotNull()).distinct().select(*keys, column, F.explode(each).alias("prefix"))
    best = cand.join(prefixes.select(*keys, "prefix").distinct(), [*keys, "prefix"]).groupBy(*keys, column).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return df.join(best, [*keys, column], "left")


def shortest_unique_suffix(df: DataFrame, column: str, sep: str = "/", keys: list[str] | None = None) -> DataFrame:
    """(keys, column, suffix) of distinct values: the shortest trailing run of components that no other value of the keys has, else the value."""
    keys = keys or []
    values = df.select(*keys, column).distinct().filter(F.col(column).isNotNull())
    parts = _parts(column, sep)
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, -i, i), sep).alias("suffix")))
    s = values.select(*keys, column, F.explode(each).alias("x")).select(*keys, column, "x.n", "x.suffix")
    alone = s.groupBy(*keys, "suffix", "n").agg(F.count("*").alias("c"), F.max(column).alias(column)).filter("c = 1")
    best = alone.groupBy(*keys, column).agg(F.min_by("suffix", "n").alias("suffix"))
    return values.join(best, [*keys, column], "left").select(*keys, column, F.coalesce("suffix", column).alias("suffix"))


def first_interval(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Each point that a span of its group holds, with the begin of the first such span (the least begin). Repeated points stay.

    Points and spans go through one sort a group. The span of a begin that reaches furthest stands for it; a begin counts for
    a point only if no earlier one reaches it, so the first begin whose reach so far (a running maximum) is at the point or
    beyond is the answer: points are looked up in these reaches, in growing order, by a second sort. Nothing is joined, so a
    group costs its points plus its spans. A hot group is one sort of one task, spilling to disk.
    """
    one = spans.groupBy(*keys, begin).agg(F.max(end).alias("_reach"))
    order = Window.partitionBy(*keys).orderBy(begin)
    # begins that push the reach further, with the interval of points for which they are the first: (reach before, own reach]
    one = one.withColumn("_before", F.max("_reach").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    steps = one.filter(F.col("_before").isNull() | (F.col("_reach") > F.col("_before")))
    names = points.columns
    p = points.select(*names, F.lit(None).cast(steps.schema[begin].dataType).alias("_begin"), F.col(at).alias("_at"), F.lit(0).alias("_kind"))
    missing = [F.lit(None).cast(points.schema[n].dataType).alias(n) if n not in keys else F.col(n) for n in names]
    q = steps.select(*missing, F.col(begin).alias("_begin"), F.col("_reach").alias("_at"), F.lit(1).alias("_kind"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(q).withColumn("_begin", F.last("_begin", ignorenulls=True).over(later)).filter("_kind = 0")
    return both.filter(F.col("_begin") <= F.col(at)).select(*names, F.col("_begin").alias(begin))


def bounded_reach(edges: DataFrame, sources: DataFrame, depth: int, block: int = 1 << 16, held: int = 1 << 23) -> DataFrame:
    """(source, node, hops): nodes within ``depth`` hops of each source, itself included.

    Sources are cut into blocks of ``block`` neighbouring values. Breadth-first rounds over (block, node) find the edges that a
    block's sources can use, each once a block; then one worker a block walks them from every source, and nothing is shuffled
    any more. So what is moved grows with the edges and not with the rows found, as far as edges lead to near values. A block
    with more than ``held`` edges is too large for a worker: its sources go by rounds of joins.
    """
    kind = edges.select("src").union(edges.select("dst")).union(sources.select("node")).schema["src"].dataType
    starts = written(sources.select(F.col("node").cast(kind).alias("node")).filter("node IS NOT NULL").distinct(), "starts")
    hops = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    hops = written(hops.filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct(), "edges")
    n = starts.count()
    # at least one block a core where each has some thousand sources
    blocks = max(-(-n // block), min(-(-n // 4096), starts.sparkSession.sparkContext.defaultParallelism), 1)
    first = written(starts.repartitionByRange(blocks, "node").select(F.spark_partition_id().alias("block"), "node"), "blocks")
    seen = front = first
    pieces = []
    for hop in range(depth):
        pieces.append(written(front.join(hops.hint("merge"), F.col("node") == F.col("src")).select("block", "src", "dst"), "piece"))
        if hop + 1 == depth:
            break
        step = pieces[-1].select("block", F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.hint("merge"), ["block", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    rows = first.select("block", F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))
    for p in pieces:
        rows = rows.unionByName(p)
    large = [r["block"] for r in rows.groupBy("block").agg(F.count("dst").alias("n")).filter(F.col("n") > held).collect()]
    schema = StructType([StructField("source", kind), StructField("node", kind), StructField("hops", IntegerType())])
    out = rows.filter(~F.col("block").isin(large)).repartitionById(blocks, "block").select("src", "dst").mapInArrow(walk(depth), schema)
    return out.unionByName(_reach_by_rounds(hops, first.filter(F.col("block").isin(large)), depth)) if large else out


def _reach_by_rounds(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """``bounded_reach`` by breadth-first rounds of joins over (source, node), each front written.

    All rows found are moved some times, but no worker holds more than its share.
    """
    seen = front = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")), "front")
    for hop in range(1, depth + 1):
        step = front.join(edges.hint("merge"), F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.select("source", "node").hint("merge"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def least_hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, hops): hops from the nearest of ``sources`` (node), for all nodes that they lead to, however far.

    The edges are written, so that no round makes them again; no round's tables pass through the driver.
    """
    hops = written(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    seen = front = written(sources.select("node", F.lit(0).alias("hops")).filter("node IS NOT NULL").distinct(), "front")
    hop = 0
    while not front.isEmpty():
        hop += 1
        step = front.join(hops.hint("merge"), front["node"] == hops["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.select("node").hint("merge"), "node", "left_anti").withColumn("hops", F.lit(hop)), "front")
        seen = seen.unionByName(front)
    forget(hops)
    return seen


def topological_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, level): nodes whose needs (node, need) are all placed come next, together; where every one left waits for another,
    the least of them is placed. Needs outside ``nodes`` and of oneself don't count, nor do null nodes.

    A round is three anti-joins over what is left, written; rounds are as many as there are levels. They are merge joins: tables
    of a round that seem small enough to broadcast would pass through the driver, some in each of the rounds.
    """
    left = written(nodes.select("node").filter("node IS NOT NULL").distinct(), "left")
    waits = needs.filter("node != need").join(left.select(F.col("node").alias("need")).hint("merge"), "need", "left_semi")
    waits = written(waits.select("node", "need").distinct(), "waits")
    placed, level = [], 0
    while True:
        at = F.lit(level).alias("level")
        ready = written(left.join(waits.select("node").hint("merge"), "node", "left_anti").select("node", at), "level")
        stuck = ready.isEmpty()
        if stuck:
            ready = written(left.agg(F.min("node").alias("node")).filter("node IS NOT NULL").select("node", at), "level")
            if ready.isEmpty():
                break
        placed.append(ready)
        done = ready.select("node").hint("merge")
        still = waits.join(ready.select(F.col("node").alias("need")).hint("merge"), "need", "left_anti").select("node", "need")
        before = left, waits
        waits = written(still.join(done, "node", "left_anti") if stuck else still, "waits")
        left = written(left.join(done, "node", "left_anti"), "left")
        forget(*before)
        level += 1
    out = placed[0] if placed else nodes.select("node", F.lit(0).alias("level")).limit(0)
    for p in placed[1:]:
        out = out.union(p)
    return out


def reach_all(edges: DataFrame, depth: int, parts: int = 16) -> DataFrame:
    """(source, node, hops): like ``bounded_reach`` from every node of ``edges`` (src, dst), 64 sources a row and round.

    A row is a node and a block of 64 sources: one mask a hop, of the sources that first meet the node there. Each round is one
    join and one ``bit_or``; a loop at every node carries the masks so far, so a round is used only once.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node IS NOT NULL").distinct()
    d = nodes.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(parts)))
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("node")) - 1)
    d = d.select("node", (F.floor(F.col("_at") / 64) * parts + F.col("_part")).alias("block"), (F.col("_at") % 64).cast("int").alias("bit"))
    sources = d.groupBy("block").agg(F.collect_list(F.struct("bit", F.col("node").alias("source"))).alias("sources"))
    hops = edges.select("src", "dst", F.lit(False).alias("loop")).filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst").distinct()
    hops = hops.union(nodes.select("node", F.col("node").alias("dst"), F.lit(True)))
    now = d.select("node", "block", F.expr("shiftleft(1L, bit)").alias("m0"))
    for hop in range(1, depth + 1):
        masks = [f"m{k}" for k in range(hop)]
        j = now.join(hops, (F.col("node") == F.col("src")) & (F.col("loop") | (F.col(masks[-1]) != 0)))
        j = j.select(F.col("dst").alias("node"), "block", *[F.when(F.col("loop"), F.col(m)).otherwise(F.lit(0).cast("long")).alias(m) for m in masks], F.when(F.col("loop"), F.lit(0).cast("long")).otherwise(F.col(masks[-1])).alias("step"))
        now = j.groupBy("node", "block").agg(*[F.bit_or(m).alias(m) for m in masks], F.bit_or("step").alias("step"))
        now = now.select("node", "block", *masks, F.expr(f"step & ~({' | '.join(masks)})").alias(f"m{hop}"))
    each = now.join(sources, "block").select("node", *[f"m{k}" for k in range(depth + 1)], F.inline("sources"))
    met = F.expr("CASE " + " ".join(f"WHEN shiftright(m{k}, bit) & 1 = 1 THEN {k}" for k in range(depth + 1)) + " END")
    return each.select("source", "node", met.alias("hops")).filter("hops IS NOT NULL")


def subset_of(df: DataFrame, key: str, item: str, other: DataFrame) -> DataFrame:
    """Keys all of whose items are in ``other`` (item)."""
    out = df.select(key, item).distinct().join(other.select(item).distinct(), item, "left_anti").select(key).distinct()
    return df.select(key).distinct().join(out, key, "left_anti")


def greedy_cover(sets: DataFrame, key: str, item: str, rounds: int, first: Column | None = None) -> DataFrame:
    """(place, key, gain) of up to ``rounds`` keys, each adding the most items not yet covered; ties take the least key, and
    nothing is added that covers nothing new. ``first``: the key that comes first whatever it covers.

    What is left is written after each round, so a round is one aggregate and one anti-join over it; one row a round is kept.
    """
    left = written(sets.select(key, item).filter(F.col(key).isNotNull()).distinct(), "uncovered")
    picked = []
    for place in range(rounds):
        gains = left.groupBy(key).agg(F.count("*").alias("gain"))
        if place == 0 and first is not None:
            gains = gains.filter(F.col(key) == first)
        best = written(gains.orderBy(F.desc("gain"), key).limit(1).select(F.lit(place).alias("place"), key, "gain"), "picked")
        picked.append(best)
        if best.isEmpty():
            break
        covered = left.join(F.broadcast(best.select(key)), key, "left_semi").select(item)
        after = written(left.join(covered, item, "left_anti"), "uncovered")
        forget(left)
        left = after
    out = picked[0]
    for p in picked[1:]:
        out = out.union(p)
    return out
