"""Parse source tables and resolve every call by name, as equi-joins.

Keys begin with ``tree``, so any number of trees are resolved at once. A call is decided by the root of its dotted chain: own
methods through project ancestors, then imports, then names of its module; what none of them explains stays unresolved.

Null contents parse as empty files that couldn't be read; repeated (tree, module) rows must not occur (``sources`` keeps the
last file of a name); empty tables give empty tables.
"""

from __future__ import annotations

import builtins
import gc
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.functions.syntax import empty_module, parse_module
from graphloom.operators import kernels as K
from graphloom.operators.store import forget, written
from graphloom.sources.trees import read_text

_CALL = "struct<dotted:string,root:string,attr:string,lineno:int>"
_FUNC = f"struct<name:string,qualname:string,cls:string,lineno:int,end_lineno:int,args:array<string>,returns:string,doc:string,returns_keys:array<string>,decorators:array<string>,is_async:boolean,n_stmts:int,n_branches:int,n_loops:int,n_ternaries:int,n_strings:int,loc:int,calls:array<{_CALL}>>"
_CLASS = "struct<name:string,lineno:int,bases:array<string>,doc:string,fields:array<struct<name:string,shape:string>>,methods:array<string>,kind:string>"
_CONSTANT = "struct<name:string,lineno:int,shape:string>"
PARSED = f"tree string, path string, module string, module_ordinal int, is_package boolean, doc string, header_comment string, parse_error string, imports array<struct<name:string,origin:string>>, funcs array<{_FUNC}>, classes array<{_CLASS}>, constants array<{_CONSTANT}>, main_calls array<{_CALL}>"

#: The standard library of the interpreter that runs this; it must be the same on all executors.
STDLIB = frozenset(sys.stdlib_module_names)
BUILTINS = frozenset(dir(builtins))
#: Calls that say too little to be shown: into these modules, or these path helpers however they are imported.
NOISE = tuple("__future__ functools gettext itertools logging operator typing warnings".split())
PLUMBING = (*(f"os.path.{n}" for n in "abspath basename dirname expanduser expandvars isabs join normpath realpath relpath split splitext".split()), "os.fspath")


# ---- parse ------------------------------------------------------------------------------------------------------------------


def parse(sources: DataFrame) -> DataFrame:
    """One nested row a file, written once; files without content are read by the worker that parses them."""
    spark = sources.sparkSession
    schema = to_arrow_schema(spark.createDataFrame([], PARSED).schema)
    carried = ("tree", "path", "module", "module_ordinal", "is_package")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                gc.collect()
                gc.disable()  # syntax trees hold no cycles, and looking for some takes a third of the time
                rows = []
                for r in batch.slice(i, 32).to_pylist():
                    try:
                        raw = Path(r["path"]).read_bytes() if r["content"] is None else r["content"]
                        found = parse_module(read_text(raw), r["module"], r["is_package"], r["path"])
                    except OSError as e:
                        found = empty_module() | {"parse_error": str(e)}
                    rows.append({c: r[c] for c in carried} | found)
                made = pa.RecordBatch.from_pylist(rows, schema)
                gc.enable()
                yield made

    return written(sources.select(*carried, "content").mapInArrow(run, PARSED), "parsed")


def functions(parsed: DataFrame) -> DataFrame:
    """One row a function; ``func_ordinal`` orders a tree's functions as they are met."""
    f = parsed.select("tree", "module", "module_ordinal", "path", F.posexplode("funcs").alias("_at", "f"))
    return f.select("tree", F.concat_ws("::", "module", "f.qualname").alias("node_id"), "module", "path", (F.col("module_ordinal").cast("long") * 2**32 + F.col("_at")).alias("func_ordinal"), "f.*")


def classes(parsed: DataFrame) -> DataFrame:
    c = parsed.select("tree", "module", "module_ordinal", "path", F.posexplode("classes").alias("_at", "c"))
    return c.select("tree", "module", "path", (F.col("module_ordinal").cast("long") * 2**32 + F.col("_at")).alias("class_ordinal"), "c.*")


def constants(parsed: DataFrame) -> DataFrame:
    c = parsed.select("tree", "module", "module_ordinal", F.posexplode("constants").alias("_at", "c"))
    return c.select("tree", "module", (F.col("module_ordinal").cast("long") * 2**32 + F.col("_at")).alias("const_ordinal"), "c.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("tree", "module", F.inline("imports"))


def calls(parsed: DataFrame) -> DataFrame:
    """(tree, module, caller, cls, call_ordinal, dotted, root, attr, lineno); caller is null for calls of a main guard."""
    own = parsed.select("tree", "module", F.explode("funcs").alias("f")).select("tree", "module", F.col("f.qualname").alias("caller"), F.col("f.cls").alias("cls"), F.posexplode("f.calls").alias("call_ordinal", "c"))
    guard = parsed.select("tree", "module", F.lit(None).cast("string").alias("caller"), F.lit(None).cast("string").alias("cls"), F.posexplode("main_calls").alias("call_ordinal", "c"))
    return own.union(guard).select("tree", "module", "caller", "cls", "call_ordinal", "c.*")


# ---- names ------------------------------------------------------------------------------------------------------------------


def external_display(dotted: Column) -> Column:
    """How an external call is written: the last two parts of its chain."""
    return F.substring_index(dotted, ".", -2)


def full_name(origin: Column, dotted: Column, root: Column) -> Column:
    """The call's name with the origin of its root in place of the root, however it was imported."""
    return F.concat(origin, F.substring(dotted, F.length(root) + 1, F.length(dotted)))


def is_plumbing(origin: Column, dotted: Column, root: Column) -> Column:
    return F.substring_index(origin, ".", 1).isin(*NOISE) | full_name(origin, dotted, root).isin(*PLUMBING)


def owned_imports(parsed: DataFrame) -> DataFrame:
    """(tree, module, name, origin, owner): owner is the longest project module that is the origin or leads it up to a dot."""
    names = parsed.select("tree", F.col("module").alias("prefix"))
    return K.longest_prefix(imports(parsed), "origin", names, ".", ["tree"]).withColumnRenamed("prefix", "owner")


def class_bases(parsed: DataFrame, owned: DataFrame) -> DataFrame:
    """(tree, module, name, at, base_module, base_name): the bases of classes that lie in the project, by their order.

    A base is a class of the same module by its last part, else one of the module that its root is imported from; a name
    imported from a project module counts even where no class of it is known.
    """
    last = Window.partitionBy("tree", "module", "name").orderBy(F.desc("class_ordinal"))
    one = classes(parsed).select("tree", "module", "name", "bases", "class_ordinal").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    known = one.select("tree", F.col("module").alias("known_module"), F.col("name").alias("tail"))
    b = one.select("tree", "module", "name", F.posexplode("bases").alias("at", "base"))
    b = b.withColumns({"tail": F.substring_index("base", ".", -1), "root": F.substring_index("base", ".", 1)})
    here = known.select("tree", F.col("known_module").alias("module"), "tail", F.lit(True).alias("here"))
    there = known.select("tree", F.col("known_module").alias("owner"), "tail", F.lit(True).alias("there"))
    b = b.join(here, ["tree", "module", "tail"], "left").join(owned.select("tree", "module", F.col("name").alias("root"), "origin", "owner"), ["tree", "module", "root"], "left").join(there, ["tree", "owner", "tail"], "left")
    base = F.when(F.col("here"), F.col("module")).when(F.col("owner").isNotNull() & (F.col("there") | (F.col("owner") != F.col("origin"))), F.col("owner"))
    return b.select("tree", "module", "name", "at", base.alias("base_module"), F.col("tail").alias("base_name")).filter("base_module IS NOT NULL")


def _ancestors_of_tree(asked: pa.Table, bases: pa.Table) -> pa.Table:
    """``ancestors`` of one tree, in memory: a queue for every asked class."""
    above: dict[tuple, list[tuple]] = {}
    for b in sorted(bases.to_pylist(), key=lambda b: b["at"]):
        above.setdefault((b["module"], b["name"]), []).append((b["base_module"], b["base_name"]))
    out: list[tuple] = []
    for a in asked.to_pylist():
        queue = [(a["module"], a["cls"])]
        seen = set(queue)
        for at in queue:  # grows while it is walked
            for b in above.get(at, ()):
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        out += [(a["tree"], a["module"], a["cls"], m, n, k) for k, (m, n) in enumerate(queue)]
    names = ("tree", "module", "cls", "anc_module", "anc_name", "rank")
    kinds = (*[pa.string()] * 5, pa.int32())
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds))})


def ancestors(asked: DataFrame, bases: DataFrame) -> DataFrame:
    """(tree, module, cls, anc_module, anc_name, rank): each asked class (tree, module, cls) and its ancestors, breadth first by
    rank, each once; cycles end where they close. One worker holds a tree's class bases."""
    named = bases.select(*[F.col(c).alias(c) for c in bases.columns])  # both may come from one table; its columns mustn't be mixed up
    return asked.groupBy("tree").cogroup(named.groupBy("tree")).applyInArrow(_ancestors_of_tree, "tree string, module string, cls string, anc_module string, anc_name string, rank int")


def wide_ancestors(asked: DataFrame, bases: DataFrame) -> DataFrame:
    """``ancestors`` by rounds of joins, for trees whose class bases don't fit a worker.

    ``rank`` is the path of base places by which an ancestor is met first, so it orders them as a queue would; shorter
    paths come first. Cycles end where they close. Rounds are as many as the deepest hierarchy.
    """
    front = asked.select("tree", "module", "cls", F.col("module").alias("anc_module"), F.col("cls").alias("anc_name"), F.array().cast("array<int>").alias("rank")).distinct()
    seen = written(front, "ancestors")
    parts, front = [seen], seen
    step = bases.select("tree", F.col("module").alias("anc_module"), F.col("name").alias("anc_name"), "at", "base_module", "base_name")
    key = ["tree", "module", "cls", "anc_module", "anc_name"]
    while True:
        nxt = front.join(step, ["tree", "anc_module", "anc_name"]).select("tree", "module", "cls", F.col("base_module").alias("anc_module"), F.col("base_name").alias("anc_name"), F.concat("rank", F.array("at")).alias("rank"))
        nxt = nxt.groupBy(*key).agg(F.min("rank").alias("rank")).join(seen.select(*key), key, "left_anti")
        front = written(nxt.select(*seen.columns), "ancestors")
        if front.isEmpty():
            forget(front)
            return seen
        parts.append(front)
        seen = seen.union(front)


# ---- calls ------------------------------------------------------------------------------------------------------------------


def resolve_calls(parsed: DataFrame) -> DataFrame:
    """``calls`` with kind (project, external, unresolved), target (a node id) and label (a class that is made, or a package)."""
    owned = written(owned_imports(parsed), "imports")
    c = calls(parsed).filter("root IS NOT NULL")
    own_method = F.col("root").isin("self", "cls") & F.col("cls").isNotNull()
    c = c.join(owned.select("tree", "module", F.col("name").alias("root"), "origin", "owner"), ["tree", "module", "root"], "left")
    ours, bare = F.col("owner").isNotNull(), F.col("attr") == F.col("root")
    whole = ours & (F.col("origin") == F.col("owner"))
    part = F.expr("substring(origin, length(owner) + 2)")
    local = F.col("origin").isNull()
    # where to look: a function by its name, a method of a class or its ancestors, a class
    place = F.when(own_method | local, F.col("module")).otherwise(F.col("owner"))
    by_name = F.when(own_method, None).when(whole, F.col("attr")).when(ours & bare, part).when(local & bare, F.col("root"))
    by_class = F.when(own_method, F.col("cls")).when(whole, None).when(ours & ~bare, part).when(local & ~bare, F.col("root"))
    made = F.when(own_method, None).when(whole, F.col("attr")).when(ours, part).when(local & bare, F.col("root"))
    c = c.withColumns({"place": place, "by_name": by_name, "by_class": by_class, "made": made, "ours": ours}).drop("owner")
    c = written(c, "places")
    # names alone, written, so that their real size decides how they are joined
    fs = written(functions(parsed).select("tree", "module", "qualname", "cls", "name", "node_id"), "names")
    asked = c.filter("by_class IS NOT NULL").select("tree", F.col("place").alias("module"), F.col("by_class").alias("cls"), "attr").distinct()
    line = ancestors(asked.select("tree", "module", "cls").distinct(), class_bases(parsed, owned))
    methods = fs.filter("cls IS NOT NULL").select("tree", F.col("module").alias("anc_module"), F.col("cls").alias("anc_name"), F.col("name").alias("attr"), "node_id")
    met = asked.join(line, ["tree", "module", "cls"]).join(methods, ["tree", "anc_module", "anc_name", "attr"])
    met = met.groupBy("tree", "module", "cls", "attr").agg(F.min_by("node_id", "rank").alias("method"))
    c = c.join(fs.select("tree", F.col("module").alias("place"), F.col("qualname").alias("by_name"), F.col("node_id").alias("function")), ["tree", "place", "by_name"], "left")
    c = c.join(met.select("tree", F.col("module").alias("place"), F.col("cls").alias("by_class"), "attr", "method"), ["tree", "place", "by_class", "attr"], "left")
    known = written(classes(parsed).select("tree", F.col("module").alias("place"), F.col("name").alias("made"), F.lit(True).alias("is_class")).distinct(), "classes")
    c = c.join(known, ["tree", "place", "made"], "left")
    target = F.coalesce("function", "method")
    outside = ~own_method & F.col("origin").isNotNull() & ~F.col("ours") & ~is_plumbing(F.col("origin"), F.col("dotted"), F.col("root"))
    kind = F.when(target.isNotNull() | F.col("is_class"), "project").when(outside, "external").otherwise("unresolved")
    label = F.when(target.isNotNull(), None).when(F.col("is_class"), F.col("made")).when(outside, F.substring_index("origin", ".", 1))
    columns = ["tree", "module", "caller", "cls", "call_ordinal", "dotted", "root", "attr", "lineno"]
    found = c.select(*columns, kind.alias("kind"), target.alias("target"), label.alias("label"))
    lost = calls(parsed).filter("root IS NULL").select(*columns, F.lit("unresolved"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return found.union(lost)


def edges(resolved: DataFrame) -> DataFrame:
    """(tree, src, dst, ordinal): distinct project calls between different functions, by their first call."""
    e = resolved.filter("caller IS NOT NULL AND target IS NOT NULL").select("tree", F.concat_ws("::", "module", "caller").alias("src"), F.col("target").alias("dst"), "call_ordinal")
    return e.filter("src != dst").groupBy("tree", "src", "dst").agg(F.min("call_ordinal").alias("ordinal"))


def externals(resolved: DataFrame) -> DataFrame:
    """(tree, node_id, display, label, ordinal): external calls of a function, one a display; the first label stays."""
    e = resolved.filter("caller IS NOT NULL AND kind = 'external'").select("tree", F.concat_ws("::", "module", "caller").alias("node_id"), external_display(F.col("dotted")).alias("display"), "label", "call_ordinal")
    first = e.groupBy("tree", "node_id", "display").agg(F.min(F.struct("call_ordinal", "label")).alias("x"))
    return first.select("tree", "node_id", "display", "x.label", F.col("x.call_ordinal").alias("ordinal"))


def entry_calls(resolved: DataFrame) -> DataFrame:
    """(tree, module, target, ordinal): project functions that main guards call."""
    return resolved.filter("caller IS NULL AND target IS NOT NULL").select("tree", "module", "target", F.col("call_ordinal").alias("ordinal"))
