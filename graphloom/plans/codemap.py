"""Code maps of source trees: sources -> parsed -> resolved -> annotated -> planned -> page.

``CodeMap`` holds one DataFrame a stage, each for all trees at once, and plans every tree in a worker of its own. Stages are
built when they are first asked for.
"""

from __future__ import annotations

import gc
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.operators import ranking, resolution
from graphloom.operators.store import written
from graphloom.plans import page, tree
from graphloom.sources import trees

_ROW = "struct<block:int,row:int,parent:int,level:int,label:string,node_id:string,returns:string,marker:string,bracket:string,repeat:boolean,note:string>"
_BLOCK = "struct<block:int,title:string,purpose:string,spanning:boolean,lines:int>"
PLANNED = f"tree string, strategy string, spine array<string>, entries array<string>, roles array<struct<node_id:string,role:string>>, blocks array<{_BLOCK}>, rows array<{_ROW}>, omitted_modules int, omitted_tests int, markdown string, state string, stats string"


def project_of(modules: list[dict], functions: list[dict]) -> tree.Project:
    """The records of one tree as the plan takes them: rows of ``CodeMap.module_rows`` and ``CodeMap.function_rows``."""
    own: dict[str, list[tree.Function]] = {}
    fields = tree.Function.__dataclass_fields__
    for f in sorted(functions, key=lambda f: f["func_ordinal"]):
        own.setdefault(f["module"], []).append(tree.Function(**{k: f[k] for k in fields if k != "calls"}, calls=sorted(f["calls"] or [], key=lambda c: c["call_ordinal"])))
    made = [tree.Module(m["module"], m["path"], m["doc"], m["header_comment"], m["parse_error"], m["imports"] or [], m["classes"] or [], m["constants"] or [], own.get(m["module"], [])) for m in sorted(modules, key=lambda m: m["module_ordinal"])]
    first = modules[0] if modules else {}
    return tree.Project(made, first.get("root"), first.get("readme"), resolution.STDLIB)


def flat_rows(p: tree.Plan) -> list[dict]:
    """Rows of all blocks in the order of the page, each with its parent's place and its level."""
    out: list[dict] = []

    def add(block: int, r: tree.Row, parent: int | None, level: int) -> None:
        at = len(out)
        out.append({"block": block, "row": at, "parent": parent, "level": level, "label": r.label, "node_id": r.func.node_id if r.func else None, "returns": r.returns, "marker": r.marker, "bracket": r.bracket, "repeat": r.repeat, "note": r.note})
        for x in r.below:
            add(block, x, at, level + 1)

    for k, b in enumerate(p.blocks):
        for root in b.roots:
            add(k, root, None, 0)
    return out


class CodeMap:
    """A map of every tree of ``sources`` (see ``sources.trees``). ``notes`` (tree, node_id, note) hang under their functions' rows."""

    def __init__(self, sources: DataFrame, projects: DataFrame, notes: DataFrame | None = None):
        self.sources, self.projects, self.notes = sources, projects, notes

    @classmethod
    def scan(cls, spark: SparkSession, targets: dict[str, str | Path]) -> CodeMap:
        return cls(*trees.scan(spark, targets))

    @classmethod
    def from_files(cls, spark: SparkSession, files) -> CodeMap:
        return cls(*trees.from_files(spark, files))

    def with_notes(self, notes: DataFrame) -> CodeMap:
        """The same map with notes; what is parsed and resolved is kept."""
        out = CodeMap(self.sources, self.projects, notes)
        for stage in ("parsed", "calls"):
            if stage in self.__dict__:
                out.__dict__[stage] = self.__dict__[stage]
        return out

    @cached_property
    def parsed(self) -> DataFrame:
        return resolution.parse(self.sources)

    @cached_property
    def calls(self) -> DataFrame:
        return written(resolution.resolve_calls(self.parsed), "calls")

    @property
    def functions(self) -> DataFrame:
        return resolution.functions(self.parsed)

    @property
    def edges(self) -> DataFrame:
        return resolution.edges(self.calls)

    @property
    def externals(self) -> DataFrame:
        return resolution.externals(self.calls)

    @cached_property
    def scored(self) -> DataFrame:
        declared = ranking.declared_functions(self.projects, self.parsed.select("tree", "module", "module_ordinal"), self.functions, resolution.imports(self.parsed).join(self.projects.filter(F.size("declared") > 0).select("tree"), "tree", "left_semi"))
        return written(ranking.annotate(self.functions.drop("calls"), self.edges, declared, resolution.entry_calls(self.calls)), "scored")

    @property
    def module_rows(self) -> DataFrame:
        m = self.parsed.select("tree", "module", "path", "module_ordinal", "doc", "header_comment", "parse_error", "imports", "classes", "constants")
        return m.join(self.projects.select("tree", "root", "readme"), "tree", "left")

    @property
    def function_rows(self) -> DataFrame:
        shown = F.struct("call_ordinal", "dotted", "lineno", "kind", "target", "label")
        c = self.calls.filter("caller IS NOT NULL AND kind != 'unresolved'").groupBy("tree", F.concat_ws("::", "module", "caller").alias("node_id")).agg(F.collect_list(shown).alias("calls"))
        f = self.scored.join(c, ["tree", "node_id"], "left")
        f = f.join(self.notes.select("tree", "node_id", "note"), ["tree", "node_id"], "left") if self.notes is not None else f.withColumn("note", F.lit(None).cast("string"))
        names = [n for n in tree.Function.__dataclass_fields__]
        return f.select("tree", "func_ordinal", *names)

    def planned(self, max_lines: int = 40, kind: str | None = None, base: str | None = None, state: bool = False) -> DataFrame:
        """One row a tree: the plan, its rows flattened, the page as markdown and, if asked for, the state behind it as JSON.

        ``kind``: app, lib, test, or null for what the tree shows. ``base``: what paths are given relative to, else the tree's root.
        """
        schema = to_arrow_schema(self.sources.sparkSession.createDataFrame([], PLANNED).schema)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            gc.disable()  # millions of small records without cycles
            project = project_of(left.to_pylist(), right.to_pylist())
            gc.enable()
            p = tree.plan(project, max_lines, kind)
            out = {
                "tree": (left if left.num_rows else right).column("tree")[0].as_py(),
                "strategy": p.strategy,
                "spine": [f.node_id for f in p.spine],
                "entries": [f.node_id for f in p.entries],
                "roles": [{"node_id": f.node_id, "role": f.role} for f in project.functions.values()],
                "blocks": [{"block": k, "title": b.title, "purpose": b.purpose, "spanning": b.spanning, "lines": b.lines} for k, b in enumerate(p.blocks)],
                "rows": flat_rows(p),
                "omitted_modules": p.omitted_modules,
                "omitted_tests": p.omitted_tests,
                "markdown": page.render(project, p, base or project.root),
                "state": page.as_json(project, p) if state else None,
                "stats": page.stats(project, p, kind),
            }
            return pa.Table.from_pylist([out], schema)

        return self.module_rows.groupBy("tree").cogroup(self.function_rows.groupBy("tree")).applyInArrow(run, PLANNED)

    def rows(self, **options) -> DataFrame:
        """The rows of the pages, one a row: the relational form of the map."""
        return self.planned(**options).select("tree", F.inline("rows"))

    def page(self, **options) -> DataFrame:
        return self.planned(**options).select("tree", "markdown", "stats")
