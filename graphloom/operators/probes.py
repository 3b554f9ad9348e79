"""Measures of whole trees, and runs of external calls against the phases that authors name by comments.

``profile`` gives one row a tree. ``phases`` parses files once more, for comments; ``runs`` groups resolved external calls;
``named_runs`` brings both together.
"""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.prose import first_sentence, is_licence
from graphloom.operators import kernels as K
from graphloom.plans.tree import Row
from graphloom.sources.trees import read_text

GAP, RUN_LINES, FUNCTION_LINES, LABEL_CHARS = 3, 3, 30, 52
_PRAGMAS = tuple("fmt: mypy: noqa pragma: pylint: ruff: type:".split())
_ASIDES = tuple("--|fixme|hack|http://|https://|nb:|note:|reference|see http|see:|todo|xxx".split("|"))
STOPWORDS = tuple("a an and for in of the to up value with".split())
_ENUMS = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


# ---- one file ---------------------------------------------------------------------------------------------------------------


def quiet_parse(source: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def era(source: str) -> dict | None:
    """Age of a file as written: is its head comment a licence, is its docstring, and classes that are enums by a local base."""
    tree = quiet_parse(source)
    if tree is None:
        return None
    head = []
    for line in map(str.strip, source.splitlines()):
        if not line.startswith("#"):
            if line or head:
                break
            continue
        head.append(line.lstrip("#").strip())
    doc = ast.get_docstring(tree)
    last = lambda c: {ast.unparse(b).rpartition(".")[2] for b in c.bases}
    tops = [n for n in tree.body if isinstance(n, ast.ClassDef)]
    enums = {c.name for c in tops if last(c) & _ENUMS}
    return {"banner": is_licence(" ".join(head)), "doc_licence": bool(doc) and is_licence(first_sentence(doc.split("\n\n")[0]) or ""), "local_enums": sum(bool(last(c) & enums) for c in tops)}


def own_line_comments(source: str) -> dict[int, str]:
    """Comments on lines of their own, by line; none of a file that can't be split into tokens."""
    out = {}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for t in tokenize.generate_tokens(io.StringIO(source).readline):
                text = t.string.lstrip("#").strip() if t.type == tokenize.COMMENT and t.line.lstrip()[:1] == "#" else ""
                if text and not text.startswith(_PRAGMAS):
                    out[t.start[0]] = text
    except (tokenize.TokenError, SyntaxError):
        return {}
    return out


def is_heading(comment: str) -> bool:
    low = comment.lower()
    return len(comment) <= LABEL_CHARS and not low.startswith(_ASIDES) and "http" not in low and not comment.endswith(":")


def comment_phases(node: ast.AST, comments: dict[int, str], blanks: set[int]) -> list[dict]:
    """Stretches of a long function's top level that a single-line comment heads; a blank line or the next heading ends one."""
    body = node.body
    if node.end_lineno - node.lineno < FUNCTION_LINES or len(body) < 2:
        return []
    heads = []
    for k, s in enumerate(body):
        above = body[k - 1].end_lineno if k else node.lineno
        said = [comments[n] for n in range(above + 1, s.lineno) if n in comments]
        if len(said) == 1 and is_heading(said[0]):
            heads.append((k, said[0]))
    out = []
    for (k, label), (stop, _) in zip(heads, [*heads[1:], (len(body), "")]):
        last = k
        while last + 1 < stop and blanks.isdisjoint(range(body[last].end_lineno + 1, body[last + 1].lineno)):
            last += 1
        out.append({"label": label, "start": body[k].lineno, "end": body[last].end_lineno})
    return out


def file_phases(source: str) -> list[dict]:
    tree = quiet_parse(source)
    if tree is None:
        return []
    comments = own_line_comments(source)
    blanks = {n for n, line in enumerate(source.splitlines(), 1) if not line.strip()}
    found = {}  # of functions with one name that end on one line, the last walked counts
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found[f.name, f.end_lineno] = comment_phases(f, comments, blanks)
    return [{"name": n, "end_lineno": e} | p for (n, e), ps in found.items() for p in ps]


def _per_file(sources: DataFrame, measure: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """Rows that ``measure`` makes of each file's text, with tree and path; unreadable files give none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = "tree string, path string, " + schema
    arrow = to_arrow_schema(sources.sparkSession.createDataFrame([], whole).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    raw = Path(r["path"]).read_bytes() if r["content"] is None else r["content"]
                except OSError:
                    continue
                rows += [{"tree": r["tree"], "path": r["path"]} | x for x in measure(read_text(raw))]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return sources.select("tree", "path", "content").mapInArrow(run, whole)


def eras(sources: DataFrame) -> DataFrame:
    return _per_file(sources, lambda s: [x] if (x := era(s)) else [], "banner boolean, doc_licence boolean, local_enums int")


def phases(sources: DataFrame) -> DataFrame:
    return _per_file(sources, file_phases, "name string, end_lineno int, label string, start int, end int")


# ---- trees ------------------------------------------------------------------------------------------------------------------


def profile(code_map) -> DataFrame:
    """One row a tree: sizes, parts in percent, medians, and the age of its files."""
    f, p = code_map.functions, code_map.parsed
    full = p.filter(F.size("funcs") > 0)
    modules = full.groupBy("tree").agg(F.count("*").alias("mod"), percent(F.count_if(F.col("doc").isNotNull() | F.col("header_comment").isNotNull()), F.count("*")).alias("mdoc"))
    of_functions = f.groupBy("tree").agg(F.count("*").alias("fn"), percent(F.count_if(F.col("cls").isNotNull()), F.count("*")).alias("meth"), percent(F.count_if(F.size("decorators") > 0), F.count("*")).alias("deco"), F.median("n_branches").alias("brmed"), F.median("loc").alias("locmed"))
    of_calls = code_map.calls.filter("caller IS NOT NULL").groupBy("tree").agg(percent(F.count_if(F.col("kind") == "unresolved"), F.count("*")).alias("unres"))
    age = eras(code_map.sources).groupBy("tree").agg(percent(F.count_if("banner"), F.count("*")).alias("ban"), percent(F.count_if("doc_licence"), F.count("*")).alias("doclic"), F.sum("local_enums").alias("lenum"))
    out = p.select("tree").distinct()
    for part in (modules, of_functions, of_calls, age):
        out = out.join(part, "tree", "left")
    return out.na.fill(0)


def profile_table(rows: list[dict]) -> str:
    """The profile as text, a line a tree."""
    names = ("mod", "fn", "meth", "mdoc", "unres", "deco", "brmed", "locmed", "ban", "doclic", "lenum")
    head = f"{'target':<12}" + "".join(f"{n:>8}" for n in names)
    return "\n".join([head, *(f"{r['tree']:<12}" + "".join(f"{r[n]:>8.0f}" for n in names) for r in rows)])


def runs(calls: DataFrame) -> DataFrame:
    """(tree, module, caller, run, start, last, lines, calls): external calls of a function with at most ``GAP`` lines between
    neighbours, on ``RUN_LINES`` different lines or more."""
    c = calls.filter("kind = 'external' AND caller IS NOT NULL")
    r = K.islands(c, ["tree", "module", "caller"], F.col("lineno"), [F.col("lineno"), F.col("call_ordinal")], GAP)
    r = r.groupBy("tree", "module", "caller", F.col("island").alias("run")).agg(F.min("lineno").alias("start"), F.max("lineno").alias("last"), F.countDistinct("lineno").alias("lines"), F.count("*").alias("calls"))
    return r.filter(F.col("lines") >= RUN_LINES)


def words(text: Column) -> Column:
    """Different words of the last dotted part, split at marks and where capitals begin, without stop words."""
    split = F.split(F.lower(F.regexp_replace(F.substring_index(text, ".", -1), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_except(F.array_distinct(F.filter(split, lambda w: w != "")), F.array(*map(F.lit, STOPWORDS)))


def restatement(name: Column, label: Column) -> Column:
    """The part of a name's words that a label gives back."""
    own = words(name)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, words(label))).cast("double"), F.size(own)), F.lit(0.0))


def named_runs(code_map) -> DataFrame:
    """``runs`` of functions over ``FUNCTION_LINES`` with the author's heading of the phase they begin in, if there is one, how
    much of the function they span, and how much of its name the heading gives back."""
    f = code_map.functions.filter(F.col("end_lineno") - F.col("lineno") >= FUNCTION_LINES).select("tree", "module", "path", F.col("qualname").alias("caller"), "name", "lineno", "end_lineno")
    r = runs(code_map.calls).join(f, ["tree", "module", "caller"])
    key = ["tree", "path", "name", "end_lineno"]
    p = phases(code_map.sources).withColumnsRenamed({"start": "phase_start", "end": "phase_end", "label": "author"})
    named = K.first_interval(r.select(*key, "run", "start"), p.select(*key, "phase_start", "phase_end"), [*key], "start", "phase_start", "phase_end")
    out = r.join(named.select(*key, "run", "phase_start"), [*key, "run"], "left").join(p.select(*key, "phase_start", "author"), [*key, "phase_start"], "left")
    span = F.greatest(F.col("end_lineno") - F.col("lineno"), F.lit(1))
    return out.select("tree", "module", "caller", "run", "start", "last", "lines", "calls", "author", ((F.col("last") - F.col("start") + 1) / span).alias("coverage"), restatement(F.col("caller"), F.col("author")).alias("restates"))


def tree_text(row: Row, marked: set[str], depth: int = 0) -> list[str]:
    """The rows below one as indented text, those with a label of ``marked`` marked."""
    out = []
    for r in row.below:
        bracket = f"  [{r.bracket}]" if r.bracket else ""
        out.append(f"{'>>' if r.label in marked else '  '} {'    ' * depth}{r.label}{bracket}")
        out += tree_text(r, marked, depth + 1)
    return out


# ---- asking a model about runs ------------------------------------------------------------------------------------------------

NAME_RUN = """These lines are consecutive calls in the Python function `{function}` of {module}, lines {start} to {last}, with their surroundings:

```python
{source}
```

Give the run a heading of at most five words, as one would comment a block. If it is the function's actual work, not its
preparation, bookkeeping, logging or cleaning up, say NONE."""

KEEP_RUN = """In the function below, lines {start} to {last} would be replaced by the heading "{label}" in a summary.

```python
{source}
```

Say KEEP if they are one phase of several and the heading names it, DROP if they are what the function is for. One word."""

KEEP_ROWS = """A map shows the function `{function}` by these rows; those marked >> would be replaced by one row, "{label}":

{tree}

Say KEEP if a reader still learns what the function does, DROP if something needed is hidden. One word."""


def excerpt(path: str, start: int, last: int, pad: int = 2) -> str:
    """Lines of a file with ``pad`` lines around; nothing of a file that can't be read."""
    try:
        lines = Path(path).read_text(errors="replace").splitlines()
    except OSError:
        return ""
    return "\n".join(lines[max(start - pad - 1, 0) : last + pad])


def whole_function(path: str, lineno: int, end_lineno: int, most: int = 6000) -> str:
    return excerpt(path, lineno, end_lineno, 0)[:most]


def function_tree(project, function, labels: set[str], lines: int = 60) -> str:
    """The rows under a function, three levels deep, those of ``labels`` marked."""
    from graphloom.plans.tree import Grower

    row = Grower(project, depth_cap=3).grow(function)
    return "\n".join([f"   {function.qualname}({', '.join(function.args[:3])})", *tree_text(row, labels)[:lines]])


def reply_line(raw: str | None) -> str:
    text = (raw or "").strip()
    return text.splitlines()[0].strip().strip("\"'`").rstrip(".") if text else ""


def collect(code_map, calibrate: bool = False) -> DataFrame:
    """Runs to ask about: those that no author named, or to calibrate by, those that one did."""
    named = F.col("author").isNotNull()
    return named_runs(code_map).filter(named if calibrate else ~named)


def ask_runs(runs: list[dict], ask: Callable[[str], str | None], two_stage: bool = False, source: Callable = excerpt) -> list[dict]:
    """Each run (a row of ``collect`` with its function's path) with the model's heading, null where it declines, and the verdict on it.

    Errors of the model are the answer of their run. With ``two_stage`` a heading that gets DROP counts as declined."""
    out = []
    for r in runs:
        facts = {"function": r["caller"], "module": r["module"], "start": r["start"], "last": r["last"]}
        try:
            label = reply_line(ask(NAME_RUN.format(**facts, source=source(r["path"], r["start"], r["last"]))))
            declined = not label or label.upper() == "NONE"
            verdict = None
            if two_stage and not declined:
                verdict = reply_line(ask(KEEP_RUN.format(start=r["start"], last=r["last"], label=label, source=source(r["path"], r["start"], r["last"])))).upper()[:4]
            out.append(r | {"label": None if declined or verdict == "DROP" else label, "verdict": verdict, "error": None})
        except (OSError, ValueError) as e:
            out.append(r | {"label": None, "verdict": None, "error": str(e)})
    return out
