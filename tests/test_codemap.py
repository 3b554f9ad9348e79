"""Maps of small trees: resolution, roles, budgets, blocks, pages, notes, the command line."""

import json
import urllib.error

import pytest

from graphloom import cli
from graphloom.operators import notes
from graphloom.operators import ranking, resolution
from graphloom.plans import mapqueries, page, tree
from graphloom.plans.codemap import CodeMap, project_of


@pytest.fixture(scope="module")
def many(spark):
    """Every tree that the tests below look at, mapped at once."""
    wide = "def run(x):\n" + "".join(f"    part_{k}(x)\n" for k in range(30)) + "\n".join(f"\ndef part_{k}(x):\n    for a in x:\n        if a:\n            leaf(a, {k})\n" for k in range(30)) + "\ndef leaf(a, b):\n    if a:\n        if b:\n            if a > b:\n                return 1\n"
    chain = [(f"m{k}.py", (f"from m{k + 1} import step{k + 1}, other{k + 1}\n" if k < 5 else "") + f"def step{k}(x):\n    for a in x:\n        if a:\n" + (f"            step{k + 1}(a)\n            other{k + 1}(a)\n" if k < 5 else "            pass\n") + f"\ndef other{k}(x):\n    while x:\n        x -= 1\n        if x:\n" + (f"            step{k + 1}(x)\n" if k < 5 else "            pass\n")) for k in range(6)]
    files = [("wide", "wide.py", wide), *(("chain", n, t) for n, t in chain), ("chain", "pyproject.toml", '[project.scripts]\nx = "m0:step0"\n'), ("bases", "a.py", "import b\nfrom b import Far as F2\nclass C(Near, b.Far):\n    def go(self):\n        self.one(); self.two(); self.three(); cls.go()\nclass Near(Loop): pass\nclass Loop(Near):\n    def two(self): pass\ndef use(p):\n    F2.one(p); C(); C.two(); p.go(); b.Far(); b.Far.one(); (lambda: 1)().x()\n"), ("bases", "b.py", "class Far:\n    def one(self): pass\n    def two(self): pass\n    def three(self): pass\n"), ("twins", "app.py", "def f(x):\n  for a in x: g(a)\ndef g(x):\n  for a in x: print(a)\n"), ("twins", "sub/app.py", "def f(x):\n  for a in x: pass\n"), ("twins", "sub/tests/test_app.py", "def test_f():\n  pass\n"), ("empty", "nothing.py", "")]
    return CodeMap.from_files(spark, files)


def test_fixture_map_agrees_with_the_worker_alone(spark):
    """Rows of the plan as one worker makes them from the collected tables, so the grouping changes nothing."""
    m = mapqueries.fixture_map(spark)
    project = project_of([r.asDict(True) for r in m.module_rows.filter("tree = 'shop'").collect()], [r.asDict(True) for r in m.function_rows.filter("tree = 'shop'").collect()])
    text = page.render(project, tree.plan(project, 40), project.root)
    assert text == m.planned().filter("tree = 'shop'").first()["markdown"]


def test_bases_and_names(many):
    got = {(r["caller"], r["dotted"]): (r["target"], r["label"]) for r in many.calls.filter("tree = 'bases'").collect()}
    # own bases first, left to right, cycles end
    assert got["C.go", "self.one"][0] == "b::Far.one" and got["C.go", "self.two"][0] == "b::Far.two" and got["C.go", "self.three"][0] == "b::Far.three"
    assert got["C.go", "cls.go"] == ("a::C.go", None) and got["use", "F2.one"][0] == "b::Far.one" and got["use", "C.two"][0] == "b::Far.two"
    assert got["use", "C"] == (None, "C") and got["use", "b.Far"] == (None, "Far") and got["use", "p.go"] == (None, None) and got["use", "x"] == (None, None)
    assert many.edges.filter("tree = 'bases' AND src = dst").count() == 0


def test_ancestors_by_rounds_agree(spark, many):
    """Two ways to the same ancestors in the same order, over random hierarchies with cycles and several trees."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    bases = [(f"t{rng.randint(0, 1)}", "m", f"C{rng.randint(0, 14)}", k, "m", f"C{rng.randint(0, 14)}") for k in range(40)]
    b = spark.createDataFrame(bases, "tree string, module string, name string, at int, base_module string, base_name string")
    asked = spark.createDataFrame([(t, "m", f"C{k}") for t in ("t0", "t1", "t2") for k in range(15)], "tree string, module string, cls string")
    one = {(r["tree"], r["cls"], r["anc_name"]): r["rank"] for r in resolution.ancestors(asked, b).collect()}
    wide = {(r["tree"], r["cls"], r["anc_name"]): (len(r["rank"]), r["rank"]) for r in resolution.wide_ancestors(asked, b).collect()}
    assert one.keys() == wide.keys()
    for key in {k[:2] for k in one}:
        mine = [k for k in one if k[:2] == key]
        assert sorted(mine, key=one.get) == sorted(mine, key=wide.get)


def test_budgets_and_cuts(many):
    p = {r["tree"]: r for r in many.planned(max_lines=40).collect()}
    assert all(b["lines"] <= 40 for r in p.values() for b in r["blocks"] if not b["spanning"])
    few = {r["tree"]: r for r in many.planned(max_lines=6).collect()}
    assert [b["lines"] for b in few["wide"]["blocks"]] == [6] and few["wide"]["rows"][-1]["label"] == "… 28 more"
    assert p["empty"]["markdown"] == "# nothing.py\n\n```\n(nothing to show)\n```\n"
    assert p["bases"]["strategy"] == "single"
    # three modules have functions; the tests are counted, not shown
    assert p["twins"]["strategy"] == "module" and [b["title"] for b in p["twins"]["blocks"]] == ["twins/app.py", "sub/app.py"] and p["twins"]["omitted_tests"] == 1


def test_flow_across_modules(many):
    app, lib, plain = ({r["tree"]: r for r in many.planned(max_lines=40, kind=k).collect()}["chain"] for k in ("app", "lib", None))
    assert app["blocks"][0]["spanning"] and app["blocks"][0]["title"] == "step0() across 6 modules"
    assert not any(b["spanning"] for b in lib["blocks"]) and len(lib["blocks"]) == 6
    assert plain["blocks"][0]["spanning"] == (sum("." in r["label"] and r["node_id"] is None for r in lib["rows"]) >= 10)
    assert [b["title"] for b in lib["blocks"]] == ["m5.py", "m4.py", "m3.py", "m2.py", "m1.py", "m0.py"]
    assert app["omitted_modules"] == 0 and "## Spine to read first" in app["markdown"]


def test_plan_parts():
    leaf = lambda name: tree.Row(name)
    root = tree.Row("r", note="said", below=[leaf("a"), tree.Row("b", below=[leaf(f"b{k}") for k in range(5)]), leaf("c")])
    assert root.lines == 10 and [r.lines for r in tree.leading([leaf("x"), root, leaf("y")], 4)] == [1]
    cut = tree.truncate(root, 7)
    assert cut.lines == 7 and [r.label for r in cut.walk()] == ["r", "a", "b", "b0", "… 4 more", "… 1 more"]
    assert len(list(tree.rungs())) == 96 and list(tree.rungs())[1] == {"no_skim": False, "depth_cap": 6, "external_depth": 99, "notes": "all", "no_repeats": True}
    assert tree.block_titles(["/x/app.py", "/x/sub/app.py", "/x/other.py"]) == {"/x/app.py": "x/app.py", "/x/sub/app.py": "sub/app.py", "/x/other.py": "other.py"}
    assert page.legend("a ★\n b  ~\n") == ["## Legend", "", *(f"- {t}" for m, t in page.MARKS if t[1] in "★~")] and page.legend("f()") == []


def test_state(many):
    r = many.planned(state=True).filter("tree = 'bases'").first()
    state = json.loads(r["state"])
    assert set(state["modules"]) == {"a", "b"} and {f["qualname"] for f in state["modules"]["b"]["funcs"]} == {"Far.one", "Far.two", "Far.three"}
    assert r["stats"] == "2 modules, 6 functions, 1 blocks, strategy=single, type=inferred"


# ---- notes ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, note",
    [("```python\nThis function that Loops over rows and keeps the last one.\n```", "loops over rows and keeps the last one"), ('"Returns early when there is nothing to do"\nmore', "returns early when there is nothing to do"), ("", None), (None, None), ("too short, really", None), ("x" * 91, None), ("Reads all of the lines, " + "y" * 80, None), ("Reads all of the lines in it, " + "y" * 80, "reads all of the lines in it")],
)
def test_replies(raw, note):
    assert notes.clean(raw, 1, 1) == note


def test_replies_as_columns(spark):
    from pyspark.sql import functions as F

    from graphloom.plans.fixtures import REPLIES

    d = spark.createDataFrame(REPLIES, "reply int, text string, n_loops int, n_branches int")
    got = {r["reply"]: r["why"] for r in d.select("reply", notes.rejection(F.col("text"), F.col("n_loops"), F.col("n_branches")).alias("why")).collect()}
    assert got == {k: notes.why_rejected(t, loops, branches) for k, t, loops, branches in REPLIES}


def rows(n):
    return [{"tree": "t", "node_id": f"m::f{k}", "path": f"f{k}", "lineno": 1, "end_lineno": 2, "n_loops": 1, "n_branches": 1} for k in range(n)]


GOOD = "walks the whole list and keeps what is new"


@pytest.mark.parametrize(
    "answers, limit, counts, error",
    [
        ([GOOD] * 9, 3, {"asked": 3, "filled": 3}, None),
        ([TimeoutError(), GOOD, TimeoutError(), TimeoutError(), GOOD], 5, {"asked": 5, "filled": 2, "timed_out": 3}, None),
        ([TimeoutError(), urllib.error.HTTPError("", 500, "", {}, None), urllib.error.URLError(TimeoutError()), GOOD], 5, {"asked": 3, "timed_out": 2, "server_errors": 1}, "failed 3 times in a row"),
        ([GOOD, ConnectionRefusedError("refused"), GOOD], 5, {"asked": 2, "filled": 1}, "refused"),
        ([urllib.error.HTTPError("", 404, "none", {}, None), GOOD], 5, {"asked": 1}, "none"),
        (["no", "", GOOD], 5, {"asked": 3, "filled": 1, "rejected": 2}, None),
    ],
)
def test_filling(answers, limit, counts, error):
    said = iter(answers)

    def ask(source, shape, most):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    got, report = notes.fill(rows(min(9, len(answers))), ask, "m", limit, source=lambda p, a, b: p)
    assert {k: getattr(report, k) for k in counts} == counts and report.error == error and len(got) == report.filled
    assert (report.kept_rate == 0) == (report.filled == 0) and report.summary().startswith("notes: m - ")


def test_filling_from_the_cache_and_skips():
    cache: dict = {}
    asked = []
    ask = lambda s, shape, most: asked.append(s) or GOOD
    source = lambda p, a, b: {"f0": None, "f1": "x" * 6001}.get(p, p)
    _, first = notes.fill(rows(4), ask, "m", 2, cache, source=source)
    _, again = notes.fill(rows(4), ask, "m", 2, cache, source=source)
    assert (first.asked, first.filled, first.oversized) == (2, 2, 1) and (again.cached, again.filled) == (2, 0) and asked == ["f2", "f3"]
    assert notes.content_key("m", "a", "s") != notes.content_key("m", "a", "t") != notes.content_key("m", "a", "t", 80)


def test_models():
    assert notes.choose_model(["a:1b", "qwen2.5-coder:7b", "qwen2.5-coder:32b"]) == "qwen2.5-coder:7b" and notes.choose_model(["a:1b"]) == "a:1b" and notes.choose_model([]) is None
    assert notes.installed_models("http://127.0.0.1:9", 0.2) == []


def test_notes_hang_under_their_rows(many):
    made, report = notes.annotate(many, lambda s, shape, most: GOOD, "m", 3, most_source=10**6)
    assert report.filled == 0  # these files are on no disk
    one = many.sources.sparkSession.createDataFrame([("twins", "app::f", GOOD)], "tree string, node_id string, note string")
    text = many.with_notes(one).planned().filter("tree = 'twins'").first()["markdown"]
    assert GOOD in text


# ---- the command line -----------------------------------------------------------------------------------------------------------


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("def f(x):\n    for a in x:\n        print(a)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (\n")
    out = tmp_path / "map.md"
    assert cli.main([str(tmp_path / "pkg"), "--out", str(out), "--stats"]) == 0
    said = capsys.readouterr().err
    assert "f(x)" in out.read_text() and "1 of 2 files did not parse" in out.read_text() and "skipped" in said and "2 modules, 1 functions" in said
    before = out.read_text()
    assert cli.main([str(tmp_path / "pkg"), "--out", str(out)]) == 2 and out.read_text() == before
    assert cli.main([str(tmp_path / "gone")]) == 2
    (tmp_path / "none").mkdir()
    assert cli.main([str(tmp_path / "none")]) == 1
    a = cli.parser().parse_args(["x", "--draft", "--max-lines", "60"])
    assert cli.budgets(a) == (60, 40) and cli.budgets(cli.parser().parse_args(["x"])) == (40, 12)


def test_constants():
    assert (tree.REACH_DEPTH, tree.MAX_BLOCKS, tree.SPLIT_MODULES, ranking.REACH_DEPTH) == (6, 8, 3, 6) and (page.BRACKET_COLUMN, page.WIDTH, page.BULLETS, page.PACKAGES) == (44, 78, 10, 3)
    assert len(resolution.NOISE) == 8 and len(resolution.PLUMBING) == 13 and ranking.WEIGHTS == {"effective_branches": 0.45, "loc": 0.25, "fan_in": 0.15, "fan_out": 0.15}


# ---- asking about runs ------------------------------------------------------------------------------------------------------------


def test_runs_are_asked_about(spark):
    from graphloom.operators import probes

    m = mapqueries.fixture_map(spark)
    assert probes.collect(m).count() == 0
    runs = [r.asDict() | {"path": "x"} for r in probes.collect(m, True).orderBy("start").collect()]
    answers = iter(["Collect the files.\nmore", "KEEP", "none", TimeoutError("late")])

    def ask(prompt):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    got = probes.ask_runs([*runs, runs[0]], ask, True, source=lambda *a: "code")
    assert [(r["label"], r["verdict"], r["error"]) for r in got] == [("Collect the files", "KEEP", None), (None, None, None), (None, None, "late")]
    project = project_of([r.asDict(True) for r in m.module_rows.filter("tree = 'logs'").collect()], [r.asDict(True) for r in m.function_rows.filter("tree = 'logs'").collect()])
    text = probes.function_tree(project, project.functions["weblog::main"], {"report"})
    assert text.splitlines()[:3] == ["   main()", ">> report", "       … _nice"]
    assert probes.excerpt("/nowhere", 1, 2) == "" and probes.profile_table([{"tree": "t", **dict.fromkeys("mod fn meth mdoc unres deco brmed locmed ban doclic lenum".split(), 1.0)}]).count("\n") == 1
