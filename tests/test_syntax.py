"""What the parser takes from one file, and texts that say what it is for."""

import ast
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import prose, syntax
from graphloom.operators import probes
from graphloom.sources import manifests, trees


@pytest.mark.parametrize(
    "written, short",
    [("int", "int"), ("Optional[List[Tuple[str, float]]]", "[(str, float)]?"), ("t.Dict[str, int]", "{str: int}"), ("Dict[str]", "Dict[str]"), ("set[a.B]", "{B}"), ("Union[A, None, 'C']", "A|None|C"), ("A | B", "A|B"), ("Callable[..., int]", "Callable[..., int]"), ("Tuple[int, ...]", "(int, ...)"), ("Literal[1]", "Literal[1]"), ("None", "None"), ("x[1:2]", "x[1:2]")],
)
def test_types(written, short):
    assert syntax.short_type(ast.parse(written, mode="eval").body) == short


@pytest.mark.parametrize(
    "value, shape",
    [("re.compile('x')", "regex"), ("os.path.join(a)", "join(...)"), ("[1]", "[int]"), ("[]", "[]"), ("(x,)", "(?)"), ("{1, 2}", "{int}"), ("{}", "{}"), ("{Kind.A: 'x'}", "{Kind: str}"), ("{**a}", "{?: ?}"), ("f'{x}'", "str"), ("mod.x", None), ("_Kind.A", "_Kind"), ("None", "NoneType"), ("x", None), ("1 + 1", None)],
)
def test_shapes(value, shape):
    assert syntax.value_shape(ast.parse(value, mode="eval").body) == shape


def parse(source, module="pkg.mod", package=False):
    return syntax.parse_module(source, module, package)


def test_measures():
    m = parse('def f(a, /, self, *b, c=1, **d):\n    "Says it. And more"\n    for x in [y for y in a if y]:\n        try:\n            g(h(x)).k()\n        except E:\n            return {"p": 1, "q": 2, **x}\n    z = 1 if a else 2\n    def inner():\n        while z:\n            m.n.o("two words")\n    return {"p": 3}\n')
    (f,) = m["funcs"]
    assert (f["args"], f["doc"], f["loc"], f["returns_keys"]) == (["a", "c"], "Says it", 12, ["p", "q"])
    # for, comprehension, try, handler, conditional, while; for, comprehension, while
    # two texts with spaces, the docstring taken off
    assert (f["n_branches"], f["n_loops"], f["n_ternaries"], f["n_strings"]) == (6, 3, 1, 1)
    assert [(c["dotted"], c["root"]) for c in f["calls"]] == [("k", None), ("g", "g"), ("h", "h"), ("m.n.o", "m")]
    assert parse('def f():\n    "x"\n')["funcs"][0]["n_stmts"] == 0


def test_one_function_a_name():
    m = parse("class C:\n    @overload\n    def f(self): a(); b(); c()\n    @t.overload\n    def f(self): d()\n    def f(self): e()\n    @property\n    def p(self): return self.q()\n    @p.setter\n    def p(self, v):\n        self.q()\n        log(v)\n\ndef g(): one()\ndef g(): two()\n")
    got = [(f["qualname"], [c["dotted"] for c in f["calls"]]) for f in m["funcs"]]
    assert got == [("C.f", ["e", "a", "b", "c", "d"]), ("C.p", ["self.q", "log"]), ("g", ["two", "one"])]
    assert m["classes"][0]["methods"] == ["C.f", "C.p"]


def test_imports_and_relative_names():
    source = "import a.b, c.d as e\nfrom . import x\nfrom ..up import y as z\nfrom .sub.deep import *\ntry:\n    from fast import f\nexcept ImportError:\n    from slow import f\nif T:\n    import q\nelse:\n    import r\ndef g():\n    import hidden\n"
    table = {i["name"]: i["origin"] for i in parse(source, "pkg.sub.mod")["imports"]}
    assert table == {"a": "a", "e": "c.d", "x": "pkg.sub.x", "z": "pkg.up.y", "f": "slow.f", "q": "q", "r": "r"}
    assert syntax.absolute_module("pkg", 1, "m", True) == "pkg.m" and syntax.absolute_module("pkg.m", 1, None, False) == "pkg" and syntax.absolute_module("m", 3, "n", False) == "n"


def test_classes_and_constants():
    m = parse("class A(Enum): pass\nclass B(A):\n    X = 1\nclass C(m.B): pass\n@dataclasses.dataclass\nclass D(A):\n    n: int\n    n: str\nclass E(NamedTuple): pass\nclass P(typing.Protocol): pass\nclass I:\n    k = {}\n    def __init__(self):\n        self.a = self.k = []\nLOUD = quiet = 1\nsoft: str = 'x'\nif __name__ == '__main__':\n    run()\n")
    assert [(c["name"], c["kind"]) for c in m["classes"]] == [("A", "enum"), ("B", "enum"), ("C", "enum"), ("D", "dataclass"), ("E", "namedtuple"), ("P", "protocol"), ("I", "class")]
    assert [x["shape"] for x in m["classes"][3]["fields"]] == ["int", "str"]
    assert [(x["name"], x["shape"]) for x in m["classes"][6]["fields"]] == [("k", "{}"), ("a", "[]")]
    assert [(c["name"], c["shape"]) for c in m["constants"]] == [("LOUD", "int"), ("soft", "str")]
    assert [c["dotted"] for c in m["main_calls"]] == ["run"]


@pytest.mark.parametrize("source", ["def f(:\n", "x = '\0'", "(" * 400 + ")" * 400, "a" + ".b" * 20000])
def test_broken_files_are_told_not_raised(source):
    m = parse(source)
    assert m["funcs"] == [] and (m["parse_error"] or source.startswith("a"))


TEXTS = [
    ("Parse it. Then stop.", "Parse it"), ("By J. Smith for all! Yes.", "By J. Smith for all!"), ("name\n~~~~\n\nThe summary\nof it", "The summary of it"), ("====\nname\n====\nSaid.", "Said"), ("", None), (None, None), ("...", None), ("v1.2 is out", "v1.2 is out"), ("-- --\nx", "-- -- x"),
    ("\n\n  one  two \n three.\n\nfour", "one two three"), ("----\n----\n\n....", None), ("A?B? C", "A?B? C"), ("a?b? C", "a?b?"),
]


@pytest.mark.parametrize("text, said", TEXTS)
def test_first_sentence(text, said):
    assert prose.first_sentence(text) == said


PURPOSES = [
    ("Copyright 2006 Foo.\n\nParse the file.", "Parse the file"), ("Copyright (c) X.\n\nRedistribution and use in source are fine.\n\n1. Do so", None), ("1.2", None), ("Copyright 1.", None), ("Reads it.\n\nCopyright 1", "Reads it"), (None, None), ("\n", None), ("© me", None),
]


@pytest.mark.parametrize("doc, said", PURPOSES)
def test_purpose(doc, said):
    assert prose.module_purpose(doc) == said


def test_texts_as_columns(spark):
    texts = [t for t, _ in TEXTS] + [d for d, _ in PURPOSES] + ["-----\n" * 3000 + "Late. Yes", "word " * 30000 + ". x"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in d.select("t", prose.first_sentence_of(F.col("t")).alias("s"), prose.purpose_of(F.col("t")).alias("p"), prose.licence(F.col("t")).alias("l")).collect():
        assert (r["s"], r["p"], r["l"]) == (prose.first_sentence(r["t"]), prose.module_purpose(r["t"]), r["t"] and prose.is_licence(r["t"]) if r["t"] != "" else False)


def test_long_texts_as_columns(spark):
    """A text costs what is read for its answer, not its lines times their number."""
    texts = ["\n\n".join(["Copyright 1."] + [f"Part {k}.\nIt has a line.\n====" for k in range(5000)]), "Title\n=====\n\nSay it\u2028again. Then \x85 stop.\n" + "line\n" * 20000, "\n\n".join(["..."] * 20000 + ["At last."])]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(1)
    began = time.time()
    got = [(r["s"], r["p"]) for r in d.select("k", prose.first_sentence_of(F.col("t")).alias("s"), prose.purpose_of(F.col("t")).alias("p")).orderBy("k").collect()]
    assert got == [("Copyright 1", "Part 0"), ("Say it\u2028again",) * 2, (None, "At last")]
    assert time.time() - began < 20
    raw = spark.createDataFrame([(bytearray(b"A \xff b. C"),)], "b binary").select(prose.purpose_of(F.expr("CAST(b AS string)")).alias("p"))
    assert raw.first()["p"] == "A \ufffd b"


@pytest.mark.parametrize(
    "source, said",
    [("#!/bin/x\n# -*- coding: utf-8 -*-\n# ------\n# Helps a lot.\n# Really.\n\n# no\n", "Helps a lot"), ("# /// script\n# deps\n# ///\n\n# Purpose here\nx", "Purpose here"), ("# Copyright 1\n# Helps", None), ("x = 1\n# no", None), ("\n\n#\n# yes", "yes"), ("", None)],
)
def test_header_comment(source, said):
    assert prose.header_comment(source) == said


def test_manifests(tmp_path):
    assert manifests.setup_cfg_scripts("[options.entry_points]\nconsole_scripts = a = %(x)s\n") == []
    assert manifests.pyproject_scripts("project = 3") == manifests.pyproject_scripts("[project\n") == manifests.setup_py_scripts("def (:") == []
    assert manifests.setup_py_scripts("E = {'console_scripts': 'a = m:f'}\nE = other()\nsetup(entry_points=E)") == ["m:f"]
    low = tmp_path / "src" / "pkg"
    low.mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    (tmp_path / "setup.py").write_text("setup(entry_points={'console_scripts': ['x = pkg:run']})")
    (tmp_path / "src" / "pyproject.toml").write_bytes(b"[project]\nname = '\xff'\n")
    assert manifests.declared_entries(low) == ["pkg:run"] and [d.name for d in manifests.directories(low)] == ["pkg", "src", tmp_path.name]
    (low / "README").write_text("# T\n\n<b>\n\nIt is. Good")
    assert manifests.readme(low) == "It is" and manifests.readme(tmp_path) is None


def test_trees_on_disk(spark, tmp_path):
    files = {"src/pkg/__init__.py": "", "src/pkg/_private.py": "def f(): pass\n", "src/pkg/sub/__init__.py": "", "src/pkg/sub/deep.py": "x = 1\n", "src/pkg/data/a.py": "", "tool.py": "# caf\xe9\n", ".hidden/x.py": "", "venv/y.py": "", "notes.txt": ""}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    sources, projects = trees.scan(spark, {"t": tmp_path})
    got = [(r["module"], r["path"].removeprefix(str(tmp_path.resolve()) + "/")) for r in sources.orderBy("module_ordinal").collect()]
    assert got == [("tool", "tool.py"), ("pkg", "src/pkg/__init__.py"), ("pkg._private", "src/pkg/_private.py"), ("src.pkg.data.a", "src/pkg/data/a.py"), ("pkg.sub", "src/pkg/sub/__init__.py"), ("pkg.sub.deep", "src/pkg/sub/deep.py")]
    in_memory, _ = trees.from_files(spark, [("t", n, t) for n, t in files.items()])
    assert [r["module"] for r in in_memory.orderBy("module_ordinal").collect()] == [m for m, _ in got]
    one, _ = trees.scan(spark, {"one": tmp_path / "src/pkg/sub/deep.py"})
    assert [r["module"] for r in one.collect()] == ["pkg.sub.deep"]
    assert trees.read_text(b"# -*- coding: latin-1 -*-\n\xe9\r\n") == "# -*- coding: latin-1 -*-\n\xe9\n" and trees.read_text(b"\xe9") == "\ufffd" and trees.read_text(b"# coding: nonsense\nx") == "# coding: nonsense\nx"


def test_phases_and_age():
    body = "\n".join(f"    x{k} = {k}" for k in range(30))
    source = f"def f():\n    # set up\n    a()\n    b()\n\n    c()\n    # two\n    # lines\n    d()\n    # see: that\n    e()\n    # finish\n    g()\n{body}\n"
    assert probes.file_phases(source) == [{"name": "f", "end_lineno": 43, "label": "set up", "start": 3, "end": 4}, {"name": "f", "end_lineno": 43, "label": "finish", "start": 13, "end": 43}]
    assert probes.own_line_comments("x = 1  # no\n# noqa\n# yes\n") == {3: "yes"} and probes.own_line_comments("(\n") == {}
    assert probes.era("# Copyright me\n\nclass A(Enum): pass\nclass B(A): pass\n") == {"banner": True, "doc_licence": False, "local_enums": 1}
    assert probes.era('"""All rights reserved. x"""\n')["doc_licence"] and probes.era("(") is None
