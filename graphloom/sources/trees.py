"""Source trees as tables: files listed by the driver, read where they are parsed.

Spark's own file sources hide names that begin with an underscore or a dot, which would lose ``__init__.py`` and private
modules, so paths are listed here. Any number of trees go into one table; ``tree`` is part of every key from here on.

``sources``: (tree, path, module, module_ordinal, is_package, content); content is null for files on disk until they are read.
``projects``: (tree, root, readme, declared), one row a tree.
"""

from __future__ import annotations

import io
import os
import tokenize
from collections.abc import Iterable, Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from . import manifests

#: Directories that aren't walked into, beside all that begin with a dot.
SKIPPED = frozenset("venv env __pycache__ node_modules build dist site-packages".split())
SOURCES = "tree string, path string, module string, module_ordinal int, is_package boolean, content binary"
PROJECTS = "tree string, root string, readme string, declared array<string>"


def walk(root: Path) -> Iterator[Path]:
    """Python files below ``root``: sorted, a directory's own before those below it."""
    for at, below, files in os.walk(root):
        below[:] = sorted(d for d in below if d not in SKIPPED and d[0] != ".")
        yield from (Path(at) / f for f in sorted(files) if f.endswith(".py"))


def outside_package(directory: Path, packages=lambda d: (d / "__init__.py").exists()) -> Path:
    """The nearest directory, this one or above, that isn't a package."""
    while packages(directory) and directory.parent != directory:
        directory = directory.parent
    return directory


def module_name(path: PurePosixPath, root: PurePosixPath, packages=lambda d: (d / "__init__.py").exists()) -> str:
    """The name that code which imports the file would write: from its package's root, or from ``root`` if it is in none."""
    base = outside_package(path.parent, packages) if packages(path.parent) else root
    parts = [*path.relative_to(base).parts[:-1], path.stem]
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) or base.name


def read_text(raw: bytes) -> str:
    """Source text by its coding line or mark; what can't be decoded so is UTF-8 with replacements. Line ends become plain ones."""
    try:
        coding, _ = tokenize.detect_encoding(io.BytesIO(raw).readline)
        text = raw.decode(coding)
    except (SyntaxError, UnicodeDecodeError, LookupError):
        text = raw.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def scan(spark: SparkSession, targets: dict[str, str | Path]) -> tuple[DataFrame, DataFrame]:
    """(sources, projects) of trees on disk, by name: directories or single files. Contents aren't read here."""
    rows, projects = [], []
    for tree, target in targets.items():
        at = Path(target).resolve()
        single = at.is_file()
        home = at.parent if single else at
        root = outside_package(home)
        files = [at] if single else list(walk(at))
        last = {module_name(p, root): p for p in files}  # of files with one name the last counts, at the first's place
        rows += [(tree, str(p), m, k, p.name == "__init__.py", None) for k, (m, p) in enumerate(last.items())]
        projects.append((tree, str(home), None if single else manifests.readme(home), manifests.declared_entries(home)))
    # many small files: spread them, since reading and parsing is the work
    made = spark.createDataFrame(rows, SOURCES)
    return made.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "path"), spark.createDataFrame(projects, PROJECTS)


def from_files(spark: SparkSession, files: Iterable[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(sources, projects) of (tree, relative path, text) rows held in memory, as if they lay in ``/<tree>/``.

    Manifests and readmes at the top of a tree are read too.
    """
    trees: dict[str, dict[PurePosixPath, str]] = {}
    for tree, path, text in files:
        trees.setdefault(tree, {})[PurePosixPath("/", tree, path)] = text
    rows, projects = [], []
    for tree, texts in trees.items():
        root = PurePosixPath("/", tree)
        packages = {p.parent for p in texts if p.name == "__init__.py"}
        kept = [p for p in texts if p.suffix == ".py" and not any(d in SKIPPED or d[0] == "." for d in p.relative_to(root).parts[:-1])]
        # as a walk meets them: at every directory first its files, then what is below it
        kept.sort(key=lambda p: [(1, d) for d in p.relative_to(root).parts[:-1]] + [(0, p.name)])
        home = outside_package(root, packages.__contains__)
        last = {module_name(p, home, packages.__contains__): p for p in kept}
        rows += [(tree, str(p), m, k, p.name == "__init__.py", texts[p].encode()) for k, (m, p) in enumerate(last.items())]
        declared = next((found for n, reader in manifests.READERS.items() if (found := reader(texts.get(root / n, "")))), [])
        said = next((texts[root / n] for n in manifests.READMES if root / n in texts), None)
        projects.append((tree, str(root), manifests.readme_purpose(said) if said is not None else None, declared))
    return spark.createDataFrame(rows, SOURCES), spark.createDataFrame(projects, PROJECTS)
