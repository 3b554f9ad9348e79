"""``python -m graphloom.cli PATH``: the map of a tree on standard output or in a file."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from graphloom.operators import notes as N
from graphloom.plans.codemap import CodeMap

LINES, DRAFT_LINES, DRAFT_NOTES = 40, 200, 40


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Map a Python source tree.")
    p.add_argument("target", type=Path, help="file or directory")
    p.add_argument("--max-lines", type=int, help=f"lines a block may take ({LINES}; {DRAFT_LINES} with --draft)")
    p.add_argument("--type", dest="kind", choices=["app", "lib", "test"], help="what the tree is; read off it if left out")
    p.add_argument("--base", type=Path, help="directory that paths are given relative to")
    p.add_argument("--out", type=Path, help="file to write")
    p.add_argument("--force", action="store_true", help="overwrite the file")
    p.add_argument("--json", action="store_true", help="the state behind the map")
    p.add_argument("--stats", action="store_true", help="counts on standard error")
    p.add_argument("--draft", action="store_true", help="longer, with more notes")
    p.add_argument("--model", nargs="?", const="auto", default=os.environ.get("GRAPHLOOM_MODEL"), help="model that writes notes; without a name, the best that is installed")
    p.add_argument("--no-llm", action="store_true", help="no notes, whatever else is said")
    p.add_argument("--host", default=N.HOST)
    p.add_argument("--notes-limit", type=int, help=f"questions asked at most ({N.LIMIT}; {DRAFT_NOTES} with --draft)")
    p.add_argument("--note-chars", type=int, default=N.MOST_CHARS)
    p.add_argument("--notes-timeout", type=float, default=N.TIMEOUT)
    p.add_argument("--max-source-chars", type=int, default=N.SOURCE_CHARS)
    p.add_argument("--no-cache", action="store_true", help="ask again for notes that are known")
    return p


def budgets(a: argparse.Namespace) -> tuple[int, int]:
    """(lines, questions): what was asked for, else by draft or not."""
    pick = lambda given, plain, draft: given if given is not None else draft if a.draft else plain
    return pick(a.max_lines, LINES, DRAFT_LINES), pick(a.notes_limit, N.LIMIT, DRAFT_NOTES)


def say(text: str) -> None:
    print(f"graphloom: {text}", file=sys.stderr)


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    lines, questions = budgets(a)
    if not a.target.exists():
        say(f"{a.target} doesn't exist")
        return 2
    if a.out and a.out.exists() and not a.force:  # before any work
        say(f"{a.out} exists; --force overwrites it")
        return 2
    code = CodeMap.scan(session(), {"tree": a.target})
    if code.sources.isEmpty():
        say(f"no Python sources under {a.target}")
        return 1
    options = {"max_lines": lines, "kind": a.kind}
    model = None if a.no_llm else a.model
    report = None
    if model == "auto":
        model = N.choose_model(N.installed_models(a.host))
        say(f"notes from {model}" if model else f"no model at {a.host}; no notes")
    if model:
        path = N.cache_path()
        cache = None if a.no_cache else N.load_cache(path)
        known = dict(cache or {})
        made, report = N.annotate(code, N.Server(model, a.host, a.notes_timeout), model, questions, cache, a.note_chars, a.max_source_chars, **options)
        if cache is not None and cache != known and (wrong := N.save_cache(path, cache)):
            say(f"notes not kept: {wrong}")
        if report.error and not a.stats:
            say(report.summary())
        code = code.with_notes(made)
    row = code.planned(base=str(a.base) if a.base else None, state=a.json, **options).first()
    text = row["state"] + "\n" if a.json else row["markdown"]
    if a.out:
        a.out.write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)
    for r in code.parsed.filter("parse_error IS NOT NULL").select("path", "parse_error").orderBy("path").collect():
        say(f"skipped {r['path']} ({r['parse_error']})")
    if a.stats:
        if report is not None:
            say(report.summary())
        say(row["stats"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
