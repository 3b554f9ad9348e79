"""Text of docstrings, comments and readmes: what a file or function says it is for.

Plain functions on strings, used inside the parser and on their own, and columns of the same (``licence``,
``first_sentence_of``, ``purpose_of``), which know ASCII white space only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Any of these makes a text a licence notice rather than a purpose.
LICENCE_MARKERS = tuple("©|all rights reserved|copyright|licensed under|permission is hereby granted|redistribution and use in source|spdx-license-identifier|this program is free software".split("|"))

_TITLE_MARKS = "=-`:'\"~^_*+#<>"
_RULE_MARKS = frozenset("=-*_~+#")
_SENTENCE_END = re.compile(r"(?<![A-Z])[.!?](?=\s|$)")


def is_rule(line: str) -> bool:
    """Is it three or more of one title mark, and nothing else?"""
    mark = line.strip()
    return len(mark) > 2 and mark[0] in _TITLE_MARKS and mark == mark[0] * len(mark)


def without_title(text: str) -> str:
    """Leading underlined (and overlined) titles and rules go, however many there are."""
    left = text.strip().splitlines()
    at = 0
    while at < len(left):
        if not left[at].strip():
            at += 1
        elif is_rule(left[at]):
            at += 1
        elif at + 1 < len(left) and is_rule(left[at + 1]):
            at += 2
        else:
            break
    return "\n".join(left[at:]).strip()


def first_sentence(text: str | None) -> str | None:
    """The first sentence of the first paragraph on one line, without its full stop; none of an empty one."""
    head = " ".join(without_title(text).split("\n\n", 1)[0].split()) if text else ""
    end = _SENTENCE_END.search(head)
    return (head[: end.end()] if end else head).rstrip(".") or None


def is_licence(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in LICENCE_MARKERS)


def licence(text: Column) -> Column:
    """``is_licence`` as a column expression; null for null."""
    low = F.lower(text)
    out = F.lit(False)
    for m in LICENCE_MARKERS:
        out = out | low.contains(m)
    return out


def module_purpose(doc: str | None) -> str | None:
    """The summary of a module's docstring: one licence paragraph may be passed over, and it must have a letter."""
    notices = 0
    for paragraph in without_title(doc).split("\n\n") if doc else ():
        said = first_sentence(paragraph)
        if not said:
            continue
        if not is_licence(said):
            return said if any(map(str.isalpha, said)) else None
        notices += 1
        if notices == 2:
            break
    return None


def header_comment(source: str) -> str | None:
    """The first sentence of the comment block that a file begins with; machinery (interpreter, coding, inline metadata,
    rules) is passed over, and a licence is none."""
    said: list[str] = []
    metadata = False
    for raw in source.splitlines():
        line = raw.strip()
        if not line.startswith("#"):
            if said or line:
                break
            continue
        words = line.lstrip("#").strip()
        if line[:2] == "#!" or words[:3] == "-*-" or "coding:" in words:
            continue
        if words[:3] == "///":
            metadata = not metadata
        elif not metadata and not (words and _RULE_MARKS.issuperset(words)):
            said.append(words)
    text = " ".join(filter(None, said))
    return first_sentence(text) if text and not is_licence(text) else None


def readme_purpose(text: str) -> str | None:
    """The first paragraph of a readme that isn't a title, badge or markup."""
    for paragraph in map(str.strip, text.split("\n\n")):
        if paragraph and paragraph[0] not in "#=<" and paragraph[:2] != "[!":
            return first_sentence(paragraph)
    return None


# ---- as columns -----------------------------------------------------------------------------------------------------------------

_SPACE = " \t\n\r\f\v"
_GAP = re.compile(f"[{_SPACE}]+")
_RULE_LINE = re.compile(r"[ \t\r\f\v]*([=\-`:'\"~^_*+#<>])\1{2,}[ \t\r\f\v]*")
_END = re.compile(f"(?<![A-Z])[.!?](?=[{_SPACE}]|\\Z)")


def _untitled(text: str) -> str:
    """``without_title`` for ASCII white space; reads no line after the first that stays."""
    text = text.strip(_SPACE)
    size = len(text)
    line_end = lambda at: size if (end := text.find("\n", at)) < 0 else end
    at = 0
    while at < size:
        end = line_end(at)
        if text[at:end].strip(_SPACE) and not _RULE_LINE.fullmatch(text, at, end):
            below = end + 1
            if below >= size or not _RULE_LINE.fullmatch(text, below, end := line_end(below)):
                break
        at = end + 1
    return text[at:]


def _sentence(text: str) -> str | None:
    head = _untitled(text).split("\n\n", 1)[0].strip(_SPACE)
    end = _END.search(head)
    return _GAP.sub(" ", head[: end.end()] if end else head).rstrip(".") or None


def _purpose(doc: str) -> str | None:
    doc = _untitled(doc)
    at = notices = 0
    while at <= len(doc) and notices < 2:
        end = len(doc) if (end := doc.find("\n\n", at)) < 0 else end
        said = _sentence(doc[at:end])
        if said and not is_licence(said):
            return said if any(map(str.isalpha, said)) else None
        notices += said is not None
        at = end + 2
    return None


def _each(f: Callable[[str], str | None], texts: pa.Array) -> pa.Array:
    # bytes, since a text that isn't UTF-8 must not end the query
    found = (None if (t := x.as_py()) is None else f(t.decode("utf-8", "replace")) for x in texts.cast(pa.binary()))
    return pa.array(found, pa.string())


# In workers, since a text is read once there and only as far as its answer needs. As expressions, every line and paragraph made
# the list of all lines again.


def _sentences(texts: pa.Array) -> pa.Array:
    return _each(_sentence, texts)


def _purposes(docs: pa.Array) -> pa.Array:
    return _each(_purpose, docs)


def first_sentence_of(text: Column) -> Column:
    """``first_sentence``; null for null."""
    return F.arrow_udf(_sentences, StringType())(text)


def purpose_of(doc: Column) -> Column:
    """``module_purpose``; null for null."""
    return F.arrow_udf(_purposes, StringType())(doc)
