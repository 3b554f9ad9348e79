"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy.

For each length, the characters of all words that lie inside an n-word window found twice or more in the same text are
counted once each (first occurrences included), as are the characters of lines that equal an earlier line. A text is
kept if the base rules hold and no coverage is above its limit.

Defined results: a null or empty text has no words and fails the base rules; all other columns, clashing names included,
pass through unread; repeated rows are judged alike; an empty table gives an empty one. Memory: one slice of whole texts
of about ``SLICE_BYTES``, or the longest text, about 60 bytes a byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Window length in words -> most percent of a text's word characters inside repeated windows.
NGRAM_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
LINE_LIMIT = 30
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 50, 50, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray, lengths: list[int]) -> dict[str, np.ndarray]:
    """All counts of the texts in one slice."""
    n_docs = len(off) - 1
    begin, end, doc = C.words(buf, off)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    word_chars = chars[end] - chars[begin]
    out = {"n_words": C.counts_per(doc, n_docs), "word_chars": C.counts_per(doc, n_docs, word_chars)}
    marks = np.flatnonzero(np.isin(buf, np.frombuffer(b"#*$%&|<>", np.uint8)))
    out["n_symbols"] = C.counts_per(np.searchsorted(off, marks, "right") - 1, n_docs)

    cuts = np.flatnonzero(buf == 10)
    line_end = np.sort(np.concatenate([cuts, off[1:]]))  # an empty text's line is empty and has no word
    line_begin = np.sort(np.concatenate([cuts + 1, off[:-1]]))
    solid = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~C._SPACE[buf], out=solid[1:])
    keep = solid[line_end] > solid[line_begin]
    line_begin, line_end = line_begin[keep], line_end[keep]
    owner = np.searchsorted(off, line_begin, "right") - 1
    keys = C.mix(C.span_hashes(buf, line_begin, line_end) + owner.astype(np.uint64) * C._MUL)
    order = np.argsort(keys, kind="stable")
    later = order[1:][keys[order][1:] == keys[order][:-1]]
    out["n_dup_lines"] = C.counts_per(owner[later], n_docs)
    out["dup_line_chars"] = C.counts_per(owner[later], n_docs, chars[line_end[later]] - chars[line_begin[later]])

    hashes = C.span_hashes(buf, begin, end)
    salt = doc.astype(np.uint64) * C._MUL
    alive = np.arange(len(doc))
    for n in sorted({BASE_WINDOW, *lengths}):
        # the first words of a repeated window are a repeated shorter window, so only those go on
        alive = alive[alive + n <= len(doc)]
        alive = alive[doc[alive] == doc[alive + n - 1]] if len(alive) else alive
        if len(alive):
            alive = alive[_repeated(C.mix(C.rolling(hashes, n)[alive] + salt[alive]))]
        hit = np.flatnonzero(_covered(alive, n, len(doc)))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = C.counts_per(doc[hit], n_docs)
        if n in lengths:
            out[f"dup_{n}_chars"] = C.counts_per(doc[hit], n_docs, word_chars[hit])
    return out


def judge(docs: DataFrame, text: str = "text", limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to each row of ``docs``.

    Of a column that already has one of the new names, in any case, the new values are kept.
    """
    limits = NGRAM_LIMITS if limits is None else limits
    lengths = sorted(limits)
    if min(lengths, default=BASE_WINDOW) < BASE_WINDOW:
        raise ValueError(f"windows have at least {BASE_WINDOW} words")
    names = [*COUNTS, *(f"dup_{n}_chars" for n in lengths)]
    carried = [c for c in docs.columns if c.lower() not in {*names, "base_failed", "kept"}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in carried]).schema), *(f"{n} bigint" for n in names), "base_failed boolean", "kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.utf8(batch.column(text))
            parts = [measure(buf[off[i] : off[j]], off[i : j + 1] - off[i], lengths) for i, j in C.slices(off)]
            got = {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names}
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
            kept = ~failed & (100 * got["dup_line_chars"] <= line_limit * got["word_chars"])
            for n in lengths:
                kept &= 100 * got[f"dup_{n}_chars"] <= limits[n] * got["word_chars"]
            columns = [batch.column(c) for c in carried] + [pa.array(got[n]) for n in names] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, *names, "base_failed", "kept"])

    return docs.select(*[f"`{c}`" for c in carried]).mapInArrow(run, schema)
