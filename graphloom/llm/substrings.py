"""Exact substring dedup: every byte covered by a 50-byte string that also starts in a document of a smaller id.

Equal texts are reduced to one first. Every 50-byte string has an anchor, the 24-byte string of least hash within it, so equal
strings share their anchor at the same place. Anchors that occur in one text only are left out (their hashes are compared by
hash bucket, in numpy arrays). Each anchor left gives its context: 26 bytes before it and 50 from it on. Contexts meet in
their anchor's bucket. There the strings that begin 0 to 13 and 14 to 26 bytes before the anchor are matched apart: each half
has a core, the bytes that all its strings have, and contexts whose core no other id has are left out. The bytes after the
cores are laid out, in no order, as one text of 64-bit symbols (the core's number, then seven bytes and their number each), and
so are those before, read backwards; the grouping construction of ``gsaca`` gives the suffix order of each. A 50-byte string that
begins j bytes before its anchor is a run of the left order with common prefixes up to j bytes and a run of the right order with
50 - j: equal pairs of runs are equal strings, byte for byte, and all but the least document's go.

Scale: texts are shuffled once (to find the one that stands for its copies) and written as blocks; after that only hash
arrays, contexts of repeated anchors and cuts move. What a block needs back (which anchors repeat, what to cut) is
written as a file a block in the shared folder, under another name and renamed, equal on every attempt. Contexts that several
documents of a block share are cut within the block and sent once. An anchor with ``HOT_BLOCKS`` times ``HOT_EACH`` places or more
isn't gathered: each of its 50-byte strings is sent to a bucket by its own hash. Buckets are of equal expected size, one a
partition, and grow in number with the blocks, to 65,536.

Defined results: null text is empty; rows with a null id keep all and cut nothing; rows that repeat an id don't cut each
other; of rows with equal texts the least id stands, the others lose all if they have 50 bytes; equal rows (id and text) are
one and each gets its result; other columns are ignored; an empty table gives an empty one. Memory: a block (``BLOCK_BYTES``, or the longest
text) of bytes and its anchors, with contexts made and sent ``PORTION`` at a time; or a bucket's contexts, of which the suffix order
takes ``MOST`` at a time, in whole cores (a larger core is halved again, at last to single strings).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .gsaca import suffix_array

LENGTH, GRAM = 50, 24
LEFT = LENGTH - GRAM
#: Bytes that one symbol of the suffix order holds, beside their number.
SYMBOL = 7
BLOCK_BYTES = 4_000_000
#: An anchor with so many blocks times so many places or more counts as hot; the most buckets.
HOT_BLOCKS, HOT_EACH, MOST_BUCKETS = 256, 512, 1 << 16
#: Contexts that are made at a time, and that one suffix order takes.
PORTION, MOST = 1 << 15, 1 << 14


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        a, done = best(a[:-done], a[done:]), done * 2
    return best(a[: len(a) - (width - done)], a[width - done :]) if width > done else a


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, 64-bit hash) of every anchor of a slice: a gram that is the least of some 50-byte string within a document."""
    windows = len(buf) - LENGTH + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = C.rolling(buf, GRAM)
    width = LENGTH - GRAM + 1
    least = _slide(h, width, np.minimum)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    least[doc[:windows] != doc[LENGTH - 1 :]] = 0
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    return at, C.mix(h[at] ^ np.uint64(0xA5A5A5A55A5A5A5A))  # least hashes are small; mixed again they fill buckets evenly


def _store(root: str, name: str, data: bytes) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{path}/{name}")


def _load(root: str, name: str) -> bytes | None:
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{path}/{name}").type == pyarrow.fs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of equal first column, of batches sorted by it."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != key[i]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def blocks(unique: DataFrame) -> DataFrame:
    """(block, ids, off, data) of (doc_id, text): whole texts of about ``BLOCK_BYTES`` together, as byte strings, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([off.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())], names=["block", "ids", "off", "data"])

        for batch in batches:
            buf, off = C.utf8(batch.column(1))
            for k, d in enumerate(batch.column(0).to_pylist()):
                ids.append(d)
                texts.append(buf[off[k] : off[k + 1]].tobytes())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield made()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield made()

    return C.written(unique.select("doc_id", "text").mapInArrow(run, "block bigint, ids binary, off binary, data binary"), "blocks", "zstd")


def _opened(batch: pa.RecordBatch, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    ids, off, data = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, np.int64), (2, np.int64), (3, np.uint8)))
    return batch.column(0)[k].as_py(), ids, off, data


def _all_anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, document) over a block."""
    at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in C.slices(off):
        p, x = anchors(data[off[i] : off[j]], off[i : j + 1] - off[i])
        at.append(p + off[i])
        h.append(x)
    place = np.concatenate(at)
    return place, np.concatenate(h), np.searchsorted(off, place, "right") - 1


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, whether in several documents, number of places)."""
    order = np.argsort(h, kind="stable")
    s, d = h[order], doc[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    if not len(first):
        return s, np.zeros(0, bool), first
    return s[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.append(first, len(s)))


def repeated(blocked: DataFrame, buckets: int, root: str) -> int:
    """Writes, a file a block, a byte for each of its distinct anchor hashes in order: 0 if it occurs in one text, 1 if in
    several, 2 if it is hot.

    Hashes are compared by bucket (leading bits) and 32 bits more; a chance match only costs a context. Places are counted a
    block by the next power of two, less one.
    """
    shift = np.uint64(64 - buckets.bit_length() + 1)
    hot = HOT_BLOCKS * HOT_EACH

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, _, off, data = _opened(batch, k)
                _, h, doc = _all_anchors(data, off)
                s, several, places = _distinct(h, doc)
                several = np.frexp(places)[1].astype(np.uint8) * np.uint8(2) + several  # the places' bits, and whether in several documents
                bucket = (s >> shift).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                short = (s >> (shift - np.uint64(32))).astype(np.uint32)
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([short[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), pa.array([several[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary())], names=["bucket", "block", "short", "several"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("short")]
            several = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("several")])
            short = np.concatenate(parts)
            order = np.argsort(short, kind="stable")
            s = short[order]
            same = s[1:] == s[:-1]
            many = several & np.uint8(1)
            many[order[1:][same]] = 1
            many[order[:-1][same]] = 1
            first = np.flatnonzero(np.append(True, ~same)) if len(s) else np.zeros(0, np.int64)
            holders = np.diff(np.append(first, len(s)))
            places = np.add.reduceat((1 << (several[order] >> 1).astype(np.int64)) - 1, first) if len(s) else first
            many[order[np.repeat((holders > 1) & (places >= hot), holders)]] = 2
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield pa.RecordBatch.from_arrays([rows.column("block").combine_chunks(), pa.array([bucket] * len(parts), pa.int32()), pa.array([many[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["block", "bucket", "many"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches):
            order = np.argsort(rows.column("bucket").to_numpy(), kind="stable")
            many = rows.column("many").to_pylist()
            _store(root, f"many-{block}", b"".join(many[k] for k in order))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], names=["block"])

    offered = blocked.mapInArrow(offer, "bucket int, block bigint, short binary, several binary")
    compared = offered.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "block bigint, bucket int, many binary")
    return compared.repartition("block").sortWithinPartitions("block").mapInArrow(keep, "block bigint").count()


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h *= C._MUL
        h += rows[:, k]
        h += np.uint64(1)
    return C.mix(h)


def _alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each kind, which kind each row is) of equal byte rows, in no useful order. Hashes are checked by the rows."""
    _, first, inverse = np.unique(_row_hash(rows), return_index=True, return_inverse=True)
    if (rows[first][inverse] == rows).all():
        return first, inverse
    _, first, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0], return_index=True, return_inverse=True)  # two kinds share a hash
    return first, inverse


def _windows(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which anchor, place) of every 50-byte string around these anchors."""
    low, high = np.maximum(0, LENGTH - right), left  # bytes before the anchor
    n = np.maximum(high - low + 1, 0)
    context = np.repeat(np.arange(len(place)), n)
    return context, place[context] - np.repeat(high, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def contexts(blocked: DataFrame, buckets: int, root: str) -> DataFrame:
    """(bucket, block, ids, doc, place, left, right, near) as arrays, of the repeated anchors of each block, by portions.

    Of contexts that are equal within a portion, that of the least id is sent; the others' cuts are written to ``own-<block>``.
    """
    shift = np.uint64(64 - buckets.bit_length() + 1)
    kinds = {"ids": np.int64, "doc": np.int32, "place": np.int64, "left": np.uint8, "right": np.uint8, "near": np.uint8}
    portion = PORTION

    def made(block: int, ids: np.ndarray, off: np.ndarray, around: np.ndarray, place: np.ndarray, h: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
        """(what is cut within the portion, what is sent)."""
        order = np.lexsort((place, ids[doc], h))
        place, h, doc, left, right = (x[order] for x in (place, h, doc, left, right))
        near = around[place]
        at = np.arange(-LEFT, LENGTH)[None, :]
        near[(at < -left[:, None]) | (at >= right[:, None])] = 0
        first, inverse = _alike(np.concatenate([near, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], 1))
        least = np.full(len(first), len(place))
        np.minimum.at(least, inverse, np.arange(len(place)))
        held = least[inverse]  # the first of equal contexts, which has the least id; equal ids are sent too
        again = np.flatnonzero((ids[doc] > ids[doc[held]]) & (left + right >= LENGTH))
        spans = np.stack([doc[again].astype(np.int64), place[again] - off[doc[again]] - left[again], place[again] - off[doc[again]] + right[again]], 1)
        sent = np.flatnonzero((ids[doc] == ids[doc[held]]) & (left + right >= LENGTH))
        place, h, doc, left, right, near = (x[sent] for x in (place, h, doc, left, right, near))
        used, edges = np.unique((h >> shift).astype(np.int64), return_index=True)
        edges = np.append(edges, len(h))
        columns: dict = {c: [] for c in kinds}
        for i, j in zip(edges, edges[1:]):
            for c, v in (("ids", ids[doc[i:j]]), ("doc", doc[i:j]), ("place", place[i:j] - off[doc[i:j]]), ("left", left[i:j]), ("right", right[i:j]), ("near", near[i:j])):
                columns[c].append(np.ascontiguousarray(v, kinds[c]).tobytes())
        return spans, pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), *(pa.array(columns[c], pa.binary()) for c in kinds)], names=["bucket", "block", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, ids, off, data = _opened(batch, k)
                flags = _load(root, f"many-{block}")
                if flags is None:
                    continue
                place, h, doc = _all_anchors(data, off)
                kind = np.frombuffer(flags, np.uint8)[np.searchsorted(_distinct(h, doc)[0], h)]
                order = np.argsort(h, kind="stable")  # equal anchors meet in a portion
                order = order[kind[order] > 0]
                place, h, doc, kind = (x[order] for x in (place, h, doc, kind))
                left = np.minimum(place - off[doc], LEFT)
                right = np.minimum(off[doc + 1] - place, LENGTH)
                around = sliding_window_view(np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)]), LEFT + LENGTH)
                spans = []
                plain, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
                for i in range(0, len(plain), portion):
                    at = plain[i : i + portion]
                    own, rows = made(block, ids, off, around, place[at], h[at], doc[at], left[at], right[at])
                    spans.append(own.tobytes())
                    yield rows
                few = max(1, portion // (LEFT + 1))
                for i in range(0, len(hot), few):
                    at = hot[i : i + few]
                    context, begin = _windows(place[at], left[at], right[at])
                    own, rows = made(block, ids, off, around, begin, _row_hash(around[begin][:, LEFT:]), doc[at][context], np.zeros(len(begin), np.int64), np.full(len(begin), LENGTH))
                    spans.append(own.tobytes())
                    yield rows
                _store(root, f"own-{block}", b"".join(spans))

    return blocked.mapInArrow(run, "bucket int, block bigint, " + ", ".join(f"{c} binary" for c in kinds))


def ordered(rows: np.ndarray, sizes: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row, bytes that each place of the order shares with the place before, 0 first) of byte rows of these sizes.

    Rows of different cores share -1. The different rows, as they come, are one text of symbols, a row's core first; their order
    is that of the suffixes which begin with a row.
    """
    n, width = rows.shape
    words = -(-width // SYMBOL)
    padded = np.zeros((n, words * SYMBOL), np.uint8)
    padded[:, :width] = rows
    padded[np.arange(words * SYMBOL)[None, :] >= sizes[:, None]] = 0
    first, inverse = _alike(np.concatenate([padded, sizes[:, None].astype(np.uint8), core.astype(np.uint32)[:, None].view(np.uint8)], 1))
    kinds, length, core = padded[first], sizes[first], core[first]
    symbols = np.zeros((len(first), words + 1, 8), np.uint8)
    symbols[:, 0] = core.astype(">u8")[:, None].view(np.uint8)
    symbols[:, 1:, :SYMBOL] = kinds.reshape(len(first), words, SYMBOL)
    symbols[:, 1:, SYMBOL] = np.clip(length[:, None] - np.arange(words)[None, :] * SYMBOL, 0, SYMBOL)
    order = suffix_array(symbols.reshape(len(first), -1).view(">u8").astype(np.uint64).ravel())
    order = order[order % (words + 1) == 0] // (words + 1)
    a, b = kinds[order[:-1]], kinds[order[1:]]
    differ = np.append(a != b, np.ones((len(a), 1), bool), 1)
    common = np.minimum(differ.argmax(1), np.minimum(length[order[:-1]], length[order[1:]]))
    common[core[order[:-1]] != core[order[1:]]] = -1
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[inverse], np.concatenate([[0], common]).astype(np.int64)


def _parts(ids: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, at: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(contexts, low, high): those of ``at`` whose core several ids have, in whole cores, ``MOST`` at a time.

    The core is what all 50-byte strings have that begin low to high bytes before the anchor. One with more contexts is halved.
    """
    at = at[(left[at] >= low) & (right[at] >= LENGTH - high)]
    if len(at) < 2:
        return
    h = _row_hash(near[at, LEFT - low : LEFT + LENGTH - high])
    by = np.argsort(h, kind="stable")
    at, h = at[by], h[by]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    several = np.minimum.reduceat(ids[at], first) < np.maximum.reduceat(ids[at], first)
    large = several & (size > MOST) & (low < high)
    if large.any():
        halves, middle = at[np.repeat(large, size)], (low + high) // 2
        yield from _parts(ids, left, right, near, halves, low, middle)
        yield from _parts(ids, left, right, near, halves, middle + 1, high)
    held = several & ~large
    at, size = at[np.repeat(held, size)], size[held]
    ends = np.cumsum(size)
    i = begin = 0
    while i < len(size):
        i = max(i + 1, int(np.searchsorted(ends, begin + MOST, "right")))
        yield at[begin : ends[i - 1]], low, high
        begin = int(ends[i - 1])


def matches(ids: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(greatest, least) number of bytes before the anchor at which a 50-byte string repeats one of a smaller id; -1: none.

    Between the two, every such string repeats one as well or is covered by those that do.
    """
    n, middle = len(ids), LEFT // 2
    far, close = np.full(n, -1), np.full(n, LENGTH)
    for part in ((0, middle), (middle + 1, LEFT)):
        for at, low, high in _parts(ids, left, right, near, np.arange(n), *part):
            _matched(ids, left, right, near, at, low, high, far, close)
    return far, np.where(far < 0, -1, close)


def _matched(ids: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray, at: np.ndarray, low: int, high: int, far: np.ndarray, close: np.ndarray) -> None:
    """Widens ``far`` and ``close`` by the strings of the contexts ``at`` that begin low to high bytes before the anchor."""
    ids, left, right, near = (x[at] for x in (ids, left, right, near))
    _, core = _alike(near[:, LEFT - low : LEFT + LENGTH - high])
    after, after_common = ordered(near[:, LEFT + LENGTH - high : LEFT + LENGTH - low], np.minimum(right - LENGTH + high, high - low), core)
    before, before_common = ordered(near[:, LEFT - high : LEFT - low][:, ::-1], np.minimum(left, high) - low, core)
    for j in range(low, high + 1):
        ok = np.flatnonzero((left >= j) & (right >= LENGTH - j))
        if not len(ok):
            continue
        run = np.cumsum(after_common < high - j)[after[ok]]
        several = np.bincount(run)[run] > 1
        ok, run = ok[several], run[several]
        if not len(ok):
            continue
        lead = np.cumsum(before_common < j - low)[before[ok]]
        key = run * (lead.max() + 1) + lead
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        least = np.repeat(np.minimum.reduceat(ids[ok][by], first), np.diff(np.append(first, len(by))))
        hit = at[ok[by[least < ids[ok][by]]]]
        far[hit] = np.maximum(far[hit], j)
        close[hit] = np.minimum(close[hit], j)


def cuts(found: DataFrame, buckets: int, root: str) -> int:
    """Writes, a file a block, what to cut: (document in block, begin, end) as 64-bit integers; their union counts."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows.column(c)])  # noqa: B023, E731
            ids, doc, place, left, right = (read(c, t) for c, t in (("ids", np.int64), ("doc", np.int32), ("place", np.int64), ("left", np.uint8), ("right", np.uint8)))
            sizes = [len(x.as_buffer()) // 8 for x in rows.column("ids")]
            block = np.repeat(rows.column("block").to_numpy(), sizes)
            far, close = matches(ids, left.astype(np.int64), right.astype(np.int64), read("near", np.uint8).reshape(-1, LEFT + LENGTH))
            hit = np.flatnonzero(far >= 0)
            hit = hit[np.argsort(block[hit], kind="stable")]
            spans = np.stack([doc[hit].astype(np.int64), place[hit] - far[hit], place[hit] - close[hit] + LENGTH], 1)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block[hit])) + 1, [len(hit)]]) if len(hit) else [0]
            yield pa.RecordBatch.from_arrays([pa.array([block[hit][i] for i in edges[:-1]], pa.int64()), pa.array([spans[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())], names=["block", "spans"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches):
            spans = np.frombuffer(b"".join(rows.column("spans").to_pylist()), np.int64).reshape(-1, 3)
            _store(root, f"cut-{block}", spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], names=["block"])

    gathered = found.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(match, "block bigint, spans binary")
    return gathered.repartition("block").sortWithinPartitions("block").mapInArrow(keep, "block bigint").count()


def _kept(blocked: DataFrame, root: str, as_text: bool) -> DataFrame:
    """(doc_id, source_key, kept, n_bytes, n_removed, n_spans): ``kept`` has the bytes left, ``source_key`` the MD5 of all.

    As text, a character that a cut splits is left out. A block goes out by slices, so that no more than one of them is held twice.
    """

    def made(ids: np.ndarray, off: np.ndarray, data: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, off[doc] + begin, 1)
        np.add.at(step, off[doc] + end, -1)
        gone = np.cumsum(step[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = off[:-1][off[:-1] < off[1:]]
        begins[starts] = gone[starts]
        total = np.concatenate([[0], np.cumsum(gone)])
        runs = np.concatenate([[0], np.cumsum(begins)])
        texts = [data[a:b] for a, b in zip(off, off[1:])]
        left = [t[~gone[a:b]].tobytes() if total[b] > total[a] else t.tobytes() for t, a, b in zip(texts, off, off[1:])]
        keys = [hashlib.md5(t.tobytes()).digest() for t in texts]
        kept = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys, pa.binary()), kept, pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), pa.array((runs[off[1:]] - runs[off[:-1]]).astype(np.int64))], names=["doc_id", "source_key", "kept", "n_bytes", "n_removed", "n_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, ids, off, data = _opened(batch, k)
                raw = (_load(root, f"cut-{block}") or b"") + (_load(root, f"own-{block}") or b"")
                spans = np.frombuffer(raw, np.int64).reshape(-1, 3)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                for i, j in C.slices(off):
                    cut = spans[np.searchsorted(spans[:, 0], i) : np.searchsorted(spans[:, 0], j)]
                    yield made(ids[i:j], off[i : j + 1] - off[i], data[off[i] : off[j]], cut[:, 0] - i, cut[:, 1], cut[:, 2])

    return blocked.mapInArrow(run, f"doc_id bigint, source_key binary, kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stand, others). ``stand``: (doc_id, source_key, kept, n_bytes, n_removed, n_spans) of each text's least id.
    ``others``: (doc_id, source_key, text, times) of the rest: the rows of larger or null ids, and how often the row is there
    (a row of ``stand`` that is there more often has the rest of its times here, marked ``again``)."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("source_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = C.written(d.groupBy("doc_id", "source_key").agg(F.count("*").alias("times")), "rows")
    least = rows.filter("doc_id IS NOT NULL").groupBy("source_key").agg(F.min("doc_id").alias("doc_id"))
    marked = rows.join(least.select("source_key", F.col("doc_id").alias("least")), "source_key", "left")
    stands = marked.filter("doc_id = least").select("doc_id", "source_key", "times")
    unique = d.join(stands.select("doc_id", "source_key"), ["doc_id", "source_key"], "left_semi").dropDuplicates(["doc_id", "source_key"])
    blocked = blocks(unique)
    C.release(spark)
    n = blocked.select("block").count()
    buckets = min(MOST_BUCKETS, 1 << max(4, (max(n, 1) // 2).bit_length()))
    root = C.new_path(spark, "repeats")
    repeated(blocked, buckets, root)
    C.release(spark)
    cuts(contexts(blocked, buckets, root), buckets, root)
    others = marked.withColumn("again", F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False))).filter("NOT again OR times > 1")
    return _kept(blocked, root, as_text), others.select("doc_id", "source_key", "least", "again", "times")
