"""Best-fit packing by length patterns: non-negative least squares on the histogram of lengths.

Documents become pieces of at most ``size`` tokens. The histogram of piece lengths (at most ``size`` numbers, whatever the
data) goes to the driver, which enumerates patterns of two to four lengths that nearly fill a sequence, fits how often each
repeats to the histogram by non-negative least squares (cyclic coordinate descent), rounds down within what is there, and
packs the residual by best fit, longest first, also on the histogram. The plan is a list of runs: the pieces of one length
with ranks [first, first + count) go to sequences base + 0, 1, ... at one offset.

Scale: ranks within a length come from per-task counts and a running sum over tasks, so a length that many pieces share is no
hot group; a piece finds its run by binary search in the plan, whose size depends on ``size`` alone, not on the data. Pieces
are written once to the shared folder.

Defined results: null text is empty: the end id alone; repeated rows are packed like any others; an empty table gives an empty
one; other columns are ignored. A text is held whole while it is encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

#: Patterns tried per length, tokens that a pattern may leave free, and sweeps of the fit.
TRIES, SLACK, SWEEPS = 24, 8, 30


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth), written. ``ids``: unsigned little-endian 32-bit; nth: rank by length within part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            buf, off = C.utf8(batch.column(1))
            raw = buf.tobytes()
            ids = batch.column(0)
            for i in range(0, len(off) - 1, 500):
                rows: list = []
                for k in range(i, min(i + 500, len(off) - 1)):
                    got = np.append(np.frombuffer(encoder.encode(raw[off[k] : off[k + 1]]), encoder.dtype), end_id).astype("<u4")
                    cuts = [0, *range(len(got) % size or size, len(got) + 1, size)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((k, p, a, b - a, got[a:b].tobytes(), int(seen[b - a])))
                        seen[b - a] += 1
                if rows:
                    at, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(rest[0], pa.int32()), pa.array(rest[1], pa.int64()), pa.array(rest[2], pa.int64()), pa.array(rest[3], pa.binary()), pa.array([part] * len(rows), pa.int32()), pa.array(rest[4], pa.int64())], names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, nth bigint")
    return C.written(made, "pieces")


def patterns(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Few-document patterns over lengths that occur, each nearly filling a sequence; deterministic."""
    size = len(histogram) - 1
    there = np.flatnonzero(histogram > 0)
    there = there[there > 0]
    if not len(there):
        return []
    below = np.zeros(size + 1, np.int64)  # the greatest length that occurs, up to each number
    below[there] = there
    below = np.maximum.accumulate(below)
    rng = np.random.default_rng(0)
    mass = np.cumsum(histogram[there])
    found: set = set()
    if histogram[size]:
        found.add((size,))
    for a in there[there < size].tolist():
        for t in range(TRIES):
            parts, left = [a], size - a
            for _ in range(t % 3):
                options = int(np.searchsorted(there, left, "right"))
                if not options:
                    break
                pick = int(there[np.searchsorted(mass, rng.random() * mass[options - 1], "right")]) if t % 2 else int(there[rng.integers(options)])
                parts.append(pick)
                left -= pick
            if left and below[left]:
                parts.append(int(below[left]))
                left -= int(below[left])
            if left <= SLACK:
                found.add(tuple(sorted(parts, reverse=True)))
    return sorted(found, reverse=True)


def fit(histogram: np.ndarray, tried: list[tuple[int, ...]]) -> np.ndarray:
    """How often each pattern repeats: least squares to the histogram, not negative, by cyclic coordinate descent."""
    rest = histogram.astype(np.float64).tolist()
    columns = [[(n, p.count(n)) for n in set(p)] for p in tried]
    norms = [sum(c * c for _, c in col) for col in columns]
    x = [0.0] * len(tried)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, col in enumerate(columns):
            new = x[j] + sum(rest[n] * c for n, c in col) / norms[j]
            if new < 0.0:
                new = 0.0
            step = new - x[j]
            if step:
                x[j] = new
                for n, c in col:
                    rest[n] -= c * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def plan(histogram: np.ndarray) -> tuple[np.ndarray, int]:
    """Runs (length, first, count, base, offset), ordered by length and first, and the number of sequences."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(size + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, count: int, base: int, offset: int) -> None:
        runs.append((length, int(taken[length]), count, base, offset))
        taken[length] += count
        left[length] -= count

    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (base, count)
    tried = patterns(histogram)
    repeats = fit(histogram, tried)
    for j in np.argsort(-repeats, kind="stable").tolist():
        pattern = tried[j]
        times = min([int(repeats[j] + 0.5), *(int(left[n]) // pattern.count(n) for n in set(pattern))])
        if times > 0:
            offset = 0
            for n in pattern:
                place(n, times, sequences, offset)
                offset += n
            if offset < size:
                free.setdefault(size - offset, []).append((sequences, times))
            sequences += times
    for length in range(size, 0, -1):
        rooms = sorted(r for r in free if r >= length)
        while left[length] and rooms:
            room = rooms[0]
            base, count = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(0)
            use = min(count, int(left[length]))
            if use < count:
                free.setdefault(room, []).append((base + use, count - use))
            place(length, use, base, size - room)
            if room > length:
                free.setdefault(room - length, []).append((base, use))
                if room - length >= length:
                    rooms = sorted(r for r in free if r >= length)
        if left[length]:
            each = size // length
            for count, full in ((int(left[length]) // each, each), (1, int(left[length]) % each)):
                if count and full:
                    for k in range(full):
                        place(length, count, sequences, k * length)
                    if size - full * length:
                        free.setdefault(size - full * length, []).append((sequences, count))
                    sequences += count
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


def assign(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces`` (any of its columns, but length, part and nth); those two go."""
    counts = C.written(cut.groupBy("length", "part").count(), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for n, c in counts.groupBy("length").agg(F.sum("count")).collect():  # at most ``size`` rows
        histogram[n] = c
    runs, _ = plan(histogram)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("nth")).drop("_base", "part", "nth")
    top = int(histogram.max(initial=0)) + 1
    keys = runs[:, 0] * top + runs[:, 1]
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * top + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset), one row a piece."""
    return assign(pieces(docs, tokenizer, end_id, size), size)


