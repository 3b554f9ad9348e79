"""SimHash near-duplicates with a May-Ozerov search.

Equal texts are first reduced to one. Each different text gets a 128-bit SimHash of its distinct five-word shingles. The search
repeats a recursion: random coordinates are cut into strips of 32; at every level, random centres are drawn, and a
fingerprint goes on with each centre from which its strip differs in at most ``RADIUS`` bits, until the list that it is in is
small; small lists are searched by brute force for distances up to ``DISTANCE``. The first level (two of them from some twenty
million texts on, so that a list fits a task) moves fingerprints to their lists; the levels below go on within the task, as deep
as the list is long and so often that ``INNER`` of the pairs are met. The outer repetitions follow from the target recall for
pairs at the least similarity. All odds are exact binomial ones.

Every hit is verified by the exact Jaccard similarity of the shingle sets (32-bit shingle hashes). Two passes keep this linear
in groups of copies without losing links: the first verifies one hit a text, its nearest earlier neighbour; the classes so
found are sent through the lists again, and every hit between different classes is verified. A link that isn't verified
lies within a class already. Classes are the connected components.

Scale: a list of more than ``CROWD`` fingerprints that can't be made smaller (texts that differ in little) is compared in
blocks in the first pass, and its members all go into the second, which compares only different classes. Lists of more than
``BLOCK`` are split into blocks and pairs of blocks, each a task's. Verification joins pairs to shingle sets of only those texts
that may have a hit.

Defined results: null, empty and blank texts and texts of fewer than five words: the whole words are one shingle; texts
without words have none and are alike only if equal; null texts are alike to nothing; different texts that share an id are
searched like all others. An empty table gives an empty one; other columns are ignored. Memory: a slice of whole texts of
``SLICE_BYTES``, or the longest text, about 150 bytes a byte of it; or ``BLOCK`` fingerprints of 40 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

BITS, STRIP, RADIUS, CENTRES = 128, 32, 10, 40
SHINGLE, SIMILARITY, RECALL, INNER, DISTANCE = 5, 0.8, 0.97, 0.9, 34
#: Lists up to this long are searched by brute force; longer ones that the recursion leaves are compared by blocks of CROWD at first.
SMALL, CROWD = 512, 2048
#: Most members of a list that one task holds.
BLOCK = 1 << 20


def shingles(buf: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document) of every distinct shingle, ordered by document and hash."""
    n_docs = len(off) - 1
    begin, end, doc = C.words(buf, off)
    hashes = C.span_hashes(buf, begin, end)
    n_words = np.bincount(doc, minlength=n_docs)
    long_ = C.rolling(hashes, width)
    at = np.arange(len(long_))
    inside = doc[at] == doc[at + width - 1] if len(at) else np.zeros(0, bool)
    got, owner = [long_[inside]], [doc[at[inside]]]
    first = np.cumsum(n_words) - n_words
    for k in range(1, width):
        few = np.flatnonzero(n_words == k)
        if len(few):
            got.append(C.rolling(hashes, k)[first[few]])
            owner.append(few)
    h, d = np.concatenate(got), np.concatenate(owner)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def fingerprints(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, 2) 64-bit words: sign of the sum, by bit, over a document's shingles; without shingles all zero."""
    out = np.zeros((n_docs, 2), np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    sizes = np.diff(np.append(first, len(doc)))
    for w, seed in enumerate((0x1234567, 0x89ABCDEF)):
        bits = np.unpackbits(C.mix(h ^ np.uint64(seed)).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[doc[first], w] = np.packbits(2 * ones > sizes[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, fp0, fp1), one row a document, written. ``text_key`` is the MD5 of the text, null for null."""
    d = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("text_key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.utf8(batch.column(2))
            counts, marks = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
            for i, j in C.slices(off):
                h, doc = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                counts.append(C.counts_per(doc, j - i))
                marks.append(fingerprints(h, doc, j - i))
            m = np.concatenate(marks).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(counts)), pa.array(m[:, 0].copy()), pa.array(m[:, 1].copy())], names=["doc_id", "text_key", "n_shingles", "fp0", "fp1"])

    return C.written(d.mapInArrow(run, "doc_id bigint, text_key binary, n_shingles bigint, fp0 bigint, fp1 bigint"), "prints")


def flip_rate(similarity: float) -> float:
    """Odds that one bit differs, for two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def pass_rate(q: float, strip: int = STRIP, radius: int = RADIUS, centres: int = CENTRES) -> float:
    """Odds that two strips whose bits differ at rate q share at least one of the centres."""
    odds = lambda n, k, p: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    both = 0.0
    for a in range(radius + 1):  # bits in which the first differs from the centre
        near = sum(odds(a, s, q) * odds(strip - a, g, q) for s in range(a + 1) for g in range(strip - a + 1) if a - s + g <= radius)
        both += odds(strip, a, 0.5) * near
    return 1 - (1 - both) ** centres


def _share() -> float:
    """The part of all fingerprints that is within reach of a centre."""
    return sum(math.comb(STRIP, a) for a in range(RADIUS + 1)) / 2**STRIP


def _repetitions(hit: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


def effort(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(levels whose lists are gathered, repetitions) for n fingerprints."""
    depth = 1
    while n * _share() ** depth > BLOCK / 2 and depth < BITS // STRIP:
        depth += 1
    q = flip_rate(similarity)
    within = sum(math.comb(BITS, d) * q**d * (1 - q) ** (BITS - d) for d in range(DISTANCE + 1))
    return depth, _repetitions(pass_rate(q) ** depth * INNER * within, recall)


def inner_effort(m: int, small: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(levels, repetitions) within a list of m fingerprints."""
    if m <= small:
        return 0, 1
    levels = min(BITS // STRIP, math.ceil(math.log(m / small) / -math.log(_share())))
    return levels, _repetitions(pass_rate(flip_rate(similarity)) ** levels, INNER)


def _lists(bits: np.ndarray, repetition: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) for every list of one repetition that a row of ``bits`` (n, 128) reaches."""
    rng = np.random.default_rng(7919 + repetition)
    coordinates = rng.permutation(BITS)
    row, path = np.arange(len(bits)), np.zeros(len(bits), np.int64)
    for level in range(depth):
        strip = np.ascontiguousarray(np.packbits(bits[:, coordinates[level * STRIP : (level + 1) * STRIP]], axis=1)).view(np.uint32)[:, 0]
        centres = rng.integers(0, 2**STRIP, CENTRES, dtype=np.uint64).astype(np.uint32)
        near = np.bitwise_count(strip[:, None] ^ centres[None, :]) <= RADIUS
        at, centre = np.nonzero(near[row])
        row, path = row[at], path[at] * CENTRES + centre
    return row, path


def listed(items: DataFrame, depth: int, repetitions: int) -> DataFrame:
    """(list, node, fp0, fp1, label): each item (node, fp0, fp1, label) once in every list that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                words = np.stack([batch.column(c).to_numpy() for c in ("fp0", "fp1")], 1).astype(np.int64)
                bits = np.unpackbits(words.view(np.uint8), axis=1)
                rows, ids = [], []
                for r in range(repetitions):
                    row, path = _lists(bits, r, depth)
                    rows.append(row)
                    ids.append(path + r * CENTRES**depth)
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), *(batch.column(c).take(at) for c in ("node", "fp0", "fp1", "label"))], names=["list", "node", "fp0", "fp1", "label"])

    return items.select("node", "fp0", "fp1", "label").mapInArrow(run, "list bigint, node bigint, fp0 bigint, fp1 bigint, label bigint")


def long_lists(members: DataFrame) -> DataFrame:
    """(list, blocks, several) of the lists of more than ``BLOCK`` members, written: blocks of about that many, and whether labels differ."""
    sizes = members.groupBy("list").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("n") > BLOCK)
    return C.written(sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), (F.col("low") < F.col("high")).alias("several")), "long-lists")


def blocked(members: DataFrame, long_: DataFrame, between: bool) -> DataFrame:
    """Adds ``pair``, a block or pair of blocks of a list, ``side``, and ``blocks``. A list that isn't in ``long_`` is one block.

    Not between labels, every block is compared with itself only; which members share a block differs from list to list.
    Between labels, a list of b blocks is compared as b * (b + 1) / 2 pairs of blocks, unless it has one label.
    """
    m = members.join(long_, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    m = m.withColumn("own", F.pmod(F.xxhash64("node", "list"), F.col("blocks")).cast("int"))
    if not between:
        return m.select("*", F.col("own").alias("pair"), F.lit(0).alias("side"))
    m = m.filter(F.coalesce("several", F.lit(True))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return m.withColumn("pair", low * F.col("blocks") + high).withColumn("side", F.when(F.col("own") == low, 0).otherwise(1))


def _strips(fp: np.ndarray, coordinates: np.ndarray, levels: int) -> np.ndarray:
    out = np.empty((levels, len(fp)), np.uint32)
    for i in range(0, len(fp), 1 << 16):
        bits = np.unpackbits(np.ascontiguousarray(fp[i : i + (1 << 16)]).view(np.uint8), axis=1)
        for k in range(levels):
            out[k, i : i + (1 << 16)] = np.ascontiguousarray(np.packbits(bits[:, coordinates[k * STRIP : (k + 1) * STRIP]], axis=1)).view(np.uint32)[:, 0]
    return out


def sublists(fp: np.ndarray, number: int, small: int) -> Iterator[np.ndarray]:
    """Places of the members of each small list that the recursion makes of one list, over all its repetitions."""
    levels, repetitions = inner_effort(len(fp), small)
    if not levels:
        yield np.arange(len(fp))
        return
    for r in range(repetitions):
        rng = np.random.default_rng([number & 0x7FFFFFFF, r])
        strips = _strips(fp, rng.permutation(BITS), levels)
        now = [np.arange(len(fp))]
        for k in range(levels):
            centres = rng.integers(0, 2**STRIP, CENTRES, dtype=np.uint64).astype(np.uint32)
            new = []
            for at in now:
                if len(at) <= small:
                    yield at
                    continue
                near = np.concatenate([np.bitwise_count(strips[k][at[i : i + 65536], None] ^ centres[None, :]) <= RADIUS for i in range(0, len(at), 65536)])
                new += [at[c] for c in near.T if c.sum() > 1]
            now = new
        yield from now


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``bitwise_count`` takes signed numbers by absolute value, so fingerprints must be unsigned."""
    return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])


def nearest(number: int, node: np.ndarray, fp: np.ndarray, small: int, crowd: int, all_: bool) -> list[np.ndarray]:
    """Pairs (node, nearest earlier node, distance) within one list; (node, node, 999) for those that only have later ones.

    ``all_``: every member counts as having a hit; so do the members of lists that stay longer than ``crowd``.
    """
    order = np.argsort(node, kind="stable")
    node, fp = node[order], fp[order]
    n = len(node)
    far, to, hit = np.full(n, 999, np.int16), np.arange(n), np.full(n, all_)
    for at in sublists(fp, number, small):
        parts = [at]
        if len(at) > max(crowd, small):
            hit[at] = True
            place = C.mix(node[at].view(np.uint64) + np.uint64(number & 0xFFFFFFFF)).argsort()
            parts = [np.sort(at[place[i : i + crowd]]) for i in range(0, len(at), crowd)]
        for p in parts:
            for i in range(0, len(p), 256):
                rows = p[i : i + 256]
                d = _distances(fp[rows], fp[p[: i + 256]])
                d[(d > DISTANCE) | (np.arange(len(rows))[:, None] + i <= np.arange(d.shape[1])[None, :])] = 999
                b = d.argmin(1)
                least = d[np.arange(len(rows)), b]
                better = (least < far[rows]) | ((least == far[rows]) & (least < 999) & (p[b] < to[rows]))
                far[rows[better]], to[rows[better]] = least[better], p[b][better]
                hit[p[: i + 256][(d < 999).any(0)]] = True
    a = np.flatnonzero(hit | (far < 999))
    return [node[a], node[to[a]], far[a].astype(np.int64)]


def between_labels(number: int, node: np.ndarray, fp: np.ndarray, label: np.ndarray, side: np.ndarray, small: int) -> list[np.ndarray]:
    """Pairs (greater node, less node, 0) within the distance, of different labels (and, if there are two sides, of different sides)."""
    order = np.argsort(label, kind="stable")
    node, fp, label, side = node[order], fp[order], label[order], side[order]
    two, n, found = side.any() and not side.all(), len(node), [np.zeros(0, np.int64)]
    for at in sublists(fp, number, small):
        own = label[at]
        if own[0] == own[-1]:
            continue
        for i in range(0, len(at), 256):
            rows = at[i : i + 256]
            first = int(np.searchsorted(own, own[i], "right"))
            for j in range(first, len(at), 8192):
                others = at[j : j + 8192]
                ok = (_distances(fp[rows], fp[others]) <= DISTANCE) & (label[rows][:, None] < label[others][None, :])
                if two:
                    ok &= side[rows][:, None] != side[others][None, :]
                a, b = np.nonzero(ok)
                found.append(rows[a] * n + others[b])
    pairs = np.unique(np.concatenate(found))
    a, b = node[pairs // n], node[pairs % n]
    return [np.maximum(a, b), np.minimum(a, b), np.zeros(len(a), np.int64)]


def search(members: DataFrame, long_: DataFrame | None, between: bool) -> DataFrame:
    """Pairs (a, b), a > b: the nearest earlier neighbour of each member over all lists, or all hits between labels.

    Not between labels, a member that only has later neighbours, or may have others, comes as (a, a).
    """
    names = ["list", "pair", "node", "fp0", "fp1", "label", "side", "blocks"]
    parts = blocked(members, long_, between) if long_ is not None else members.withColumns({"pair": F.lit(0), "side": F.lit(0), "blocks": F.lit(1)})
    grouped = parts.select(*names).repartition("list", "pair").sortWithinPartitions("list", "pair")
    small, crowd = SMALL, CROWD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[np.ndarray]) -> pa.RecordBatch:
            number, pair, node, fp0, fp1, label, side, blocks = group
            cuts = np.concatenate([[0], np.flatnonzero((number[1:] != number[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(number)]])
            fp = np.stack([fp0, fp1], 1).view(np.uint64)
            got = [[np.zeros(0, np.int64)] * 3]
            for i, j in zip(cuts, cuts[1:]):
                if between and j - i > 1:
                    got.append(between_labels(int(number[i]), node[i:j], fp[i:j], label[i:j], side[i:j], small))
                elif not between and (j - i > 1 or blocks[i] > 1):
                    got.append(nearest(int(number[i]), node[i:j], fp[i:j], small, crowd, bool(blocks[i] > 1)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[k] for g in got]).astype(np.int64)) for k in range(3)], names=["a", "b", "distance"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            end = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            last = held[-1] if held else None
            if last is not None and (last[0][-1] != now[0][0] or last[1][-1] != now[1][0]):
                yield found([np.concatenate(x) for x in zip(*held)])
                held = []
            if len(end):
                cut = end[-1] + 1
                held.append([x[:cut] for x in now])
                yield found([np.concatenate(x) for x in zip(*held)])
                held = [[x[cut:] for x in now]]
            else:
                held.append(now)
        if held:
            yield found([np.concatenate(x) for x in zip(*held)])

    hits = grouped.mapInArrow(run, "a bigint, b bigint, distance bigint")
    if between:
        return hits.select("a", "b").distinct()
    return hits.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x")).select("a", "x.b")


def shingle_sets(docs: DataFrame, nodes: DataFrame, text: str = "text") -> DataFrame:
    """(node, grams): sorted distinct 32-bit shingle hashes of the texts of ``nodes`` (node, least_id, text_key), one row a node."""
    d = docs.select(F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("text_key"), F.col(f"`{text}`").alias("text"))
    wanted = d.join(nodes.select("node", "text_key"), "text_key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.utf8(batch.column(1))
            for i, j in C.slices(off):
                h, doc = shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                short = (h >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([np.unique(short[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["node", "grams"])

    return wanted.mapInArrow(run, "node bigint, grams binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have at least this Jaccard similarity."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").select("a", "b", "ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ga, gb in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(g.as_buffer(), "<u4") for g in (ga, gb))
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9 and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, class_id, copies, keep), one row a row of ``docs``.

    class_id is the least document id of the class, copies the rows of equal text, and keep marks the row that stands for its
    class (and equal rows, of the same id and text): of the least id, then the least text_key. Rows of null text, or of texts
    whose ids are all null, are classes of their own and kept.
    """
    p = prints(docs, key, text)
    seen = p.filter("text_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("fp0").alias("fp0"), F.first("fp1").alias("fp1"))
    texts = C.written(seen.withColumn("node", F.monotonically_increasing_id()), "texts")  # written once, so the numbers stay
    items = texts.filter("n_shingles > 0").withColumn("label", F.col("node"))
    depth, repetitions = effort(items.count())
    members = listed(items, depth, repetitions)
    long_ = long_lists(members)
    near = C.written(search(members, long_ if long_.count() else None, False), "nearest")
    ends = C.written(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct(), "ends")
    C.release(docs.sparkSession)
    own = items.join(ends, "node", "left_semi").drop("label")
    sets = C.written(shingle_sets(docs, own, text), "sets")
    first = C.written(verified(near.filter("a > b"), sets), "links")
    C.release(docs.sparkSession)
    labels = components(first)
    again = own.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    members = listed(again, depth, repetitions)
    longer = long_lists(members)
    cross = C.written(search(members, longer if longer.count() else None, True), "cross")
    second = C.written(verified(cross, sets), "more-links")
    roots = components(first.union(second))
    named = texts.join(roots, "node", "left").select("text_key", "least_id", "copies", F.coalesce("root", "node").alias("root"))
    stands = named.groupBy("root").agg(F.min(F.struct("least_id", "text_key")).alias("x")).select("root", F.col("x.least_id").alias("class_id"), F.col("x.text_key").alias("class_key"))
    found = C.written(named.join(stands, "root").select("text_key", "copies", "class_id", "class_key"), "classes")
    C.forget(texts, long_, near, ends, sets, first, longer, cross, second)
    C.release(docs.sparkSession)
    out = p.join(found, "text_key", "left")
    keep = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("class_key")), F.col("class_id").isNull())
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), keep.alias("keep"))
