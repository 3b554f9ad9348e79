"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator; and brute force."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import chat, components, gsaca, langid, media, mixing, mph, packing, quality, shards, simhash, substrings, tokens, urls
from graphloom.llm import common as C
from graphloom.llm import op3_substrings, op6_packing, op8_media

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double, node long, size long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, x, s, None, None, None, None, None) for i, t, x, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(400)]
    long_ = " ".join(rng.choice(words) for _ in range(3000))
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", None), (4, None, None, "b"), (5, "", "fr", "b"), (6, "", "fr", "b"), (7, long_, "fr", "c"), (None, base, "en", "c"), (8, "x y", None, "a"), (8, "x y", None, "a"), (9, "12 34 !!", "en", "a"), (10, long_[:900] + "z" * 60, "en", "b")]
    return rows, make(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(-1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 30))]
        assert gsaca.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_perfect_hash():
    keys = C.mix(np.arange(5000, dtype=np.uint64))
    found = mph.PerfectHash.build(keys)
    assert sorted(found.slots(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        mph.PerfectHash.build(np.array([1, 1], np.uint64))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_library(name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path(name))
    e = tokens.Encoder(tokens.default_path(name))
    parts = ["a", "Été", "é", "'s", "  ", " ", "\n", "\n\n", "\t", " ", "12", "!", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|end", "Σ", "\x1c", "\x01", "한", "don't", "foo.", " the,", "İ"]
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(e.encode(s.encode()), e.dtype).tolist() == lib.encode(s, add_special_tokens=False).ids


def test_token_store(spark, odd, none):
    path = C.new_path(spark, "store")
    shards.write(odd[1], path, tokens.default_path("word_bpe_49k.json"), 2)
    keys = spark.read.parquet(f"{path}/entries").select("doc_id", "copy")
    got = shards.read(spark, path, shards.lookup(spark, path, keys)).orderBy("start").collect()
    assert len(got) == len(odd[0]) and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)]).tolist()[:-1]
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 2 for r in got)
    missing = shards.lookup(spark, path, spark.createDataFrame([(999, 0)], "doc_id long, copy long")).first()
    assert missing["shard"] is None
    path = C.new_path(spark, "store")
    shards.write(none, path, tokens.default_path("word_bpe_49k.json"), 2)
    assert spark.read.parquet(f"{path}/entries").count() == 0


def test_language(spark, odd, none):
    from pyspark.sql import functions as F

    model = langid.train(odd[1], F.lit(True))
    got = langid.identify(odd[1], model).collect()
    assert len(got) == len(odd[0])
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in got)
    assert langid.identify(none, langid.train(none, F.lit(True))).count() == 0


def brute_cut(rows):
    first = {}
    for i, b in sorted(rows):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        runs = sum(g and not before for g, before in zip(gone, b"\0" + gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def cut(docs):
    got = op3_substrings.digest(docs, *substrings.dedup(docs)).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr)


def passages(rng):
    """Documents with shared passages at odd places, runs of one letter, copies, a repeated id and marks of several bytes."""
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(n)) for n in (8, 9, 10, 12, 30, 80)]
    rows = []
    for k in range(90):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            at = rng.randint(0, 20)
            parts += [passage[at : at + rng.randint(30, 400)], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))]
        rows.append((100 + k - k % 7 // 6, "".join(parts), "en", "a"))
    return rows + [(300, "aaaa" * 40, "en", "a"), (301, "aaaa" * 30, "en", "a"), (302, "ab" * 90, "en", "a"), (303, "", "en", "a"), (304, None, "en", "a")]


def test_substrings(spark, odd, none):
    rng = random.Random(3)
    more = [(100 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) + "-shared passage that is long enough to be found, and then some more-"[: rng.randint(30, 70)], "en", "a") for k in range(40)]
    rows = [r for r in odd[0] if r[0] is not None] + more + [(200, "aaaa" * 40, "en", "a"), (201, "aaaa" * 30, "en", "a")]
    assert cut(make(spark, rows)) == brute_cut([(i, (t or "").encode()) for i, t, _, _ in rows])
    assert len(cut(odd[1])) == len(odd[0])
    assert cut(none) == []


@pytest.mark.parametrize("block, hot", [(3000, 256), (3000, 2), (1, 2)])
def test_substrings_in_blocks(spark, monkeypatch, block, hot):
    """Many blocks, hot anchors (in ``hot`` blocks or more) and a block of one text each: always as brute force has it."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "HOT_BLOCKS", hot)
    rows = passages(random.Random(block + hot))
    assert cut(make(spark, rows).repartition(3)) == brute_cut([(i, (t or "").encode()) for i, t, _, _ in rows])


def test_substrings_of_a_text_longer_than_a_block(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    long_ = " ".join(rng.choice(words) for _ in range(560_000))
    assert len(long_) > substrings.BLOCK_BYTES
    rows = [(1, long_[2_000_000:2_000_400] + "!" * 9, "en", "a"), (2, long_, "en", "a"), (3, "?" + long_[4_100_000:4_100_200], "en", "a")]
    got = sorted(cut(make(spark, rows)))
    assert [r[:4] for r in got] == [(1, 409, 0, 0), (2, len(long_), 400, 1), (3, 201, 200, 1)]
    assert got[1][4] == hashlib.sha256((long_[:2_000_000] + long_[2_000_400:]).encode()).hexdigest()


def test_substrings_come_through_the_suffix_order(monkeypatch):
    """Matches are runs of the construction's order: with the order of the text in its place, they are lost."""
    rng = np.random.default_rng(5)
    base = rng.integers(97, 123, (40, 76), dtype=np.uint8)
    near = base[rng.integers(0, 40, 400)].copy()
    near[np.arange(400), rng.integers(0, 76, 400)] ^= 1
    ids, left, right = np.arange(400), np.full(400, 26), np.full(400, 50)
    far, close = substrings.matches(ids, left, right, near)
    whole = [{j: bytes(r[26 - j : 76 - j]) for j in range(27)} for r in near]
    first = {}
    for j in range(27):
        for i in range(400):
            first.setdefault((j, whole[i][j]), i)
    for i in range(400):
        hit = [j for j in range(27) if first[j, whole[i][j]] < i]
        assert (far[i], close[i]) == ((max(hit), min(hit)) if hit else (-1, -1))
    monkeypatch.setattr(substrings, "suffix_array", lambda s: np.arange(len(s)))
    again, _ = substrings.matches(ids, left, right, near)
    assert (again >= 0).sum() < (far >= 0).sum()


@pytest.mark.parametrize("block, most", [(3000, 1 << 14), (1, 1 << 14), (3000, 3)])
def test_substrings_of_hot_anchors_and_large_cores(spark, monkeypatch, block, most):
    """Every anchor of several blocks is hot and portions are small; or cores are halved down to single strings."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "HOT_BLOCKS", 1 if most > 3 else 256)
    monkeypatch.setattr(substrings, "HOT_EACH", 1)
    monkeypatch.setattr(substrings, "PORTION", 300)
    rows = passages(random.Random(block + most))
    assert cut(make(spark, rows).repartition(3)) == brute_cut([(i, (t or "").encode()) for i, t, _, _ in rows])


def test_substrings_match_cores_of_any_size_alike(monkeypatch):
    rng = np.random.default_rng(6)
    near = np.repeat(rng.integers(97, 99, (30, 76), dtype=np.uint8), 20, 0)
    near[np.arange(600), rng.integers(0, 76, 600)] ^= 1
    near[:, 26:50] = near[0, 26:50]
    ids, left, right = rng.integers(0, 200, 600), rng.integers(0, 27, 600), rng.integers(24, 51, 600)
    near[np.arange(-26, 50)[None, :] < -left[:, None]] = 0
    near[np.arange(-26, 50)[None, :] >= right[:, None]] = 0
    whole = [{j: bytes(r[26 - j : 76 - j]) for j in range(50 - b if b < 50 else 0, a + 1)} for r, a, b in zip(near, left, right)]
    least = {}
    for i, strings in zip(ids, whole):
        for j, x in strings.items():
            least[j, x] = min(i, least.get((j, x), i))
    hits = [[j for j, x in strings.items() if least[j, x] < i] for i, strings in zip(ids, whole)]
    assert sum(map(bool, hits)) > 20
    for most in (1 << 14, 50, 1):
        monkeypatch.setattr(substrings, "MOST", most)
        far, close = substrings.matches(ids, left, right, near)
        assert far.tolist() == [max(h, default=-1) for h in hits] and close.tolist() == [min(h, default=-1) for h in hits]


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_substrings_match_many_contexts_in_little_memory():
    """Contexts of repeated anchors that differ on both sides, a bucket's at some GB: they don't all become one suffix order."""
    rng = np.random.default_rng(7)
    n = 40_000
    near = rng.integers(97, 123, (n, 76), dtype=np.uint8)
    near[:, 26:50] = near[np.arange(n) // 4, 26:50]
    near[1::40] = near[::40]
    ids, left, right = np.arange(n), np.full(n, 26), np.full(n, 50)
    assert peak_mb(lambda: substrings.matches(ids, left, right, near)) < 60
    far, _ = substrings.matches(ids, left, right, near)
    assert np.flatnonzero(far >= 0).tolist() == list(range(1, n, 40))


def test_substrings_send_hot_contexts_in_little_memory(monkeypatch):
    """A block whose anchors are all hot: the strings around them are made a portion at a time."""
    rng = np.random.default_rng(8)
    data, off = rng.integers(97, 123, 300_000, dtype=np.uint8), np.arange(0, 300_001, 1000)
    _, h, _ = substrings._all_anchors(data, off)
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.arange(300), off.astype(np.int64), data))], names=["block", "ids", "off", "data"])

    class Blocked:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(substrings, "_load", lambda root, name: b"\2" * len(np.unique(h)))
    monkeypatch.setattr(substrings, "_store", lambda root, name, data: None)
    run = substrings.contexts(Blocked(), 16, "")
    assert peak_mb(lambda: [None for _ in run(iter([batch]))]) < 100
    strings = sum(len(x.as_buffer()) // 8 for rows in run(iter([batch])) for x in rows.column(2))
    assert strings >= 300 * 951


def test_substrings_are_cut_out_in_little_memory(monkeypatch):
    """A block goes out by slices of whole texts, with the cuts of either file in any order."""
    rng = np.random.default_rng(9)
    data, off = rng.integers(97, 123, 4_000_000, dtype=np.uint8), np.arange(0, 4_000_001, 4000).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.arange(1000), off, data))], names=["block", "ids", "off", "data"])
    spans = {"cut-0": [(999, 100, 200), (0, 0, 60), (0, 50, 70)], "own-0": [(500, 3900, 4000), (0, 90, 140)]}

    class Blocked:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(substrings, "_load", lambda root, name: np.array(spans[name], np.int64).tobytes())
    run = substrings._kept(Blocked(), "", True)
    assert peak_mb(lambda: [None for _ in run(iter([batch]))]) < 60
    got = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert [r["doc_id"] for r in got] == list(range(1000)) and {r["n_bytes"] for r in got} == {4000}
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got if r["n_removed"]} == {0: (120, 2), 500: (100, 1), 999: (100, 1)}
    text = data.tobytes().decode()
    assert [got[k]["kept"] for k in (0, 1, 999)] == [text[70:90] + text[140:4000], text[4000:8000], text[3_996_000:3_996_100] + text[3_996_200:]]


def test_simhash(spark, odd, none):
    got = simhash.classes(odd[1]).collect()
    assert len(got) == len(odd[0])
    by = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5 and by[7] == 7 and by[10] == 10
    assert simhash.classes(none).count() == 0
    assert simhash.pass_rate(0.0) > 0.5 > simhash.pass_rate(0.3)


def brute_classes(rows, least=0.8):
    """Least id of each row's class, by the exact Jaccard similarity of five-word shingles of all pairs; not for null texts."""
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for _, t, _, _ in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if rows[a][1] == rows[b][1] or both and both >= least * (len(grams[a]) + len(grams[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least_id = {}
    for k, r in enumerate(rows):
        least_id[find(k)] = min(r[0], least_id.get(find(k), r[0]))
    return [least_id[find(k)] for k in range(len(rows))]


def pairs_of_near_copies(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(2000)]
    rows = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(200)]
        rows.append((2 * k, " ".join(w), "en", "a"))
        w[100] = "changed"
        rows.append((2 * k + 1, " ".join(w), "en", "a"))
    return rows


def test_simhash_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 1)
    rows = pairs_of_near_copies(6, 60)
    got = {r["doc_id"]: r["class_id"] for r in simhash.classes(make(spark, rows)).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_classes(rows)))


def near_copies(seed, n_bases, copies, changes):
    """Bases of 200 words with copies in which some words are changed; most stay at a similarity of 0.8 or more, some don't."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(2000)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(words) for _ in range(200)]
        rows.append((len(rows), " ".join(base), "en", "a"))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(*changes)):
                w[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows), " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("small, crowd, n_bases, copies, changes", [(512, 2048, 300, 1, (1, 5)), (8, 16, 300, 1, (1, 4)), (8, 16, 3, 150, (1, 3))])
def test_simhash_recall(spark, monkeypatch, small, crowd, n_bases, copies, changes):
    """At least nine in ten links by exact similarity are within a class, with lists by brute force, by the recursion and crowded; no link is invented."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = near_copies(small + copies, n_bases, copies, changes)
    got = {r["doc_id"]: r["class_id"] for r in simhash.classes(make(spark, rows)).collect()}
    want = brute_classes(rows)
    linked = [(r[0], w) for r, w in zip(rows, want) if r[0] != w]
    assert len(linked) > len(rows) * 0.3
    assert sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)
    by_class = dict(zip([r[0] for r in rows], want))
    assert all(by_class[a] == by_class[b] for a, b in got.items())


def test_simhash_of_different_texts_that_share_an_id(spark):
    rows = near_copies(4, 6, 1, (1, 1))
    rows = [(r[0] // 2 % 2, *r[1:]) for r in rows]  # ids 0 and 1, each for six texts
    got = simhash.classes(make(spark, rows)).select("doc_id", "text_key", "class_id", "keep").collect()
    assert len(got) == 12 and sum(r["keep"] for r in got) == 6
    want = brute_classes([(k, *r[1:]) for k, r in enumerate(rows)])
    keys = [hashlib.md5(r[1].encode()).digest() for r in rows]
    by = {bytes(r["text_key"]): (r["class_id"], r["keep"]) for r in got}
    for k, key in enumerate(keys):
        assert by[key][0] == rows[k][0] and by[key][1] == (key == min(x for x, w in zip(keys, want) if w == want[k]))


def test_simhash_effort():
    assert [simhash.effort(n)[0] for n in (0, 1000, 400_000, 20_000_000, 50_000_000)] == [1, 1, 1, 1, 2]
    assert simhash.effort(1000)[1] == simhash.effort(20_000_000)[1] <= 13
    for m in (100, 5000, 400_000):
        levels, times = simhash.inner_effort(m, 512)
        assert 1 - (1 - simhash.pass_rate(simhash.flip_rate(0.8)) ** levels) ** times >= 0.9


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(5, 5), (500, 500), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, odd, none):
    got = op6_packing.packed(odd[1]).collect()
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0, *(n for _, n in p)]).tolist()[:-1] and sum(n for _, n in p) <= 2048
    assert len({(r["doc_id"]) for r in got}) == len({r[0] for r in odd[0]}) and op6_packing.packed(none).count() == 0
    rng = np.random.default_rng(0)
    for lengths, waste in ((rng.exponential(600, 40000), 1.005), (rng.uniform(1, 2049, 40000), 1.03)):
        h = np.bincount(np.clip(lengths.astype(int), 1, 2048), minlength=2049)
        runs, n = packing.plan(h)
        assert np.array_equal(np.bincount(runs[:, 0], runs[:, 2], 2049), h) and n <= waste * (h * np.arange(2049)).sum() / 2048 + 1


def test_mixing(spark, odd, none):
    got = mixing.taken(mixing.sizes(odd[1])).collect()
    assert len(got) == len(odd[0]) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
    assert mixing.taken(mixing.sizes(none)).count() == 0


def test_media(spark, odd, none):
    got = op8_media.features(op8_media.store(odd[1])).collect()
    want = sorted((len((t or "").encode()), zlib.crc32(media.payload((t or "").encode())[-32:])) for _, t, _, _ in odd[0])
    assert sorted((r["n_bytes"], r["tail_crc32"]) for r in got) == want and op8_media.features(op8_media.store(none)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (6, 12), dtype=np.uint8)
    for bpp in (1, 3):
        lines = np.zeros((6, 13), np.uint8)
        for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
            lines[y, 0] = kind
            for x in range(12):
                a = int(rows[y, x - bpp]) if x >= bpp else 0
                b = int(rows[y - 1, x]) if y else 0
                c = int(rows[y - 1, x - bpp]) if y and x >= bpp else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                lines[y, x + 1] = (int(rows[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
        assert np.array_equal(media._unfilter(lines, bpp), rows)
    png = bytearray(media.encode(b"a" * 576))
    assert media.decode(bytes(png)).tobytes() == b"a" * 576
    png[45] ^= 1
    with pytest.raises(media.BadImage):
        media.decode(bytes(png))


def test_urls(spark):
    rows = [(1, "http://A.com/en/x", None), (2, "https://b.net/q", None), (3, "x", ""), (4, None, "<p>"), (5, "http://c.org/1", '<link href="http://a.com/en/x" rel="canonical">'), (6, "http://d.org/1", "<meta http-equiv=refresh content='0; url=http://c.org/1'>"), (7, "http://ok.org/1", '<link rel=canonical href="http://c.org/1">'), (7, "http://ok.org/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("com", "/en/", "block"), ("ok.org", "/", "allow")], "host string, path string, action string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, urls.page_edges(pages)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    few = pages.filter("page_id < 7")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(few, rules, urls.page_edges(few)).collect()}
    assert got[5] == got[6] == "block"


def test_quality(spark, odd, none):
    got = quality.judge(odd[1]).collect()
    assert len(got) == len(odd[0]) and all(not (r["base_failed"] and r["kept"]) for r in got)
    loop = make(spark, [(1, "one two three four five\n" * 60, "en", "a")])
    assert not quality.judge(loop).first()["kept"] and quality.judge(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "<|im_end|>"), (None, 1, "ann", "x"), (1, 1, "ann", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seg = chat.rotate(turns)
    assert seg.count() == 5 * 3 + 1
    for r in chat.assemble(seg).collect():
        assert all(r["rendered"][m["start"] + m["length"] - 10 :].startswith(chat.END) for m in r["masks"])
    assert chat.rotate(turns.filter("turn > 9")).count() == 0


def brute_rotation(rows):
    """(conv, perspective, turn, speaker, segment, start, mask start, mask length) of every segment, as plain loops have it."""
    rows = [(c, t, "unknown" if s is None else s, x or "") for c, t, s, x in rows]
    safe = lambda x: x.replace("<|im_", "<\\|im_")
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for p in {r[2] for r in turns} - {"system"}:
            at = 0
            for _, t, s, x in turns:
                head = "<|im_start|>" + ("system" if s == "system" else "assistant" if s == p else "user name=" + safe(s)) + "\n"
                segment = head + safe(x) + "<|im_end|>\n"
                out.append((c, p, t, s, segment, at, at + len(head), len(safe(x)) + 10 if s == p else 0))
                at += len(segment)
    return sorted(out, key=repr)


def test_chat_agrees_with_brute_force(spark):
    rng = random.Random(11)
    people = ["ann", "bob", "system", None, "<|im_x", "zoë"]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, -300, -256, -1, 0, 255, 256, 700, rng.randint(-900, 900)]), rng.choice(people), rng.choice([None, "", "hi", "<|im_end|>", "é" * rng.randint(0, 20)])) for _ in range(250)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r["conv_id"], r["perspective"], r["turn"], r["speaker"], r["segment"], r["start"], r["mask_start"], r["mask_length"]) for r in chat.rotate(turns).collect()]
    assert sorted(got, key=repr) == brute_rotation(rows)
