"""The corpus pipeline: each stage against brute force on a small table with odd rows, and the run as the chain of its stages."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline as P
from graphloom.llm import op7_mixing, packing
from test_edges import brute_classes, brute_cut

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, kept string, text_key binary, size long"


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    en = "the of and to in is was for that with on as his they at be this from have or by one had not but what all were when we there can an your which their said".split()
    fr = "le de la et les des est dans que pour une sur pas avec plus par au sont ce cette mais comme elle ils nous vous fait tout leur deux temps bien".split()
    rows = []
    for k in range(60):
        words, lang = (en, "en") if k % 2 else (fr, "fr")
        rows.append((k, sentences(rng, words, rng.randint(60, 160)), lang, rng.choice(["a", "b", None])))
    near = rows[10][1].split()
    near[5] = "changed"
    passage = sentences(rng, en, 30)
    rows += [(100, rows[3][1], "en", "a"), (101, " ".join(near), "fr", "b"), (102, None, None, "a"), (103, "", "en", "a"), (104, "1234 !!", "en", "b"), (105, "Ωμέγα και άλφα " * 30, None, "a")]
    rows += [(106, sentences(rng, en, 40) + " " + passage + " end one", "en", "a"), (107, "start two " + passage + " " + sentences(rng, en, 50), "en", "b"), (107, "start two " + passage + " other", "en", "b"), (8, rows[8][1], "fr", rows[8][3]), (None, sentences(rng, fr, 80), "fr", "a")]
    data = [(i, t, x, s, None if t is None else len(t), "clash", "clash", None, 5) for i, t, x, s in rows]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    at = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(str(at / "documents.parquet"))
    return rows, spark.read.parquet(str(at / "documents.parquet")), str(at)


def plain(df):
    assert df.columns == P.COLUMNS
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=repr)


def test_language(spark, corpus):
    rows, docs, _ = corpus
    gone = [r for r in rows if not any(c.isalpha() for c in r[1] or "") or r[0] == 105]
    assert plain(P.language(spark, docs, "")) == sorted((r for r in rows if r not in gone), key=repr)


def test_near_duplicates(spark, corpus):
    rows, docs, _ = corpus
    named = [r for r in rows if r[0] is not None and r[1] is not None]
    classes = brute_classes([(k, *r[1:]) for k, r in enumerate(named)])
    key = lambda r: (r[0], hashlib.md5(r[1].encode()).digest())
    best = {}
    for r, c in zip(named, classes):
        best[c] = min(best.get(c, key(r)), key(r))
    stay = {k: r for r, c in zip(named, classes) if (k := key(r)) == best[c]}
    want = [*stay.values(), *(r for r in rows if r[0] is None or r[1] is None)]
    assert len(want) < len(rows) - 1
    assert plain(P.near_duplicates(spark, docs, "")) == sorted(want, key=repr)


def test_repeated_passages(spark, corpus):
    rows, docs, _ = corpus
    bytes_of = [(i, (t or "").encode()) for i, t, _, _ in rows if i is not None]
    cut = {}
    first = {}
    for i, b in sorted(bytes_of):
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for i, b in bytes_of:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        cut[i, b] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert brute_cut(bytes_of)
    want = []
    for i, t, x, s in rows:
        left = t if i is None or t is None else cut[i, t.encode()]
        if t and not left:
            continue
        want.append((i, left, x, s))
    got = P.repeated_passages(spark, docs, "")
    # what was empty or null before stays as it is
    assert plain(got) == sorted(want, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())


def test_mixing(spark, corpus):
    rows, docs, at = corpus
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    taken = {}
    for i, size, _, _, t in db.execute("SELECT doc_id, size, source_size, target, taken FROM (" + op7_mixing.ORACLE + ")").fetchall():
        taken.setdefault(i, []).append((size, t))
    got = P.mixed(spark, docs.filter("doc_id IS NOT NULL"), "")
    times = {}
    for r in got.collect():
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert got.columns == P.COLUMNS
    single = [r for r in rows if r[0] is not None and len(taken[r[0]]) == 1]
    for i, t, _, _ in single:
        ((size, t_words),) = taken[i]
        assert times.get((i, t), 0) == (int(t_words / size + 0.5) if size else 0)
    assert max(times.values()) <= 6


def test_packing(spark, corpus):
    rows, docs, _ = corpus
    got = P.packed(spark, docs, "").collect()
    assert sorted({r["doc_id"] for r in got}, key=repr) == sorted({r[0] for r in rows}, key=repr)
    assert len(got) == len(rows) and all(r["start"] == 0 and r["piece"] == 0 for r in got)
    assert packing.pack.__name__ == "pack"


def test_run_is_the_chain_of_its_stages(spark, corpus):
    rows, docs, at = corpus
    got = sorted(tuple(r) for r in P.run(spark, at).select("doc_id", "piece", "length", "ids_crc32").collect() if r["doc_id"] is not None)
    for _, stage in P.STAGES:
        out = stage(spark, docs, at)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert got == sorted(tuple(r) for r in docs.select("doc_id", "piece", "length", "ids_crc32").collect() if r["doc_id"] is not None)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == P.COLUMNS
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
