"""Token-id shards: raw id payloads in document order, with a minimal perfect hash index over document keys.

A store is a folder on the shared file system:

- ``shard-NNNNN.bin``: the ids of a range of documents, little-endian unsigned, end id after each document, nothing else;
- ``shards/`` (Parquet): shard, its ids before, its documents before, its number of ids, id width, file name;
- ``entries/`` (Parquet): doc_id, copy, shard, begin, n_tokens;
- ``index-NNNNN.npz``: for the keys of one hash part: the perfect hash, and by its slots fingerprint, shard, begin, n_tokens.

A lookup goes from the key's hash to its part, to its slot, compares the stored fingerprint and has the place: constant time,
whatever the number of documents. A key is a document id and a copy number, 0 but for rows that repeat an id.

Recovery: files are written under another name and renamed, with equal bytes on every attempt; Spark's own commit protects the
tables. Memory: a batch of texts or ids, and one part's index (``KEYS_PER_PART`` keys on average).

Defined results: null text is empty (just the end id); null ids come first and are keys too; rows that tie on id are ordered by
text, nulls first, and numbered; an empty table gives a store without shards; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T
from .mph import PerfectHash, fingerprint

KEYS_PER_PART = 1 << 17
_NULL = -(2**63)


def _hash(ids: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return C.mix(C.mix(ids.astype(np.int64).view(np.uint64)) + copies.astype(np.int64).view(np.uint64) * C._MUL)


def _fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts and writes a new store at ``path`` (a uri). ``key`` is a 64-bit integer column."""
    spark = docs.sparkSession
    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _fs(path)
        encoder = T.encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        shard = context.partitionId()
        name = f"shard-{shard:05}.bin"
        temporary = f"{root}/.{name}.{context.taskAttemptId()}"
        out, at, last, copy = None, 0, None, 0
        for batch in batches:
            buf, off = C.utf8(batch.column(1))
            raw = buf.tobytes()
            ids = batch.column(0).to_pylist()
            begins, sizes, copies = [], [], []
            for k in range(len(off) - 1):
                got = encoder.encode(raw[off[k] : off[k + 1]])
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                out.write(got + end)
                begins.append(at)
                sizes.append(len(got) // encoder.width + 1)
                at += sizes[-1]
            for d in ids:
                first = last is None
                copy = copy + 1 if not first and last[0] == d else 0
                last = (d,)
                copies.append(copy)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array([encoder.width] * len(ids), pa.int32())], names=["doc_id", "copy", "shard", "begin", "n_tokens", "width"])
        if out is not None:
            out.close()
            fs.move(temporary, f"{root}/{name}")

    ordered.mapInArrow(run, "doc_id bigint, copy bigint, shard int, begin bigint, n_tokens bigint, width int").write.parquet(f"{path}/raw-entries")
    raw = spark.read.parquet(f"{path}/raw-entries")
    sums = raw.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"), F.first("width").alias("width"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.select("shard", "width", "n_ids", "n_docs", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n_ids", "n_docs")])
    totals.withColumn("file", F.format_string("shard-%05d.bin", "shard")).write.parquet(f"{path}/shards")
    # an id that goes on in the next shard is numbered on from there
    w = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    edge = raw.groupBy("doc_id", "shard").count().withColumn("more", F.coalesce(F.sum("count").over(w), F.lit(0))).filter("more > 0")
    e = edge.select(F.col("doc_id").alias("d"), F.col("shard").alias("s"), "more")
    fixed = raw.join(e, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("shard") == F.col("s")), "left")
    fixed.select("doc_id", (F.col("copy") + F.coalesce("more", F.lit(0))).alias("copy"), "shard", "begin", "n_tokens").write.parquet(f"{path}/entries")
    _index(spark, path)


def _parts(spark: SparkSession, path: str) -> int:
    return max(1, -(-spark.read.parquet(f"{path}/entries").count() // KEYS_PER_PART))


def _keyed(df: DataFrame, parts: int) -> DataFrame:
    """Adds the hash part of (doc_id, copy), and gathers each part."""
    part = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")
    return df.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part")


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of equal ``column``, of sorted batches, gathered."""
    held: list = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and held[0].column(column)[0].as_py() != values[i]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)


def _ints(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column)
    return (values.fill_null(_NULL) if values.null_count else values).to_numpy()


def _index(spark: SparkSession, path: str) -> None:
    entries = spark.read.parquet(f"{path}/entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _runs(batches, "part"):
            h = _hash(_ints(rows, "doc_id"), _ints(rows, "copy"))
            found = PerfectHash.build(h)
            slots = found.slots(h)
            stored = {"prints": np.empty(len(h), np.uint32), "shard": np.empty(len(h), np.int32), "begin": np.empty(len(h), np.int64), "n_tokens": np.empty(len(h), np.int64)}
            stored["prints"][slots] = fingerprint(h)
            for c in ("shard", "begin", "n_tokens"):
                stored[c][slots] = _ints(rows, c)
            data = io.BytesIO()
            np.savez(data, sizes=np.array(found.sizes, np.int64), words=found.words, **stored)
            fs, root = _fs(path)
            temporary = f"{root}/.index-{part:05}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(temporary) as out:
                out.write(data.getvalue())
            fs.move(temporary, f"{root}/index-{part:05}.npz")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(found.words.size * 64)], pa.int64())], names=["part", "n_keys", "bits"])

    _keyed(entries, _parts(spark, path)).mapInArrow(run, "part int, n_keys bigint, bits bigint").write.parquet(f"{path}/parts")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, begin, n_tokens) of ``keys`` (doc_id, copy), by the index; nulls for keys that it doesn't hold.

    A key that isn't held passes for one that is with a chance of 2**-32, by its fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: tuple = (None, None, None)
        for batch in batches:
            values = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part, rows = int(values[i]), pa.Table.from_batches([batch.slice(i, j - i)])
                if loaded[0] != part:
                    fs, root = _fs(path)
                    name = f"{root}/index-{part:05}.npz"
                    z = None
                    if fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
                        with fs.open_input_file(name) as f:
                            z = dict(np.load(io.BytesIO(f.read())))
                    loaded = (part, z, z and PerfectHash(z["sizes"].tolist(), z["words"]))
                h = _hash(_ints(rows, "doc_id"), _ints(rows, "copy"))
                slots = loaded[2].slots(h) if loaded[2] else np.full(len(h), -1)
                ok = slots >= 0
                if ok.any():
                    ok[ok] = loaded[1]["prints"][slots[ok]] == fingerprint(h[ok])
                at = np.where(ok, slots, 0)
                pick = lambda c, t: pa.array((loaded[1][c][at] if loaded[1] else np.zeros(len(h), np.int64)), t, mask=~ok)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("copy").combine_chunks(), pick("shard", pa.int32()), pick("begin", pa.int64()), pick("n_tokens", pa.int64())], names=["doc_id", "copy", "shard", "begin", "n_tokens"])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy"))
    return _keyed(asked, _parts(spark, path)).mapInArrow(run, "doc_id bigint, copy bigint, shard int, begin bigint, n_tokens bigint")


def read(spark: SparkSession, path: str, places: DataFrame, digest: bool = False) -> DataFrame:
    """Reads the ids at ``places`` (of ``lookup``) back: (doc_id, copy, start, n_tokens, ids), or ids_crc32 in place of ids.

    ``ids`` are little-endian unsigned 32-bit. Rows are gathered by ranges of shard and place, so that reads run forward.
    """
    found = places.filter("shard IS NOT NULL").join(spark.read.parquet(f"{path}/shards").select("shard", "width", "n_ids_before", "file"), "shard")
    near = found.repartitionByRange("shard", "begin").sortWithinPartitions("shard", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        name, file = None, None
        for batch in batches:
            out = []
            for f, width, begin, n in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "begin", "n_tokens"))):
                if f != name:
                    name, file = f, fs.open_input_file(f"{root}/{f}")
                ids = np.frombuffer(file.read_at(n * width, begin * width), f"<u{width}").astype("<u4").tobytes()
                if len(ids) != 4 * n:
                    raise OSError(f"{f} is cut off")
                out.append(zlib.crc32(ids) if digest else ids)
            start = pa.array(batch.column("begin").to_numpy() + batch.column("n_ids_before").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), start, batch.column("n_tokens"), pa.array(out, pa.int64() if digest else pa.binary())], names=["doc_id", "copy", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return near.mapInArrow(run, "doc_id bigint, copy bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids binary"))


