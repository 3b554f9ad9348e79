"""What the operators of this subpackage share: the shared folder, written tables, text as bytes, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time; longer documents are passed alone, whole.
SLICE_BYTES = 700_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset and Spark is local, a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage ends there, and lost executors cost no rework."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.startswith(shared_dir(spark)):
                forget_path(spark, name)


def forget_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect what it no longer refers to, upon which Spark deletes the shuffle files of plans that are done.

    Between the steps of an operator, after a written table ends a lineage; else they would stay until memory runs short.
    """
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group, in two levels, so that a hot group is split.

    ``bucket`` must not decrease along ``order`` within a group; rows that tie on all of ``order`` must be interchangeable.
    Null keys form a group of their own.
    """
    d = df.withColumns({"_b": bucket, "_v": value})
    sums = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    on = F.col("_b") == F.col("_bb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_own", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    return d.join(base, on, "left").withColumn(name, F.col("_base") + F.col("_own")).drop("_b", "_v", "_own", "_bb", "_base", *[f"_k{i}" for i in range(len(keys))])


# ---- text as bytes -------------------------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents of at most ``most`` bytes; a longer one comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _modulo(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64 and finalised, of every run of k values, by doubling; len(values) - k + 1 of them."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    cur, width, power = values.astype(np.uint64) + np.uint64(1), 1, int(_MUL)
    out, covered = None, 0
    while True:
        if k & width:
            if out is None:
                out, covered = cur, width
            else:
                m = len(values) - covered - width + 1
                out = out[:m] * _modulo(power) + cur[covered : covered + m]
                covered += width
        if covered == k:
            return mix(out)
        m = len(cur) - width
        cur = cur[:m] * _modulo(power) + cur[width : width + m]
        width *= 2
        power = power * power & (2**64 - 1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _modulo(pow(base, k, 2**64))
        k += m
    return out[:n]


def span_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[begin:end], from one running sum: sum(b * B**i), divided by B**begin."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(int(_MUL), n), out=sums[1:])
    inverse = powers(pow(int(_MUL), -1, 2**64), n + 1)
    return mix((sums[end] - sums[begin]) * inverse[begin])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of other bytes than ASCII white space, and its document; none crosses documents."""
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = ~_SPACE[buf]
    starts = solid[1:-1] & ~solid[:-2]
    stops = solid[1:-1] & ~solid[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    starts[inner] = solid[1:-1][inner]
    stops[inner - 1] = solid[1:-1][inner - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return begin, end, np.searchsorted(off, begin, "right") - 1


def counts_per(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    got = np.bincount(owner, weights=weights, minlength=n)
    return got.astype(np.int64)
