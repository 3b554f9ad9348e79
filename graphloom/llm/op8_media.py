"""op8: media columns over documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import media


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.utf8(batch.column(1))
            raw = buf.tobytes()
            ids = batch.column(0)
            for i in range(0, len(off) - 1, 256):
                j = min(i + 256, len(off) - 1)
                made = [media.encode(media.payload(raw[off[k] : off[k + 1]])) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(off[i + 1 : j + 1] - off[i:j]), pa.array(made, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary")


def features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the stored pictures back: payload and file digests, and the 64-bit cosine hash as hex and binary.

    A picture that can't be read gets its message in ``error``; its payload columns and feature are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for png in batch.column(2):
                png = png.as_py()
                try:
                    samples = media.decode(png if png is not None else b"")
                    back = samples.tobytes()
                    bits = media.cosine_hash(samples)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(png), hashlib.sha256(png).hexdigest(), bits.hex(), bits, None))
                except media.BadImage as e:
                    rows.append((None, None, None, len(png) if png else 0, hashlib.sha256(png or b"").hexdigest(), None, None, str(e)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "feature_bits", "error"])

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(f"`{key}`", "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, feature_bits binary, error string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pictures to the shared folder and computes the features from what is read back."""
    return features(C.written(store(C.table(spark, sf_dir, "documents")), "media", "none"))
