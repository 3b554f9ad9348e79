"""op6: packing all documents into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import packing as P
from . import tokens as T

END_ID, SIZE = 0, 2048


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row a piece, with the checksum of its stored ids in place of them, so that no ids are shuffled."""
    cut = P.pieces(docs, tokenizer or T.default_path("byte_bpe_50k.json"), END_ID, SIZE)
    return P.assign(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), SIZE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(C.table(spark, sf_dir, "documents"))
