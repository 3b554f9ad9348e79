"""op1: token-id output of all documents, read back by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import shards as S
from . import tokens as T

END_ID = 2


def op1_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Writes the store, looks every key up in its index, and digests the ids that the payload holds there."""
    path = C.new_path(spark, "token-store")
    S.write(C.table(spark, sf_dir, "documents"), path, tokenizer or T.default_path("word_bpe_49k.json"), END_ID)
    keys = spark.read.parquet(f"{path}/entries").select("doc_id", "copy")
    return S.read(spark, path, S.lookup(spark, path, keys), digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")
