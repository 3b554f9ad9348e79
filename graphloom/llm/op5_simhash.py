"""op5: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import simhash as S


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.classes(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "keep")
