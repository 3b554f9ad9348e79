"""op3: exact substring dedup of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import substrings as S


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return digest(docs, *S.dedup(docs))


def digest(docs: DataFrame, stand: DataFrame, others: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row a row of ``docs``."""
    first = stand.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "source_key")
    lengths = first.select("source_key", F.col("n_bytes").alias("size"), F.col("n_removed").alias("gone"), F.col("n_spans").alias("spans"), F.col("kept_sha256").alias("left_sha"), F.col("doc_id").alias("least"))
    o = others.join(lengths, ["source_key", "least"], "left")
    all_gone = F.col("size") >= S.LENGTH
    rest = o.filter("least IS NOT NULL").withColumn("n", F.when(F.col("again"), F.col("times") - 1).otherwise(F.col("times")))
    # a copy of at least 50 bytes loses all; a shorter one loses nothing, like the text that stands for it
    rest = rest.filter("doc_id IS NOT NULL").select("doc_id", F.col("size").alias("n_bytes"), F.when(F.col("again"), F.col("gone")).when(all_gone, F.col("size")).otherwise(0).alias("n_removed"), F.when(F.col("again"), F.col("spans")).when(all_gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(F.col("again"), F.col("left_sha")).when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("left_sha")).alias("kept_sha256"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    nameless = docs.filter("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return first.drop("source_key").unionByName(rest).unionByName(nameless)
