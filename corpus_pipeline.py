"""A corpus pipeline over ``documents``: language, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
documents; all but the last return the columns of ``documents``, whatever other columns there are. An empty table goes through
as an empty one. Tests hold every stage against brute force, odd rows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, langid, mixing, op6_packing, simhash, substrings
from graphloom.llm.op2_language import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no text (null or empty), no letters, or like none of the learned languages.

    Repeated rows stay or go together; ids and sources may be null.
    """
    model = langid.train(docs, ~held_out())
    return langid.identify(docs.select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays; of rows of equal id and text, one.

    Different texts of one id are judged apart (of a class the least id, then the least MD5 of the text, stays). Null texts, and
    texts whose ids are all null, stay; empty texts are equal texts, of which one stays.
    """
    keep = simhash.classes(docs).filter("keep").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.select(*COLUMNS).withColumn("text_key", _text_key())
    stay = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["_id"]) & keyed["text_key"].eqNullSafe(keep["_key"]), "left_semi")
    return stay.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a document of a smaller id are cut out; a document that loses all of it goes.

    A character that a cut splits is left out. Rows of null ids or texts stay as they are, as do empty texts; rows that
    repeat an id don't cut each other; copies of 50 bytes or more of a text of a smaller id go.
    """
    stand, _ = substrings.dedup(docs, as_text=True)
    cut = stand.select(F.col("doc_id").alias("_id"), "source_key", F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept"), F.lit(True).alias("stands"))
    keyed = docs.select(*COLUMNS).withColumn("source_key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))).withColumn("_id", F.col("doc_id").cast("long"))
    copy = F.col("stands").isNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") >= substrings.LENGTH)
    out = keyed.join(cut, ["_id", "source_key"], "left").filter(~F.coalesce(copy, F.lit(False)) & F.coalesce(F.col("kept") != "", F.lit(True)))
    text = F.coalesce("kept", "text")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole time: 0 to 3.

    Rows that share id and source take the mean of their times, each to the nearest whole. Documents without words (null, empty or
    blank text) are never taken; a null source is a source, a null id an id.
    """
    per = mixing.taken(mixing.sizes(docs)).filter("size > 0")
    times = per.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.floor(F.sum(F.col("taken") / F.col("size")) / F.count("*") + 0.5).cast("int").alias("times")).filter("times > 0")
    d = docs.select(*COLUMNS)
    out = d.join(times, d["doc_id"].eqNullSafe(times["_id"]) & d["source"].eqNullSafe(times["_source"]))
    return out.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("_time")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place in it; a null or empty text is its end id alone."""
    return op6_packing.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
