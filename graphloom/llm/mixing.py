"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Targets: a source's weight times the total, at most ``max_repeats`` times the source's size; what is above is shared again by
weight (the capped sources are a prefix by cap/weight, so one ordered pass over the source table finds them). Schedule:
slot i is the golden-ratio point frac(i * 0.618...), in 31-bit integers, mapped through the cumulative targets to a source;
slots are ranked per source. Each source's documents, shuffled by the MD5 of their id, form a stream of words that is cut
into blocks of equal size; the k-th slot of a source takes its block k modulo the number of blocks.

Scale: documents are reduced to (id, source, size) rows before any shuffle. Positions in a source's stream and ranks of
slots come from two-level running sums, so a hot source is split over 65536 hash ranges (slots: ranges of 4096). Points
meet sources by 4096 equal buckets of the unit interval. Only the table of sources passes through one task.

Defined results: null text has size 0; sources are weighed in code-point order, null last, and null is a source; documents
of size 0 and sources without words are never taken; rows that tie on id are placed side by side and share what is taken
as equals; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
_ONE, _GOLDEN = 2**31, 1327217885  # 2**31 times the golden ratio's fraction, odd
_BUCKET = 2**19
_EVERYTHING = (Window.unboundedPreceding, Window.unboundedFollowing)


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size): written, since several steps read it and the texts are read once."""
    return C.written(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row a source: (source_id, source, source_size, cap, weight, total, target, low, high, block).

    ``low`` and ``high`` are its part of the schedule's 31-bit circle; ``block`` is the words of a block: a 2**18th of the
    total, 1 at least and 2048 at most.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = by.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy().rowsBetween(*_EVERYTHING)
    s = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn("total", F.sum("source_size").over(every))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("capped", F.col("cap") * onward + before * F.col("weight") < F.col("total") * F.col("weight"))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
    s = s.withColumn("weights", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(1)))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("left") * F.col("weight")).cast("double") / F.col("weights")))
    by_id = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("high_words", F.sum(F.floor("target")).over(by_id)).withColumn("low_words", F.col("high_words") - F.floor("target"))
    s = s.withColumn("whole", F.max("high_words").over(every))
    circle = lambda c: F.when(F.col("whole") > 0, F.floor(F.col(c).cast("double") / F.col("whole") * float(_ONE))).otherwise(0)
    s = s.withColumn("low", circle("low_words")).withColumn("high", circle("high_words"))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(2048), F.floor(F.col("total") / 2**18))))
    return s.select("source_id", "source", "source_size", "cap", "weight", "total", "target", "low", "high", "block")


def schedule(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(slot, source_id, rank, block_id, epoch): the source of each slot, and which of its blocks it takes.

    Slots past ``max_repeats`` rounds of a source's blocks, which only rounding can give, take nothing and are left out.
    """
    spark = sources.sparkSession
    head = sources.agg(F.max("total").alias("total"), F.max("block").alias("block")).first()
    total, block = head["total"] or 0, head["block"] or 1
    n = -(-total // block)
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", (F.col("slot") % _ONE) * _GOLDEN % _ONE).withColumn("bucket", F.floor(F.col("point") / _BUCKET))
    parts = sources.filter("high > low").withColumn("blocks", F.ceil(F.col("source_size") / F.col("block"))).select("source_id", "low", "high", "blocks", F.explode(F.sequence(F.floor(F.col("low") / _BUCKET), F.floor((F.col("high") - 1) / _BUCKET))).alias("bucket"))
    hit = slots.join(parts, "bucket").filter("point >= low AND point < high").select("slot", "source_id", "blocks")
    ranked = C.running_sum(hit, ["source_id"], ["slot"], F.lit(1).cast("long"), F.floor(F.col("slot") / 4096), "rank")
    return ranked.filter(F.col("rank") < F.col("blocks") * max_repeats).select("slot", "source_id", "rank", (F.col("rank") % F.col("blocks")).alias("block_id"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def positions(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, size, source_id, begin, block): each document's place in its source's shuffled stream of words."""
    joined = sized.join(sources.select("source_id", "source", "block"), sized["source"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_id", "block")
    shuffled = joined.withColumn("shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # of documents that tie, all but the sizes are the same to the result; those of size 0 take no room
    return C.running_sum(shuffled, ["source_id"], ["shuffle", "doc_id", "size"], F.col("size"), F.substring("shuffle", 1, 4), "begin").drop("shuffle")


def blocks(placed: DataFrame) -> DataFrame:
    """(source_id, block_id, begin, doc_id, from_word, words): the pieces of documents that make up each block."""
    b = F.explode(F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("block"))))
    p = placed.filter("size > 0").withColumn("block_id", b)
    low = F.greatest(F.col("begin"), F.col("block_id") * F.col("block"))
    high = F.least(F.col("begin") + F.col("size"), (F.col("block_id") + 1) * F.col("block"))
    return p.select("source_id", "block_id", "begin", "doc_id", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stream, placed, sources). The stream has (slot, begin, source_id, doc_id, from_word, words, epoch); its order is (slot, begin)."""
    sources = C.written(targets(sized, weights, max_repeats), "sources")
    placed = C.written(positions(sized, sources), "placed")
    stream = schedule(sources, max_repeats).join(blocks(placed), ["source_id", "block_id"]).select("slot", "begin", "source_id", "doc_id", "from_word", "words", "epoch")
    return stream, placed, sources


def taken(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row a document: the words of it that the stream has."""
    stream, placed, sources = mix(sized, weights, max_repeats)
    got = stream.groupBy("source_id", "begin").agg(F.sum("words").alias("taken"), F.lit(True).alias("has"))
    zero = placed.withColumn("has", F.col("size") > 0)
    out = zero.join(got, ["source_id", "begin", "has"], "left").join(sources.select("source_id", "source", "source_size", "target"), "source_id")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
