"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue the whole dialogue is rendered with that speaker as assistant and the others as named
users; the mask covers the assistant turns' text and end mark. Names in ``system`` speak as system to everybody and get no
perspective. The result has one segment a row, (conversation, perspective, turn), with its place in the rendered string, so
that a dialogue of any length stays distributed; ``assemble`` joins the segments of dialogues that fit one row.

Scale: texts are shuffled once. With every turn rendered as a named user's, a turn's place is the sum of lengths before it,
whoever looks; a perspective differs from that by a constant for each turn of its own before. Both sums are taken in two
levels, over ranges of 256 turns and within them, the first on counts and lengths alone, so a conversation that holds a third
of all rows is split. The rows of a range are joined with the participants' sums where they lie.

Defined results: null text is empty; a null speaker is ``unknown`` and a participant; a null conversation is one of its own;
turns that tie are ordered by speaker, then text, nulls first, and equal rows are all rendered; other columns are ignored;
marks that occur inside a text or name are broken by a backslash; an empty table gives an empty one. The rows out are turns
times participants: that is what the rotation asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|im_"), F.lit("<\\|im_"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, turn, speaker, segment, start, length, mask_start, mask_length); places count characters.

    ``mask_length`` is 0 where nothing of the segment is trained on.
    """
    name = F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit("unknown"))
    raw = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), name.alias("speaker"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    special = F.col("speaker").isin(*system)
    as_user = F.when(special, F.lit("system")).otherwise(F.concat(F.lit("user name="), _safe(F.col("speaker"))))
    around = len(START) + len("\n") + len(END + "\n")
    # plain keys in place of a null conversation, so that one hash partitioning serves the join and the window
    keys = {"_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_none": F.col("conv_id").isNull(), "_range": F.when(F.col("turn").isNull(), F.lit(-(2**62))).otherwise(F.floor(F.col("turn") / 256)).cast("long")}
    t = raw.withColumns(keys).withColumn("_plain", (F.length(as_user) + F.length(_safe(F.col("text"))) + around).cast("long"))
    counts = t.groupBy("_conv", "_none", "_range", "speaker").agg(F.sum("_plain").alias("_plain"), F.count("*").alias("_n"))
    before = Window.partitionBy("_conv", "_none").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_conv", "_none", "_range").agg(F.sum("_plain").alias("_plain"))
    ranges = ranges.select("_conv", "_none", "_range", F.coalesce(F.sum("_plain").over(before), F.lit(0)).alias("_before"))
    people = counts.filter(~special).select("_conv", "_none", F.col("speaker").alias("perspective")).distinct()
    own = counts.select("_conv", "_none", "_range", F.col("speaker").alias("perspective"), "_n")
    seats = ranges.join(people, ["_conv", "_none"]).join(own, ["_conv", "_none", "_range", "perspective"], "left")
    earlier = Window.partitionBy("_conv", "_none", "perspective").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    seats = seats.withColumn("_own", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    j = t.drop("_plain").join(seats, ["_conv", "_none", "_range"])
    mine = F.col("speaker") == F.col("perspective")
    j = j.withColumns({"head": F.concat(F.lit(START), F.when(mine & ~special, F.lit("assistant")).otherwise(as_user), F.lit("\n")), "body": _safe(F.col("text"))})
    j = j.withColumn("length", (F.length("head") + F.length("body") + len(END + "\n")).cast("long"))
    within = Window.partitionBy("_conv", "_none", "_range", "perspective").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    changed = F.lit(len("assistant") - len("user name=")) - F.length(_safe(F.col("perspective")))
    start = F.col("_before") + F.col("_own") * changed + F.coalesce(F.sum("length").over(within), F.lit(0))
    size = F.when(mine, F.length("body") + len(END)).otherwise(0)
    out = j.withColumn("start", start.cast("long"))
    return out.select("conv_id", "perspective", "turn", "speaker", F.concat("head", "body", F.lit(END + "\n")).alias("segment"), "start", "length", (F.col("start") + F.length("head")).cast("long").alias("mask_start"), size.cast("long").alias("mask_length"))


def assemble(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, rendered, masks): whole strings with their trained spans. A dialogue must fit one row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_length")))
    got = segments.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask_length"] > 0), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_length"].alias("length")))
    return got.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("rendered"), spans.alias("masks"))
