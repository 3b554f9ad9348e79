"""op4: perspective rotation over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from . import common as C


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(C.table(spark, sf_dir, "conversations")).withColumn("segment_md5", F.md5(F.col("segment").cast("binary"))).drop("segment")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|im_', '<\|im_') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker != 'system'),
j AS (SELECT t.*, perspective, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(speaker, '<|im_', '<\|im_') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM j),
o AS (SELECT *, length(segment)::BIGINT AS length, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, perspective, turn, speaker, start, length, (start + length(head))::BIGINT AS mask_start, CASE WHEN speaker = perspective THEN length(body) + 10 ELSE 0 END::BIGINT AS mask_length, md5(segment) AS segment_md5
FROM o
"""
