"""op7: mixing all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import mixing as M


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.taken(M.sizes(C.table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_id FROM s0),
s2 AS (SELECT *, [5, 2, 1][(source_id - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(weight) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS onward FROM s2),
s4 AS (SELECT *, cap * onward + before * weight < total * weight AS capped FROM s3),
s5 AS (SELECT *, (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::BIGINT AS left_words,
  coalesce(sum(CASE WHEN NOT capped THEN weight END) OVER (), 1)::BIGINT AS weights FROM s4),
s6 AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (left_words * weight)::DOUBLE / weights END AS target FROM s5),
s7 AS (SELECT *, sum(floor(target)::BIGINT) OVER (ORDER BY source_id)::BIGINT AS high_words FROM s6),
s8 AS (SELECT *, high_words - floor(target)::BIGINT AS low_words, max(high_words) OVER () AS whole, greatest(1, least(2048, total // 262144))::BIGINT AS block FROM s7),
s AS (SELECT *, CASE WHEN whole > 0 THEN floor(low_words::DOUBLE / whole * 2147483648.0)::BIGINT ELSE 0 END AS low,
  CASE WHEN whole > 0 THEN floor(high_words::DOUBLE / whole * 2147483648.0)::BIGINT ELSE 0 END AS high,
  ((source_size + block - 1) // block)::BIGINT AS blocks FROM s8),
slots AS (SELECT i AS slot, ((i % 2147483648) * 1327217885) % 2147483648 AS point FROM (SELECT unnest(range(0, (SELECT coalesce(max((total + block - 1) // block), 0)::BIGINT FROM s))) AS i)),
hit AS (SELECT slot, source_id, blocks, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS rank FROM slots ASOF JOIN (SELECT * FROM s WHERE high > low) s ON point >= low),
takes AS (SELECT source_id, rank % blocks AS block_id, count(*) AS times FROM hit WHERE rank < 3 * blocks GROUP BY ALL),
p AS (SELECT d.*, s.source_id, s.source_size, s.target, s.block,
  coalesce(sum(d.size) OVER (PARTITION BY s.source_id ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
x AS (SELECT source_id, b, size, block, unnest(range(b // block, (b + size - 1) // block + 1)) AS block_id FROM p WHERE size > 0),
t AS (SELECT source_id, b, sum((least(b + size, (block_id + 1) * block) - greatest(b, block_id * block)) * times)::BIGINT AS taken FROM x JOIN takes USING (source_id, block_id) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS taken FROM p LEFT JOIN t USING (source_id, b)
"""
